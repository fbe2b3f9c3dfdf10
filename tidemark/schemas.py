"""Input tables, label codes and the feature dictionary."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

KEY = "user_id"
LABEL = "churn_status"

# --- fixed values: labels, plan tiers, the 14-day arc -------------------------------------------
CLASSES = ("not_churned", "vol_churn", "invol_churn")
PLAN_TIERS = {"Basic": 1, "Creator": 2, "Pro": 3, "Ultimate": 4}
ARC_DAYS = 14
FOLDS = 5
ARC_BUCKETS = {"q1": (0, 3), "q2": (4, 6), "q3": (7, 10), "q4": (11, 13)}
LATE_FROM_DAY = 7
LAST_DAYS_FROM = 11
# --- end of fixed values -------------------------------------------------------------------------


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


_STR, _DBL, _BOOL, _TS = T.StringType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()

TABLES: dict[str, T.StructType] = {
    "users": _table((KEY, _STR), (LABEL, _STR)),
    "generations": _table(
        (KEY, _STR),
        ("created_at", _TS),
        ("status", _STR),
        ("generation_type", _STR),
        ("credit_cost", _DBL),
        ("duration", _DBL),
    ),
    "properties": _table(
        (KEY, _STR),
        ("subscription_start_date", _TS),
        ("subscription_plan", _STR),
        ("country_code", _STR),
    ),
    "purchases": _table((KEY, _STR), ("purchase_amount_dollars", _DBL), ("purchase_type", _STR)),
    "quizzes": _table(
        (KEY, _STR),
        ("source", _STR),
        ("flow_type", _STR),
        ("team_size", _STR),
        ("experience", _STR),
        ("usage_plan", _STR),
        ("frustration", _STR),
        ("first_feature", _STR),
        ("role", _STR),
    ),
    "transactions": _table(
        (KEY, _STR),
        ("transaction_time", _TS),
        ("failure_code", _STR),
        ("is_prepaid", _STR),
        ("is_virtual", _STR),
        ("is_business", _STR),
        ("is_3d_secure", _BOOL),
        ("is_3d_secure_authenticated", _BOOL),
        ("card_country", _STR),
        ("billing_address_country", _STR),
        ("bank_country", _STR),
        ("amount_in_usd", _DBL),
        ("cvc_check", _STR),
        ("card_funding", _STR),
        ("card_brand", _STR),
        ("payment_method_type", _STR),
    ),
}

# Tables whose rows have an order that matters, and the column that records it.
SEQUENCE = {"quizzes": "seq", "transactions": "attempt_id"}
# Tables that must hold one row per user.
UNIQUE = ("users", "properties")

COUNTRY_COLUMNS = ("country_code", "card_country", "billing_address_country", "bank_country")


class Feature(NamedTuple):
    """An output column and its value for a user without rows in the source.

    ``zero`` means 0, ``null`` stays missing until the model matrix writes -1, ``unknown`` becomes
    the category of that name, ``never`` cannot be missing.
    """

    name: str
    missing: str


# Output column names and how each treats a user without source rows.
PROPERTY_FEATURES = [
    Feature("prop_plan", "unknown"),
    Feature("prop_country", "unknown"),
    Feature("prop_tier", "null"),
    Feature("prop_dow", "null"),
    Feature("prop_month", "null"),
    Feature("prop_day", "null"),
]
GENERATION_FEATURES = [
    Feature("gen_total", "zero"),
    Feature("gen_completed", "zero"),
    Feature("gen_failed", "zero"),
    Feature("gen_nsfw", "zero"),
    Feature("gen_canceled", "zero"),
    Feature("gen_credit_total", "zero"),
    Feature("gen_credit_mean", "null"),
    Feature("gen_credit_max", "null"),
    Feature("gen_credit_std", "null"),
    Feature("gen_days_active", "zero"),
    Feature("gen_types_unique", "null"),
    Feature("gen_max_in_day", "zero"),
    Feature("gen_span_hours", "null"),
    Feature("gen_completion_rate", "zero"),
    Feature("gen_fail_rate", "zero"),
    Feature("gen_nsfw_rate", "zero"),
    Feature("gen_cancel_rate", "zero"),
    Feature("gen_video_count", "zero"),
    Feature("gen_image_count", "zero"),
    Feature("gen_video_ratio", "zero"),
    Feature("gen_per_active_day", "zero"),
    Feature("gen_duration_mean", "null"),
    Feature("gen_duration_max", "null"),
    Feature("gen_duration_sum", "null"),
    Feature("gen_duration_std", "null"),
    Feature("gen_q1_count", "zero"),
    Feature("gen_q1_credits", "zero"),
    Feature("gen_q1_compl", "zero"),
    Feature("gen_q2_count", "zero"),
    Feature("gen_q2_credits", "zero"),
    Feature("gen_q2_compl", "zero"),
    Feature("gen_q3_count", "zero"),
    Feature("gen_q3_credits", "zero"),
    Feature("gen_q3_compl", "zero"),
    Feature("gen_q4_count", "zero"),
    Feature("gen_q4_credits", "zero"),
    Feature("gen_q4_compl", "zero"),
    Feature("gen_credit_early", "zero"),
    Feature("gen_credit_late", "zero"),
    Feature("gen_credit_vel_ratio", "null"),
    Feature("gen_early_count", "zero"),
    Feature("gen_late_count", "zero"),
    Feature("gen_activity_slope", "null"),
    Feature("gen_peak_day", "null"),
    Feature("gen_activity_cliff", "null"),
    Feature("gen_last3_count", "zero"),
    Feature("gen_last3_frac", "zero"),
    Feature("gen_first_latency_h", "null"),
    Feature("gen_compl_trend", "null"),
    Feature("gen_video_credit_ratio", "null"),
]
PURCHASE_FEATURES = [
    Feature("purch_count", "zero"),
    Feature("purch_total", "zero"),
    Feature("purch_mean", "null"),
    Feature("purch_types", "null"),
    Feature("purch_credit_packs", "zero"),
]
QUIZ_FEATURES = [
    Feature("q_source", "unknown"),
    Feature("q_flow_type", "unknown"),
    Feature("q_team_size", "unknown"),
    Feature("q_experience", "unknown"),
    Feature("q_usage_plan", "unknown"),
    Feature("q_frustration", "unknown"),
    Feature("q_first_feature", "unknown"),
    Feature("q_role", "unknown"),
    Feature("qf_cost", "zero"),
    Feature("qf_incon", "zero"),
    Feature("qf_limited", "zero"),
    Feature("qf_prompt", "zero"),
    Feature("qf_other", "zero"),
]
TRANSACTION_FEATURES = [
    Feature("ta_total", "zero"),
    Feature("ta_failed_count", "zero"),
    Feature("ta_success_count", "zero"),
    Feature("ta_fail_rate", "zero"),
    Feature("ta_card_declined", "zero"),
    Feature("ta_cvc_fail", "zero"),
    Feature("ta_expired", "zero"),
    Feature("ta_auth_req", "null"),
    Feature("ta_is_prepaid", "zero"),
    Feature("ta_is_virtual", "zero"),
    Feature("ta_is_business", "null"),
    Feature("ta_is_3ds", "null"),
    Feature("ta_3ds_auth", "null"),
    Feature("ta_amount_total", "null"),
    Feature("ta_amount_mean", "null"),
    Feature("ta_amount_max", "null"),
    Feature("ta_last_failed", "null"),
    Feature("ta_ctry_mismatch", "zero"),
    Feature("ta_max_consec_fail", "zero"),
    Feature("ta_max_retries", "zero"),
    Feature("ta_cvc_pass", "null"),
    Feature("ta_card_funding", "unknown"),
    Feature("ta_card_brand", "unknown"),
    Feature("ta_payment_method", "unknown"),
    Feature("ta_bank_country", "unknown"),
    Feature("ta_card_country", "unknown"),
]
PRESENCE_FEATURES = [
    Feature("has_gen", "never"),
    Feature("has_tx", "never"),
    Feature("has_purch", "never"),
]
COMPOSITE_FEATURES = [
    Feature("invol_risk", "never"),
    Feature("vol_risk", "never"),
    Feature("engagement", "never"),
    Feature("plan_x_engagement", "null"),
    Feature("gen_front_ratio", "never"),
    Feature("gen_back_ratio", "never"),
]
BASE_FEATURES = (
    PROPERTY_FEATURES
    + GENERATION_FEATURES
    + PURCHASE_FEATURES
    + QUIZ_FEATURES
    + TRANSACTION_FEATURES
    + PRESENCE_FEATURES
    + COMPOSITE_FEATURES
)
TARGETS = ("is_churned", "is_vol", "is_invol")
TARGET_ENCODED = (
    "prop_country",
    "prop_plan",
    "q_source",
    "q_frustration",
    "q_role",
    "q_usage_plan",
    "q_first_feature",
)
TE_FEATURES = [f"te_{column}_{target}" for column in TARGET_ENCODED for target in TARGETS]


def names(features: list[Feature]) -> list[str]:
    return [f.name for f in features]


def zero_filled() -> list[str]:
    return [f.name for f in BASE_FEATURES if f.missing == "zero"]


def categorical() -> list[str]:
    return [f.name for f in BASE_FEATURES if f.missing == "unknown"]


MODEL_FEATURES = names(BASE_FEATURES) + TE_FEATURES
