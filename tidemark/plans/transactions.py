"""Payment attempts: one row per user from the attempt log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.nulls import sum_or_zero
from tidemark.functions.numeric import to_cents
from tidemark.functions.text import flag, one_of
from tidemark.operators import counts
from tidemark.operators.runs import run_summary
from tidemark.schemas import KEY, TRANSACTION_FEATURES, names

# Failure codes behind each failure count.
FAILURE_CODES = {
    "ta_card_declined": ("card_declined",),
    "ta_cvc_fail": ("incorrect_cvc", "invalid_cvc"),
    "ta_expired": ("expired_card",),
    "ta_auth_req": ("authentication_required",),
}
# Card flags that may arrive as text, and plain booleans.
TOLERANT_FLAGS = {
    "ta_is_prepaid": "is_prepaid",
    "ta_is_virtual": "is_virtual",
    "ta_is_business": "is_business",
}
BOOLEAN_FLAGS = {"ta_is_3ds": "is_3d_secure", "ta_3ds_auth": "is_3d_secure_authenticated"}
# Columns reported by their most frequent value.
MODES = {
    "ta_card_funding": "card_funding",
    "ta_card_brand": "card_brand",
    "ta_payment_method": "payment_method_type",
    "ta_bank_country": "bank_country",
    "ta_card_country": "card_country",
}


def from_rollup(attempts: DataFrame, key: str = KEY) -> DataFrame:
    """Counts, amounts and flags: one hash aggregate over the log."""
    code, amount = F.col("failure_code"), F.col("amount_in_usd")
    failed = code.isNotNull()
    blank = F.lit("")
    mismatch = F.coalesce("card_country", blank) != F.coalesce("billing_address_country", blank)
    measures = [
        F.count(F.lit(1)).alias("ta_total"),
        F.count_if(failed).alias("ta_failed_count"),
        F.count_if(~failed).alias("ta_success_count"),
        F.avg(failed.cast("double")).alias("ta_fail_rate"),
        sum_or_zero(amount).alias("ta_amount_total"),
        F.avg(amount).alias("ta_amount_mean"),
        F.max(amount).alias("ta_amount_max"),
        F.max(mismatch.cast("int")).alias("ta_ctry_mismatch"),
        F.max(one_of(F.col("cvc_check"), ["pass"]).cast("int")).alias("ta_cvc_pass"),
    ]
    measures += [F.count_if(one_of(code, v)).alias(out) for out, v in FAILURE_CODES.items()]
    measures += [F.max(flag(F.col(c))).alias(out) for out, c in TOLERANT_FLAGS.items()]
    measures += [
        F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(out) for out, c in BOOLEAN_FLAGS.items()
    ]
    return attempts.groupBy(key).agg(*measures)


def from_value_counts(attempts: DataFrame, key: str = KEY, bucketed: bool = False) -> DataFrame:
    """Repeated amounts and modal card attributes from one count of values."""
    columns = {c: F.col(c) for c in MODES.values()}
    columns["amount"] = to_cents(F.col("amount_in_usd"))
    counted = counts.value_counts(attempts, key, columns, bucketed)
    return counted.groupBy(key).agg(
        counts.busiest("amount").alias("ta_max_retries"),
        *[counts.mode(c).alias(out) for out, c in MODES.items()],
    )


def from_order(attempts: DataFrame, key: str = KEY, sequence: str = "attempt_id") -> DataFrame:
    """Longest failed run and outcome of the last attempt; attempts without time come last.

    ``sequence`` settles equal times and must be unique within a user.
    """
    at = F.col("transaction_time")
    summary = run_summary(
        attempts, key, [at.isNull(), at, F.col(sequence)], F.col("failure_code").isNotNull()
    )
    return summary.select(
        key,
        F.col("longest_run").alias("ta_max_consec_fail"),
        F.col("last_flag").cast("double").alias("ta_last_failed"),
    )


def transaction_features(
    attempts: DataFrame, key: str = KEY, sequence: str = "attempt_id", bucketed: bool = False
) -> DataFrame:
    """All 26 payment features, one row per user with attempts."""
    return (
        from_rollup(attempts, key)
        .join(from_value_counts(attempts, key, bucketed), key, "left")
        .join(from_order(attempts, key, sequence), key, "left")
        .select(key, *names(TRANSACTION_FEATURES))
    )
