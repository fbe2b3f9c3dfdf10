"""Class profiles, risk tables and per-user explanations on top of the feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.nulls import is_true
from tidemark.operators import arc
from tidemark.plans.generations import DAYS, daily_counts, on_arc
from tidemark.schemas import CLASSES, KEY, LABEL, LATE_FROM_DAY


def class_profile(features: DataFrame, label: str = LABEL) -> DataFrame:
    """Mean behaviour and payment signals per class."""
    return features.groupBy(label).agg(
        F.count(F.lit(1)).alias("users"),
        F.avg("gen_days_active").alias("active_days"),
        F.avg("gen_completion_rate").alias("completion_rate"),
        F.avg("ta_is_prepaid").alias("prepaid_share"),
        F.avg(F.coalesce("ta_last_failed", F.lit(0.0))).alias("last_failed_share"),
        F.avg("ta_card_declined").alias("declined_mean"),
    )


def daily_activity_by_class(
    users: DataFrame, generations: DataFrame, properties: DataFrame, key: str = KEY, label: str = LABEL
) -> DataFrame:
    """Events per user of the class on each arc day.

    Events are folded to one row per user before labels are joined, so the join never sees raw events.
    """
    per_user = users.select(key, label).join(
        daily_counts(on_arc(generations, properties, key), key), key, "left"
    )
    totals = per_user.groupBy(label).agg(
        F.count(F.lit(1)).alias("users"),
        *[F.sum(F.coalesce(name, F.lit(0))).alias(name) for name in DAYS],
    )
    days = [
        F.struct(F.lit(d).alias("day"), F.col(name).alias("events")) for d, name in enumerate(DAYS)
    ]
    return totals.select(label, "users", F.inline(F.array(*days))).withColumn(
        "events_per_user", F.col("events") / F.col("users")
    )


def risk_lift(features: DataFrame, label: str = LABEL) -> DataFrame:
    """Prepaid cards against payment churn, in both directions.

    ``share_lift`` compares prepaid shares within the classes, ``rate_lift`` churn rates within the
    card groups.
    """
    stay, _, fail = CLASSES
    prepaid, failing = is_true(F.col("ta_is_prepaid") == 1), F.col(label) == fail
    counts = features.agg(
        F.count_if(failing).alias("fail"),
        F.count_if(failing & prepaid).alias("fail_prepaid"),
        F.count_if(F.col(label) == stay).alias("stay"),
        F.count_if((F.col(label) == stay) & prepaid).alias("stay_prepaid"),
        F.count_if(prepaid).alias("prepaid"),
        F.count(F.lit(1)).alias("users"),
    )
    rates = counts.select(
        F.try_divide("fail_prepaid", "fail").alias("prepaid_share_invol"),
        F.try_divide("stay_prepaid", "stay").alias("prepaid_share_not"),
        F.try_divide("fail_prepaid", "prepaid").alias("invol_rate_prepaid"),
        F.try_divide(
            F.col("fail") - F.col("fail_prepaid"), F.col("users") - F.col("prepaid")
        ).alias("invol_rate_other"),
    )
    return rates.withColumns(
        {
            "share_lift": F.try_divide("prepaid_share_invol", "prepaid_share_not"),
            "rate_lift": F.try_divide("invol_rate_prepaid", "invol_rate_other"),
        }
    )


def top_risk_countries(
    features: DataFrame, label: str = LABEL, min_users: int = 20, limit: int = 10
) -> DataFrame:
    """Countries with the highest share of payment churn among those with enough users."""
    return (
        features.where(F.col("prop_country").isNotNull())
        .groupBy("prop_country")
        .agg(
            F.count(F.lit(1)).alias("users"),
            F.avg((F.col(label) == CLASSES[2]).cast("double")).alias("invol_rate"),
        )
        .where(F.col("users") >= min_users)
        .orderBy(F.desc("invol_rate"), "prop_country")
        .limit(limit)
    )


# What is done about each class and each complaint.
ACTIONS = {
    "not_churned": "none",
    "vol_churn": "day-7 intervention",
    "invol_churn": "renewal warning and new payment method",
}
COMPLAINT_ACTIONS = {
    "qf_cost": "show how to save credits and offer the basic plan",
    "qf_incon": "prompting guide and templates",
    "qf_limited": "show progress and remind of credit packs",
}


def churn_reasons(
    features: DataFrame,
    predicted: str,
    risk_countries: DataFrame,
    key: str = KEY,
    probability: str | None = None,
    few_days: int = 2,
    late_start_hours: float = 12.0,
    falling_slope: float = -1.0,
) -> DataFrame:
    """The predicted class with its probability, the reasons behind it and the suggested actions, as text.

    ``predicted`` names the class column of ``features`` and ``probability`` that of its probability, if known.
    """
    risky = risk_countries.select("prop_country", F.lit(1).alias("_risky"))
    f = F.col
    payment = {
        "prepaid card": f("ta_is_prepaid") == 1,
        "last payment failed": f("ta_last_failed") == 1,
        "high-risk country": f("_risky") == 1,
        "card and billing country differ": f("ta_ctry_mismatch") == 1,
    }
    behaviour = {
        "few active days": f("gen_days_active") <= few_days,
        "falling activity": f("gen_activity_slope") < falling_slope,
        "late first generation": f("gen_first_latency_h") >= late_start_hours,
        "frustration: cost": f("qf_cost") == 1,
        "frustration: inconsistent results": f("qf_incon") == 1,
        "frustration: limits": f("qf_limited") == 1,
    }

    def held(rules) -> Column:
        return F.array_compact(F.array(*[F.when(is_true(c), F.lit(t)) for t, c in rules.items()]))

    called = F.col(predicted)
    none = F.array().cast("array<string>")
    reasons = F.when(called == CLASSES[2], held(payment)).when(called == CLASSES[1], held(behaviour))
    reasons = reasons.otherwise(none)
    answers = held({text: f(flag) == 1 for flag, text in COMPLAINT_ACTIONS.items()})
    general = F.coalesce(*[F.when(called == c, F.lit(a)) for c, a in ACTIONS.items()])
    actions = F.array(general)
    actions = F.when(called == CLASSES[1], F.concat(actions, answers)).otherwise(actions)
    return features.join(risky, "prop_country", "left").select(
        key,
        called.alias("predicted"),
        (F.col(probability) if probability else F.lit(None)).cast("double").alias("probability"),
        F.size(reasons).alias("n_reasons"),
        F.array_join(reasons, "; ").alias("reasons"),
        F.array_join(actions, "; ").alias("action"),
    )


FIRST_DAYS = DAYS[:LATE_FROM_DAY]


def first_week(events: DataFrame, key: str = KEY) -> DataFrame:
    """What is known of each user by day 7: the slope and the active days of arc days 0 to 6."""
    week = daily_counts(events, key).withColumns(arc.moments(FIRST_DAYS))
    active = sum((F.col(d) > 0).cast("int") for d in FIRST_DAYS)
    return week.select(key, arc.slope().alias("week_slope"), active.alias("week_days"))


def intervention_triggers(
    features: DataFrame,
    events: DataFrame,
    key: str = KEY,
    few_days: int = 3,
    quick_start_hours: float = 0.5,
) -> DataFrame:
    """Segment rules as 0/1 columns; a missing signal does not trigger.

    ``events`` carry their arc day. The day-7 rule looks at days 0 to 6 only, so it can fire while there
    is time to act.
    """
    f = F.col
    rules = {
        "renewal_warning": (f("ta_is_prepaid") == 1) & (f("ta_failed_count") > 0),
        "day7_intervention": (f("week_slope") < 0) & (f("week_days") <= few_days),
        "quick_start": f("gen_first_latency_h") <= quick_start_hours,
    }
    known = features.join(first_week(events, key), key, "left")
    return known.select(key, *[is_true(c).cast("int").alias(n) for n, c in rules.items()])
