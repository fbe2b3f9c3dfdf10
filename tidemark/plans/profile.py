"""Purchases, onboarding quiz and subscription properties."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.nulls import sum_or_zero
from tidemark.functions.text import lookup, mentions, one_of
from tidemark.functions.time import parse
from tidemark.operators import counts
from tidemark.schemas import KEY, PLAN_TIERS, PROPERTY_FEATURES, PURCHASE_FEATURES, QUIZ_FEATURES, names

# Quiz answers, and the spellings behind each frustration flag.
QUIZ_COLUMNS = (
    "source",
    "flow_type",
    "team_size",
    "experience",
    "usage_plan",
    "frustration",
    "first_feature",
    "role",
)
FRUSTRATIONS = {
    "qf_cost": ("High cost of top models", "high-cost"),
    "qf_incon": ("inconsistent", "Inconsistent results"),
    "qf_limited": ("limited", "Limited generations"),
    "qf_prompt": ("hard-prompt", "Hard to prompt"),
    "qf_other": ("other", "Other"),
}


def purchase_features(purchases: DataFrame, key: str = KEY) -> DataFrame:
    """Count, amounts, credit packs and distinct types per user.

    Two exact steps: (key, type) first, so a hot user is spread over its types and pre-aggregated,
    then key. Sums and counts of the first step add up in the second.
    """
    amount, kind = F.col("purchase_amount_dollars"), F.col("purchase_type")
    by_type = purchases.groupBy(key, kind).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(amount).alias("n_amount"),
        sum_or_zero(amount).alias("amount"),
    )
    return by_type.groupBy(key).agg(
        F.sum("n").alias("purch_count"),
        F.sum("amount").alias("purch_total"),
        F.try_divide(F.sum("amount"), F.sum("n_amount")).alias("purch_mean"),
        F.count("purchase_type").alias("purch_types"),
        F.sum(F.when(mentions(F.col("purchase_type"), "credit"), F.col("n")).otherwise(0)).alias(
            "purch_credit_packs"
        ),
    ).select(key, *names(PURCHASE_FEATURES))


def quiz_features(quizzes: DataFrame, key: str = KEY, sequence: str = "seq") -> DataFrame:
    """First answers of each user by ``sequence``, renamed, with one flag per frustration.

    The first row is a minimum over (sequence, answers), which combines on the map side; a window
    would bring all rows of a user together.
    """
    first = quizzes.groupBy(key).agg(F.min_by(F.struct(*QUIZ_COLUMNS), sequence).alias("first"))
    answers = first.select(key, *[F.col(f"first.{c}").alias(f"q_{c}") for c in QUIZ_COLUMNS])
    flags = {
        out: one_of(F.col("q_frustration"), spellings).cast("int")
        for out, spellings in FRUSTRATIONS.items()
    }
    return answers.withColumns(flags).select(key, *names(QUIZ_FEATURES))


def property_features(
    properties: DataFrame,
    key: str = KEY,
    tiers: Mapping[str, int] = PLAN_TIERS,
    plan_prefix: str = "",
) -> DataFrame:
    """Plan, country, plan tier and calendar parts of the start date (Monday is 0).

    ``plan_prefix`` is text in front of every plan name, such as a brand and a blank.
    """
    start = parse(F.col("subscription_start_date"))
    tier_of = {plan_prefix + plan: tier for plan, tier in tiers.items()}
    return properties.select(
        key,
        F.col("subscription_plan").alias("prop_plan"),
        F.col("country_code").alias("prop_country"),
        lookup(F.col("subscription_plan"), tier_of, 0).alias("prop_tier"),
        F.weekday(start).alias("prop_dow"),
        F.month(start).alias("prop_month"),
        F.day(start).alias("prop_day"),
    ).select(key, *names(PROPERTY_FEATURES))
