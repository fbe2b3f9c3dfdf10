"""Payment features against a plain loop per user, including a user with most of the log."""

import datetime as dt
import random

import pytest
from helpers import by_key, ts
from pyspark.sql import functions as F

from tidemark.operators.runs import run_summary
from tidemark.plans.transactions import from_value_counts, transaction_features
from tidemark.schemas import TABLES, TRANSACTION_FEATURES, names

ATTEMPT = (
    "attempt_id long, user_id string, transaction_time timestamp_ntz, failure_code string, is_prepaid string, "
    "is_virtual string, is_business string, is_3d_secure boolean, is_3d_secure_authenticated boolean, "
    "card_country string, billing_address_country string, bank_country string, amount_in_usd double, "
    "cvc_check string, card_funding string, card_brand string, payment_method_type string"
)
NAMES = [c.split()[0] for c in ATTEMPT.split(", ")]


def attempt(i, user="a", **given):
    base = dict.fromkeys(NAMES)
    base.update(attempt_id=i, user_id=user, is_3d_secure=False, is_3d_secure_authenticated=False)
    base.update(given)
    return tuple(base[n] for n in NAMES)


def features(spark, rows):
    return by_key(transaction_features(spark.createDataFrame(rows, ATTEMPT)))


def test_schema_matches_the_declared_table():
    assert set(TABLES["transactions"].names) == set(NAMES) - {"attempt_id"}


def test_empty_signals(spark):
    f = features(spark, [attempt(1)])["a"]
    assert list(f) == ["user_id", *names(TRANSACTION_FEATURES)]
    assert f["ta_total"] == 1 and f["ta_failed_count"] == 0 and f["ta_fail_rate"] == 0.0
    assert f["ta_amount_total"] == 0.0 and f["ta_amount_mean"] is None and f["ta_max_retries"] is None
    assert f["ta_card_funding"] == f["ta_bank_country"] == "unknown"
    assert (f["ta_cvc_pass"], f["ta_ctry_mismatch"], f["ta_last_failed"]) == (0, 0, 0.0)


def test_codes_flags_and_countries(spark):
    rows = [
        attempt(1, failure_code="incorrect_cvc", is_prepaid="True", card_country="DE", cvc_check="fail"),
        attempt(2, failure_code="invalid_cvc", is_prepaid="no", billing_address_country="DE"),
        attempt(3, failure_code="card_declined", is_virtual="false", is_3d_secure=True),
        attempt(4, failure_code="never_seen", cvc_check="pass"),
        attempt(5, user="b", card_country="FR", billing_address_country="FR"),
    ]
    f = features(spark, rows)
    a, b = f["a"], f["b"]
    assert (a["ta_cvc_fail"], a["ta_card_declined"], a["ta_expired"], a["ta_failed_count"]) == (2, 1, 0, 4)
    assert (a["ta_is_prepaid"], a["ta_is_virtual"], a["ta_is_3ds"], a["ta_3ds_auth"]) == (1, 0, 1, 0)
    assert a["ta_cvc_pass"] == 1 and a["ta_ctry_mismatch"] == 1 and b["ta_ctry_mismatch"] == 0


def test_mode_takes_the_smallest_of_equal_counts(spark):
    rows = [attempt(i, card_brand=b) for i, b in enumerate(["visa", "amex", "visa", "amex", None, None, None])]
    assert features(spark, rows)["a"]["ta_card_brand"] == "amex"


def test_users_without_any_value_stay(spark):
    rows = [attempt(1, user="a"), attempt(2, user="b", card_brand="visa")]
    got = by_key(from_value_counts(spark.createDataFrame(rows, ATTEMPT)))
    assert got["a"]["ta_card_brand"] == "unknown" and got["b"]["ta_card_brand"] == "visa"


def test_repeated_amounts_after_rounding(spark):
    amounts = [10.001, 10.004, 9.999, 0.0, -0.001, None, None, None, None]
    rows = [attempt(i, amount_in_usd=x) for i, x in enumerate(amounts)]
    assert features(spark, rows)["a"]["ta_max_retries"] == 3


def test_order_by_time_then_sequence_with_missing_time_last(spark):
    rows = [
        attempt(3, transaction_time=ts("2024-01-02"), failure_code="x"),
        attempt(2, transaction_time=ts("2024-01-02")),
        attempt(1, transaction_time=ts("2024-01-03"), failure_code="x"),
        attempt(9, transaction_time=None),
        attempt(8, transaction_time=None, failure_code="x"),
    ]
    f = features(spark, rows)["a"]
    assert f["ta_max_consec_fail"] == 3 and f["ta_last_failed"] == 0.0


def longest(flags):
    best = run = 0
    for x in flags:
        run = run + 1 if x else 0
        best = max(best, run)
    return best


@pytest.mark.parametrize("partitions, seed", [("1", 1), ("5", 2), ("40", 3)])
def test_runs_match_a_loop_when_one_user_spans_many_chunks(spark, conf, partitions, seed):
    conf(
        spark__sql__shuffle__partitions=partitions,
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    rng = random.Random(seed)
    logs = {"hot": [rng.random() < 0.9 for _ in range(4000)]}
    logs["hot"][1200:2600] = [True] * 1400  # longer than any chunk of the finest cut
    logs["all"] = [True] * 900
    logs["none"] = [False] * 300
    for u in range(300):
        logs[f"u{u}"] = [rng.random() < 0.6 for _ in range(rng.randint(1, 12))]
    rows = [(u, i, x) for u, flags in logs.items() for i, x in enumerate(flags)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "user_id string, i long, x boolean").repartition(7)
    got = {
        r["user_id"]: (r["longest_run"], r["last_flag"])
        for r in run_summary(df, "user_id", [F.col("i")], F.col("x")).collect()
    }
    assert got == {u: (longest(flags), flags[-1]) for u, flags in logs.items()}


def test_hot_user_is_cut_into_chunks(spark, conf):
    """No partition of the ordered log holds more than its share, whoever owns the rows."""
    conf(spark__sql__adaptive__coalescePartitions__enabled="false")
    df = spark.range(80_000).select(
        F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("user_id"),
        (F.lit(0) * F.col("id")).alias("same_time"),
        "id",
    )
    sizes = df.repartitionByRange("user_id", "same_time", "id").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in sizes.collect()) < 80_000 / 8 * 2


def test_timestamps_order_runs(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [
        attempt(100 - i, transaction_time=base + dt.timedelta(hours=i), failure_code="x" if i % 4 else None)
        for i in range(20)
    ]
    f = features(spark, rows)["a"]
    assert f["ta_max_consec_fail"] == 3 and f["ta_last_failed"] == 1.0
