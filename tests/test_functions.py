"""Null, time, text and rounding rules, one small frame each."""

import datetime as dt

import pytest
from helpers import ts
from pyspark.sql import functions as F

from tidemark.functions import labels, nulls, numeric, text, time


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_clip_keeps_missing(spark):
    got = values(spark, "x int", [(None,), (-2,), (5,), (99,)], nulls.clip(F.col("x"), 0, 13))
    assert got == [(None,), (0,), (5,), (13,)]


def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "k int, x double")
    assert df.groupBy("k").agg(nulls.sum_or_zero(F.col("x")).alias("s")).first()["s"] == 0.0


def test_missing_condition_is_false(spark):
    got = values(spark, "x string", [(None,), ("a",)], nulls.is_true(F.col("x") == "a"))
    assert got == [(False,), (True,)]


def test_ratio_floors_the_count(spark):
    got = values(spark, "a long, b long", [(0, 0), (3, 4)], nulls.per(F.col("a"), F.col("b")))
    assert got == [(0.0,), (0.75,)]


def test_nan_becomes_missing(spark):
    got = values(spark, "x double", [(float("nan"),), (1.0,)], nulls.nan_to_null(F.col("x")))
    assert got == [(None,), (1.0,)]


@pytest.mark.parametrize(
    "spelling, expected",
    [("True", 1), ("true", 1), (" TRUE ", 1), ("1", 1), ("1.0", 1), ("False", 0), ("yes", 0), (None, 0)],
)
def test_flag_spellings(spark, spelling, expected):
    assert values(spark, "x string", [(spelling,)], text.flag(F.col("x"))) == [(expected,)]


def test_flag_of_booleans(spark):
    got = values(spark, "x boolean", [(True,), (False,), (None,)], text.flag(F.col("x")))
    assert got == [(1,), (0,), (0,)]


def test_prefix_and_containment(spark):
    rows = [("video_a",), ("Video",), (None,), ("extra CREDITS",)]
    got = values(
        spark, "x string", rows, text.starts_with(F.col("x"), "video"), text.mentions(F.col("x"), "credit")
    )
    assert got == [(True, False), (False, False), (False, False), (False, True)]


def test_lookup_default(spark):
    got = values(spark, "x string", [("a",), ("z",), (None,)], text.lookup(F.col("x"), {"a": 4}, 0))
    assert got == [(4,), (0,), (0,)]


def arc_day(spark, rows, days=14):
    day = nulls.clip(time.whole_days(F.col("s"), F.col("t")), lo=0, hi=days - 1)
    return values(spark, "s timestamp_ntz, t timestamp_ntz", rows, day)


def test_days_round_down_and_clamp(spark):
    start = ts("2024-01-05")
    rows = [
        (start, start - dt.timedelta(seconds=1)),
        (start, start),
        (start, start + dt.timedelta(hours=23, minutes=59)),
        (start, start + dt.timedelta(days=13, microseconds=-1)),
        (start, start + dt.timedelta(days=13)),
        (start, start + dt.timedelta(days=40)),
        (start, None),
        (None, start),
    ]
    assert arc_day(spark, rows) == [(0,), (0,), (0,), (12,), (13,), (13,), (None,), (None,)]


def test_start_time_of_day_counts(spark):
    rows = [(ts("2024-01-05 18:00"), ts("2024-01-06 17:59")), (ts("2024-01-05 18:00"), ts("2024-01-06 18:00"))]
    assert arc_day(spark, rows) == [(0,), (1,)]


def test_hours_may_be_negative(spark):
    rows = [(ts("2024-01-05"), ts("2024-01-04 22:30"))]
    got = values(
        spark, "s timestamp_ntz, t timestamp_ntz", rows, time.hours_between(F.col("s"), F.col("t"))
    )
    assert got == [(-1.5,)]


def test_parse(spark):
    rows = [("2024-02-29 10:00:00",), ("29/02/2024",), ("nonsense",), (None,)]
    default = values(spark, "x string", rows, time.parse(F.col("x")))
    assert default == [(ts("2024-02-29 10:00:00"),), (None,), (None,), (None,)]
    explicit = values(spark, "x string", rows, time.parse(F.col("x"), "dd/MM/yyyy"))
    assert explicit == [(None,), (ts("2024-02-29"),), (None,), (None,)]


def test_cents_round_half_to_even(spark):
    rows = [(0.125,), (0.375,), (1.005,), (-0.001,), (None,)]
    got = values(spark, "x double", rows, numeric.to_cents(F.col("x")).cast("string"))
    assert got == [("0.12",), ("0.38",), ("1.0",), ("0.0",), (None,)]


def test_first_argmax(spark):
    rows = [(0.2, 0.5, 0.3), (0.4, 0.4, 0.2), (0.2, 0.4, 0.4), (0.3, 0.3, 0.3), (0.1, 0.2, 0.7)]
    columns = [F.col(c) for c in "abc"]
    got = values(spark, "a double, b double, c double", rows, numeric.first_argmax(columns))
    assert got == [(1,), (0,), (1,), (0,), (2,)]


def test_labels_round_trip(spark):
    rows = [("not_churned",), ("vol_churn",), ("invol_churn",), ("other",), (None,)]
    df = labels.with_targets(spark.createDataFrame(rows, "churn_status string"))
    got = [tuple(r) for r in df.select("y", labels.decode(F.col("y"))).collect()]
    assert got == [(0, "not_churned"), (1, "vol_churn"), (2, "invol_churn"), (None, None), (None, None)]
