"""Physical plans: what is read, what is shuffled, and what happens to a user with a third of all rows."""

import re

import pytest
from pyspark.sql import functions as F

from catalogue import fixtures
from catalogue.queries import QUERIES
from tidemark.plans import assemble, generations, profile, transactions

SMALL = "/root/testdata/sf0.001"
HOT = 7


def plan(df):
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The input tables as plain Parquet, as on a cluster."""
    out = {}
    for name, df in fixtures.tables(spark, SMALL).items():
        path = str(tmp_path_factory.mktemp("tables") / name)
        df.write.parquet(path)
        out[name] = spark.read.parquet(path)
    return out


def test_only_needed_columns_are_read(stored):
    ratios = generations.from_rollup(
        generations.on_arc(stored["generations"], stored["properties"])
    ).select("user_id", "gen_video_ratio")
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan(ratios))
    assert "user_id:bigint,generation_type:string" in scans
    assert not any("credit_cost" in s or "created_at" in s for s in scans)


def test_row_filters_reach_the_scan(stored):
    recent = stored["transactions"].where(F.col("transaction_time") > "1998-01-01")
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan(transactions.from_rollup(recent))).group(1)
    assert "GreaterThan(transaction_time" in pushed


def test_whole_table_has_no_python_and_no_cross_join(stored, no_broadcast):
    text = plan(assemble.feature_table(stored))
    for operator in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoop", "ObjectHashAggregate"):
        assert operator not in text, operator


def test_joins_on_features_add_no_exchange(stored, no_broadcast):
    """Exchanges: two input sides of the event join, two per two-step count, three for the ordered
    log, one per plain aggregate or user-level table. Nothing is shuffled again for the joins."""
    text = plan(assemble.feature_table(stored))
    expected = {
        "event and start side": 2,
        "dates and types": 2,
        "purchases": 2,
        "quiz": 1,
        "payment rollup": 1,
        "amounts and modes": 2,
        "ordered log": 3,
        "users and properties": 2,
    }
    assert text.count("Exchange ") == sum(expected.values())


def test_every_aggregate_combines_before_its_shuffle(stored, no_broadcast):
    for df in (
        transactions.from_rollup(stored["transactions"]),
        transactions.from_value_counts(stored["transactions"]),
        generations.from_value_counts(stored["generations"]),
        profile.purchase_features(stored["purchases"]),
        profile.quiz_features(stored["quizzes"]),
    ):
        for line, below in zip(plan(df).splitlines(), plan(df).splitlines()[1:]):
            if "Exchange " in line:
                assert "functions=[partial_" in below or "Sort" in below, line


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Events and start dates with one user holding a third of the events."""
    root = tmp_path_factory.mktemp("skewed")
    second = F.make_dt_interval(secs=(F.col("id") * 3).cast("decimal(18,6)"))
    user = F.when(F.col("id") % 3 == 0, F.lit(HOT)).otherwise(F.col("id") % 4000).cast("long")
    spark.range(240_000).repartition(16).select(
        user.alias("user_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + second).alias("created_at"),
        F.lit("completed").alias("status"),
        F.lit("video_x").alias("generation_type"),
        F.rand(1).alias("credit_cost"),
        F.rand(2).alias("duration"),
    ).write.parquet(f"{root}/events")
    spark.range(4000).select(
        F.col("id").alias("user_id"), F.lit("2024-01-01").cast("date").alias("subscription_start_date")
    ).write.parquet(f"{root}/starts")
    return spark.read.parquet(f"{root}/events"), spark.read.parquet(f"{root}/starts")


def test_hot_user_is_split_in_the_event_join(skewed, conf, no_broadcast):
    conf(
        spark__sql__shuffle__partitions="16",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="100KB",
    )
    events, starts = skewed
    df = generations.from_rollup(generations.on_arc(events, starts))
    rows = {r.user_id: r for r in df.collect()}
    final = plan(df).split("== Initial Plan ==")[0]
    assert "SortMergeJoin(skew=true)" in final
    # The aggregate above was re-planned: partial in the split tasks, then a small shuffle.
    join = final.index("SortMergeJoin(skew=true)")
    partial = final.rindex("functions=[partial_count", 0, join)
    assert "Exchange hashpartitioning(user_id" in final[:partial]
    want = events.where(F.col("user_id") == HOT).agg(F.count(F.lit(1)), F.sum("credit_cost")).first()
    assert rows[HOT].gen_total == want[0] > 80_000
    assert rows[HOT].gen_credit_total == pytest.approx(want[1])


def test_registered_queries_use_whole_tables():
    """No row caps or samples hide in the catalogue."""
    import inspect

    from catalogue import queries

    source = inspect.getsource(queries)
    for word in (".sample(", ".limit(", "rand(", "LIMIT"):
        assert word not in source
    assert len(QUERIES) >= 58
