"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_TRAINING_USERS (users of the full
training, 0 to skip it).
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import fixtures
from catalogue.queries import QUERIES, _write_splits
from tidemark import configure
from tidemark.plans import generations, pipeline, training, transactions
from tidemark.plans.assemble import feature_table
from tidemark.schemas import KEY, LABEL
from tidemark.session import materialize, scratch_space
from tidemark.sources.csv import load_split

HEADLINE = (
    "gen_core",
    "gen_arc_buckets",
    "gen_cliff",
    "tx_core",
    "tx_modes",
    "tx_longest_fail_run",
    "purch_features",
    "quiz_features",
    "stratified_folds",
    "target_encode_oof",
    "threshold_sweep",
    "nested_f1",
    "class_profile",
)

# Copies of the event table in the repeated builds.
COPIES = 50


def elapsed(action: Callable[[], object]) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def timed(df: Callable[[], DataFrame]) -> float:
    return elapsed(lambda: df().write.format("noop").mode("overwrite").save())


def copied(tables: dict[str, DataFrame], copies: int) -> dict[str, DataFrame]:
    """Input tables with every event repeated for other users, stored like the rest."""
    users = tables["users"].count()
    step = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    events = tables["generations"].repartition(16).withColumn("copy", step)
    events = events.withColumn("user_id", (F.col("user_id") + F.col("copy") * 1501) % users)
    return tables | {"generations": materialize(events.drop("copy"), "copied")}


def from_csv(spark: SparkSession, root: str) -> None:
    """The feature build of both splits as the baseline counts it: six CSV files per split are parsed first."""
    for split in ("train", "test"):
        tables = {t: materialize(df, t) for t, df in load_split(spark, root, split).items()}
        feature_table(tables).write.format("noop").mode("overwrite").save()


def full_training(tables: dict[str, DataFrame], users: int) -> float:
    """All three models with the default settings, tuning and reports, on so many users.

    Users beyond those of the tables are copies with some noise in one feature.
    """
    built = materialize(feature_table(tables), "features")
    copies = -(-users // max(1, built.count()))
    step = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    rows = built.withColumn("copy", step).withColumn(KEY, F.concat_ws("-", KEY, "copy"))
    noise = F.pmod(F.xxhash64(KEY), F.lit(100)) / 100
    rows = rows.withColumn("gen_first_latency_h", F.col("gen_first_latency_h") + noise)
    rows = materialize(rows.limit(users).drop("copy"), "training-users")
    train = rows.where("split = 'train'").drop("split")
    test = rows.where("split = 'test'").drop("split", LABEL)
    return elapsed(lambda: pipeline.fit_and_report(train, test))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    training_users = int(os.environ.get("BENCH_TRAINING_USERS", "0"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    with scratch_space(spark) as scratch:
        # The whole feature build on stored input tables, as on a cluster; the first pass is the cold one.
        tables = {k: materialize(v, k) for k, v in fixtures.tables(spark, folder).items()}
        rows = sum(df.count() for df in tables.values())
        seconds = {
            "feature_build_cold": timed(lambda: feature_table(tables)),
            "feature_build": timed(lambda: feature_table(tables)),
            "gen_features": timed(
                lambda: generations.generation_features(tables["generations"], tables["properties"])
            ),
            "tx_features": timed(lambda: transactions.transaction_features(tables["transactions"])),
        }
        for name in HEADLINE:
            seconds[name] = timed(lambda: QUERIES[name](spark, folder))
        events = copied(tables, COPIES)
        timed(lambda: feature_table(events))
        scaled = timed(lambda: feature_table(events))
        event_rows = events["generations"].count()
        _write_splits(events, f"{scratch}/csv", ("train", "test"))
        parsed = elapsed(lambda: from_csv(spark, f"{scratch}/csv"))
        report = {
            "metric": "headline queries, total",
            "value": round(sum(seconds.values()), 3),
            "unit": "sec",
            "queries": seconds,
            "sf": folder.rsplit("sf", 1)[-1],
            "input_rows": rows,
            "feature_build_rows_per_sec": round(rows / seconds["feature_build"]),
            # The same build over the event table repeated, where fixed costs matter less; from Parquet
            # and, like the published time, from CSV.
            "repeated": {
                "copies": COPIES,
                "event_rows": event_rows,
                "seconds": scaled,
                "events_per_sec": round(event_rows / scaled),
                "csv_seconds": parsed,
                "csv_events_per_sec": round(event_rows / parsed),
            },
        }
        if training_users:
            settings = training.Settings()
            report["training"] = {
                "users": training_users,
                "seconds": full_training(tables, training_users),
                "settings": str(settings),
            }
        print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
