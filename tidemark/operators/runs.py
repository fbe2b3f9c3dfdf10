"""Runs in per-key ordered logs, without gathering a key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_summary(df: DataFrame, key: str, order: Sequence[Column], flag: Column) -> DataFrame:
    """Longest run of flagged rows and the flag of the last row, per key.

    The log is range-partitioned on (key, order), so a key with more rows than one partition holds is
    cut into several chunks. Each (key, chunk) is reduced to four numbers: longest run, run at its
    start, run at its end, whether an unflagged row breaks it. Stitching those few rows per key gives
    the exact answer. ``order`` must be total within a key. Output: key, longest_run, last_flag.
    """
    order_names = [f"o{i}" for i in range(len(order))]
    log = df.select(
        F.col(key),
        *[expr.alias(name) for expr, name in zip(order, order_names)],
        flag.cast("int").alias("flag"),
    )
    chunked = log.repartitionByRange(key, *order_names).withColumn("chunk", F.spark_partition_id())

    # Inside a chunk: a run is the flagged rows that follow the same number of unflagged ones.
    so_far = (Window.unboundedPreceding, Window.currentRow)
    in_order = Window.partitionBy(key, "chunk").orderBy(*order_names).rowsBetween(*so_far)
    runs = (
        chunked.withColumn("breaks", F.sum(1 - F.col("flag")).over(in_order))
        .groupBy(key, "chunk", "breaks")
        .agg(F.sum("flag").alias("run"))
    )
    chunks = runs.groupBy(key, "chunk").agg(
        F.max("run").alias("inner"),
        F.sum(F.when(F.col("breaks") == 0, F.col("run")).otherwise(0)).alias("head"),
        F.max_by("run", "breaks").alias("tail"),
        (F.max("breaks") > 0).alias("broken"),
    )

    # Across chunks: a broken chunk ends the open run with its head and opens a new one with its tail.
    by_chunk = Window.partitionBy(key).orderBy("chunk").rowsBetween(*so_far)
    piece = lambda island, run: F.struct(island.alias("island"), run.alias("run"))
    stitched = (
        chunks.withColumn("island", F.sum(F.col("broken").cast("int")).over(by_chunk))
        .withColumn(
            "piece",
            F.explode(
                F.when(
                    F.col("broken"),
                    F.array(
                        piece(F.col("island") - 1, F.col("head")),
                        piece(F.col("island"), F.col("tail")),
                    ),
                ).otherwise(F.array(piece(F.col("island"), F.col("inner"))))
            ),
        )
        .groupBy(key, F.col("piece.island").alias("island"))
        .agg(
            F.sum("piece.run").alias("joined"),
            F.max("inner").alias("inner"),
            F.max(F.struct("chunk", F.col("tail").alias("tail"))).alias("last"),
        )
    )
    return stitched.groupBy(key).agg(
        F.greatest(F.max("joined"), F.max("inner")).alias("longest_run"),
        (F.max("last")["tail"] > 0).alias("last_flag"),
    )
