"""Exact ranks in large groups, computed bucket by bucket."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

_FIRST, _BEFORE = Window.unboundedPreceding, -1


def _offsets(rows: DataFrame, group: Sequence[str], bucket: str) -> DataFrame:
    """Rows in earlier buckets, per group and bucket."""
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(_FIRST, _BEFORE)
    return (
        rows.groupBy(*group, bucket)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*group, bucket, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    )


def fold_columns(
    df: DataFrame, key: str, strata: Mapping[str, tuple[Column, int]], folds: int = 5, prefix: int = 3
) -> DataFrame:
    """The key and one fold column per entry of ``strata``: its label and seed. No fold without a label.

    Works like ``stratified_folds`` for all entries at once, on narrow rows of one entry each: they are
    ranked in one shuffle and folded back into one row per key in another. The offsets, one row per label and md5 prefix
    whatever the number of rows, are what is broadcast: by estimated size Spark may choose the ranked rows.
    """
    marks = [
        F.struct(
            F.lit(name).alias("fold"),
            label.cast("string").alias("label"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).alias("hash"),
        )
        for name, (label, seed) in strata.items()
    ]
    long = df.select(key, F.inline(F.array(*marks))).where(F.col("label").isNotNull())
    long = long.withColumn("bucket", F.substring("hash", 1, prefix))
    within = Window.partitionBy("fold", "label", "bucket").orderBy("hash", key)
    ranked = long.withColumn("rank", F.row_number().over(within)).join(
        F.broadcast(_offsets(long, ["fold", "label"], "bucket")), ["fold", "label", "bucket"]
    )
    number = ((F.col("offset") + F.col("rank") - 1) % folds).cast("int")
    return ranked.groupBy(key).agg(
        *[F.max(F.when(F.col("fold") == name, number)).alias(name) for name in strata]
    )


def stratified_folds(
    df: DataFrame, key: str, label: str, seed: int, folds: int = 5, prefix: int = 3, name: str = "fold"
) -> DataFrame:
    """Assign each row a fold so that every label spreads over the folds evenly (within one row).

    The rank of a row among its label, ordered by the md5 of seed and key, modulo ``folds``. md5
    prefixes are buckets of equal size in that order, so a label is ranked in 16^prefix pieces
    whatever its share of the rows; the piece offsets are one row per label and prefix.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    hashed = df.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, prefix))
    offsets = _offsets(hashed, [label], "_b")
    within = Window.partitionBy(label, "_b").orderBy("_h", key)
    return (
        hashed.withColumn("_rn", F.row_number().over(within))
        .join(offsets, [label, "_b"])
        .withColumn(name, ((F.col("offset") + F.col("_rn") - 1) % folds).cast("int"))
        .select(*df.columns, name)
    )


def position_in_group(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Zero-based position of each row among its group, for rows unique in (group, order).

    Range partitioning on (group, order) gives ordered chunks; they are written out once because the
    chunk of a row must be the same when chunks are counted and when rows are ranked.
    """
    ranged = df.repartitionByRange(group, order).withColumn("_b", F.spark_partition_id())
    chunked = materialize(ranged, name)
    within = Window.partitionBy(group, "_b").orderBy(order)
    return (
        chunked.withColumn("_rn", F.row_number().over(within))
        .join(_offsets(chunked, [group], "_b"), [group, "_b"])
        .select(*df.columns, (F.col("offset") + F.col("_rn") - 1).cast("int").alias(name))
    )
