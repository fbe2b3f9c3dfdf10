"""Per-key value counts and what follows from them: distinct counts, busiest value, mode."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, key: str, columns: Mapping[str, Column], bucketed: bool = False) -> DataFrame:
    """Rows per (key, value) of each column, in one scan and one shuffle.

    Grouping sets aggregate partially before the shuffle, so a hot key costs each map task only its
    distinct values. Output: key, one column per input column, n; a row carries the value of exactly
    one column, or none where the value is missing, so that no key drops out.

    Grouping sets forget how their input is laid out. With ``bucketed`` every row is unfolded instead, which keeps the buckets of
    a table stored by the key, so that nothing is shuffled.
    """
    if bucketed:
        own = [F.struct(*[(x if c == name else F.lit(None)).alias(c) for c, x in columns.items()]) for name in columns]
        return df.select(key, F.inline(F.array(*own))).groupBy(key, *columns).agg(F.count(F.lit(1)).alias("n"))
    wide = df.select(key, *[expr.alias(name) for name, expr in columns.items()])
    sets = [[key, name] for name in columns]
    return wide.groupingSets(sets, key, *columns).agg(F.count(F.lit(1)).alias("n"))


def _of(column: str, x: Column) -> Column:
    """Restrict an aggregate input to the counts of one column."""
    return F.when(F.col(column).isNotNull(), x)


def distinct_values(column: str) -> Column:
    """Aggregate over ``value_counts``: number of distinct values."""
    return F.count(column)


def busiest(column: str) -> Column:
    """Aggregate over ``value_counts``: rows of the most frequent value, null without any value."""
    return F.max(_of(column, F.col("n")))


def mode(column: str, default: str = "unknown") -> Column:
    """Aggregate over ``value_counts``: most frequent value, the smallest one on a tie."""
    rank = F.struct((-F.col("n")).alias("n"), F.col(column).alias("value"))
    best = F.min(_of(column, rank))
    return F.coalesce(best["value"], F.lit(default))
