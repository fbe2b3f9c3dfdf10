"""Joins whose frequent keys are dealt over many tasks, whatever their size in bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this part of all rows is frequent, so there are fewer frequent keys than ``PARTS``.
PARTS = 1024
#: Keys of so few rows are never frequent.
LEAST_ROWS = 256


def spread_join(rows: DataFrame, keys: DataFrame, on: list[str], deal_by: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``keys``, a stored table of one row a key and its number of ``copies`` in ``rows``.

    Rows of a frequent key are dealt by a hash of the columns ``deal_by`` over as many shares as the key has
    times the bound, and its row in ``keys`` is repeated for each share. All tasks see the list of
    frequent keys, which has fewer than ``PARTS`` rows at any size. Keys without copies and rows without a key are left out; an empty side
    gives no rows. Neither ``copies`` nor a column of this join's own is returned.
    """
    total = keys.agg(F.sum("copies")).first()[0] or 0
    most = max(LEAST_ROWS, total // PARTS + 1)
    shares = F.ceil(F.col("copies") / most).cast("int")
    frequent = keys.where(F.col("copies") > most).select(*on, shares.alias("_shares"))
    dealt = rows.join(F.broadcast(frequent), on, "left")
    share = F.pmod(F.xxhash64(*deal_by), F.coalesce("_shares", F.lit(1))).cast("int")
    dealt = dealt.withColumn("_share", share).drop("_shares")
    each = F.explode(F.sequence(F.lit(0), F.greatest(shares, F.lit(1)) - 1))
    repeated = keys.withColumn("_share", each).drop("copies")
    return dealt.join(repeated, [*on, "_share"]).drop("_share")
