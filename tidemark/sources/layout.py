"""Tables stored in buckets of their key, so that aggregates and joins by key need no exchange."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import KEY
from tidemark.session import remove, scratch_path

#: A key with more rows than this stays out of buckets by default, since a bucket is read by one task.
MAX_KEY_ROWS = 5_000_000


def store_bucketed(
    df: DataFrame,
    name: str,
    key: str = KEY,
    order: Sequence[str] = (),
    buckets: int = 200,
    path: str | None = None,
    max_key_rows: int = MAX_KEY_ROWS,
) -> DataFrame:
    """Store ``df`` as table ``name`` in buckets of ``key``, each one file sorted by key and ``order``, and read it.

    Tables of the same number of buckets meet by key, and are grouped by it, without an exchange. A bucket is one task, so a
    table whose largest key has more than ``max_key_rows`` is refused: such a key needs the splitting that AQE does after a
    shuffle. Without ``path`` the files are in the scratch space. An existing table of that name is replaced.
    """
    spark = df.sparkSession
    largest = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > max_key_rows:
        raise ValueError(f"a key of {name} has {largest} rows, more than a bucket of {max_key_rows} should hold")
    path = path or scratch_path(spark, name)
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    remove(spark, path)
    dealt = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key, *order)
    dealt.option("path", path).saveAsTable(name)
    return spark.table(name)


def bucket_name(table: str) -> str:
    """A table name that no other run uses."""
    return f"{table}_{uuid.uuid4().hex}"
