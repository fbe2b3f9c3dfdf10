"""Session settings and shared scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the plans rely on. The forced skew split matters most: it lets AQE cut the
# partition of a hot user in the event-to-subscription join and then re-plan the aggregate above it
# as partial + exchange + final, so that no task ever sees all rows of one user.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Folders of the scratch spaces that are open, innermost last.
_spaces: list[str] = []


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a running session and return it."""
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for tables that outlive one plan: the one named by ``spark.checkpoint.dir``.

    Only a local master falls back to a folder in the warehouse; on a cluster its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder in whatever file system it is in."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_space(spark: SparkSession) -> Iterator[str]:
    """Scratch tables written inside the block are removed after it, also if it fails."""
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    _spaces.append(folder)
    try:
        yield folder
    finally:
        _spaces.remove(folder)
        remove(spark, folder)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    folder = _spaces[-1] if _spaces else shared_dir(spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet and reading it back.

    Later readers prune columns, see the true size in the plan statistics, and survive lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

