"""Publishing a result once, whoever finishes first.

Every builder writes into a folder of its own. What makes a result valid is its manifest, and that comes into being by one
rename that fails if it is there already. So readers see all of a result or nothing, and of two builders at work at the
same time the later one finds the manifest of the other and uses that. On file systems whose rename is not atomic, two
builders can still both believe to be first; then one of two equal results is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.session import remove


def published(spark: SparkSession, manifest: str) -> dict | None:
    """The note in a manifest, or None before it is published."""
    try:
        row = spark.read.schema("note string").parquet(manifest).first()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise
    return json.loads(row["note"])


def _renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder unless the target is there."""
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    conf = context._jsc.hadoopConfiguration()
    a, b = (p.getFileSystem(conf).makeQualified(p) for p in (a, b))
    a.getFileSystem(conf).mkdirs(b.getParent())
    # Without options a rename does not overwrite.
    options = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), conf).rename(a, b, options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def publish(spark: SparkSession, manifest: str, note: Mapping) -> dict:
    """Publish ``note`` as the manifest, or return the note of whoever was first."""
    staged = f"{manifest.rpartition('/')[0]}/.staged-{uuid.uuid4().hex}"
    spark.range(1).select(F.lit(json.dumps(dict(note))).alias("note")).coalesce(1).write.parquet(staged)
    if _renamed(spark, staged, manifest):
        return dict(note)
    remove(spark, staged)
    return published(spark, manifest)
