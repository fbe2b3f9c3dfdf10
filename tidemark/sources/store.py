"""Feature tables as Parquet, keyed by what they were built from."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import remove
from tidemark.sources.commit import publish, published

# Raise when the meaning of a feature changes.
FEATURE_VERSION = "1"


def fingerprint(
    spark: SparkSession,
    paths: Sequence[str],
    version: str = FEATURE_VERSION,
    options: Mapping | None = None,
) -> str:
    """Digest of names, sizes and times of all input files, from their listing alone, and of ``options``."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(list(paths))
        .select("path", "length", "modificationTime")
    )
    found = files.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("length").alias("bytes"),
        F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("digest"),
    ).first()
    digest = (found["digest"] or 0) & (2**64 - 1)
    built = hashlib.sha256(json.dumps(options or {}, sort_keys=True, default=str).encode()).hexdigest()
    return f"v{version}-{found['n']}-{found['bytes'] or 0}-{digest:016x}-{built[:16]}"


def build_or_load(
    spark: SparkSession,
    root: str,
    split: str,
    paths: Sequence[str],
    build: Callable[[], DataFrame | tuple[DataFrame, Mapping[str, DataFrame]]],
    options: Mapping | None = None,
    part: str = "features",
) -> DataFrame:
    """The feature table of a split, built only if these very inputs have not been built before with these
    very options.

    A table lives under its fingerprint in a folder of its builder and becomes valid with its manifest, which
    is renamed into place last. A build that dies half-way is simply redone and leaves a folder that nothing refers to; of two
    builds at once the later one drops its folder and reads the other's. Changed inputs or a new feature
    version miss the cache. ``build`` may return further tables by name, which are stored beside the features;
    ``part`` picks the one to read.
    """
    mark = fingerprint(spark, paths, options=options)
    manifest = f"{root}/manifest/{mark}-{split}"
    note = published(spark, manifest)
    if note is None:
        own = f"{root}/features/{mark}/{uuid.uuid4().hex}"
        built = build()
        features, others = built if isinstance(built, tuple) else (built, {})
        features.drop("split").write.parquet(f"{own}/features/split={split}")
        for name, table in others.items():
            table.write.parquet(f"{own}/{name}/split={split}")
        note = publish(
            spark,
            manifest,
            {"fingerprint": mark, "split": split, "columns": features.drop("split").columns, "folder": own, "parts": [*others]},
        )
        if note["folder"] != own:
            remove(spark, own)
    table = f"{note['folder']}/{part}"
    return spark.read.option("basePath", table).parquet(f"{table}/split={split}")
