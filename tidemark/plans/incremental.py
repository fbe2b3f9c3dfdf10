"""Generation features of a growing set of event files, where only new files are read.

The files that come together are cut into segments. A segment keeps mergeable states of its events: per user the sums, extremes,
moments and daily counts, and per user and value the counts. The features of all files are one aggregate over the
states of all segments. A file that changes or disappears costs its segment, whose other files count as new again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Container, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import generations
from tidemark.schemas import KEY
from tidemark.session import materialize, remove
from tidemark.sources.commit import publish, published
from tidemark.sources.store import FEATURE_VERSION


def _files(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """Digest of name, size and time of every input file, and its path; from the listing alone."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    rows = listing.select("path", "length", "modificationTime").collect()
    name = lambda r: hashlib.sha256(f"{r.path}|{r.length}|{r.modificationTime}".encode()).hexdigest()[:24]
    return {name(r): r.path for r in sorted(rows)}


def _starts_mark(properties: DataFrame, key: str, window: str) -> str:
    """Digest of all that a state depends on besides its events: the subscription starts and the window."""
    code = F.xxhash64(key, F.col("subscription_start_date").cast("string"))
    found = properties.agg(F.count(F.lit(1)), F.bit_xor(code), F.bit_xor(F.xxhash64(code))).first()
    return hashlib.sha256(json.dumps([*found, window, FEATURE_VERSION]).encode()).hexdigest()[:24]


def incremental_features(
    spark: SparkSession,
    store: str,
    paths: Sequence[str],
    properties: DataFrame,
    read: Callable[[list[str]], DataFrame],
    key: str = KEY,
    window: str = "clip",
    files_per_segment: int = 64,
) -> DataFrame:
    """All 50 generation features over the event files below ``paths``, one row per user with events.

    ``read`` makes the typed events of some files. States live below ``store`` by the subscription starts they were
    computed with. Every segment becomes valid with its own manifest, named by the files it holds, so that a build
    that dies keeps the segments it has finished, and two builds at once share them.
    """
    root = f"{store}/states/{_starts_mark(properties, key, window)}"
    files = _files(spark, paths)
    valid = _valid_segments(spark, root, files)
    covered = {f for note in valid for f in note["files"]}
    new = [f for f in files if f not in covered]
    for at in range(0, len(new), files_per_segment):
        own = sorted(new[at : at + files_per_segment])
        valid.append(_build_segment(spark, root, own, [files[f] for f in own], properties, read, key, window))
    if not valid:
        raise FileNotFoundError(f"no event files below {', '.join(paths)}")
    states = lambda name: reduce(DataFrame.unionByName, [spark.read.parquet(f"{n['folder']}/{name}") for n in valid])
    return generations.from_states(states("rollup"), states("values"), key)


def _valid_segments(spark: SparkSession, root: str, files: Container[str]) -> list[dict]:
    """Notes of the published segments of which all files are still there; a file belongs to the first that holds it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/segments")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = sorted(s.getPath().getName() for s in system.listStatus(path) if not s.getPath().getName().startswith("."))
    notes, seen = [], set()
    for name in names:
        note = published(spark, f"{root}/segments/{name}")
        if note and all(f in files for f in note["files"]) and not seen & set(note["files"]):
            seen |= set(note["files"])
            notes.append(note)
    return notes


def _build_segment(
    spark: SparkSession,
    root: str,
    files: list[str],
    paths: list[str],
    properties: DataFrame,
    read: Callable[[list[str]], DataFrame],
    key: str,
    window: str,
) -> dict:
    own = f"{root}/data/{uuid.uuid4().hex}"
    # Written once, since two aggregates read them.
    events = materialize(generations.on_arc(read(paths), properties, key, window), "segment-events")
    generations.rollup_states(events, key).write.parquet(f"{own}/rollup")
    generations.value_states(events, key).write.parquet(f"{own}/values")
    name = hashlib.sha256("".join(files).encode()).hexdigest()[:32]
    note = publish(spark, f"{root}/segments/{name}", {"files": files, "folder": own})
    if note["folder"] != own:
        remove(spark, own)
    return note
