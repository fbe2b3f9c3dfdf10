"""Fitted models in the shared store, so that an interrupted cross-validation goes on where it stopped.

The models of a fold live under a mark of everything they depend on: the rows with their labels and folds, the settings of
the learner, and the fold. A fold is valid with its manifest, published last.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import remove
from tidemark.sources.commit import publish, published

_KINDS = {c.__name__: c for c in (GBTClassificationModel, RandomForestClassificationModel)}


def fit_mark(rows: DataFrame, columns: Sequence[str], vector: str, estimator: Estimator, options: Mapping) -> str:
    """Digest of the rows (in any order), the learner's settings and other options, in one pass over the rows."""
    code = F.xxhash64(*columns, vector_to_array(vector))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(code).alias("digest"), F.bit_xor(F.xxhash64(code)).alias("again"))
    settings = {p.name: estimator.getOrDefault(p) for p in estimator.params if estimator.hasDefault(p) or estimator.isSet(p)}
    described = {"rows": [*found.first()], "learner": type(estimator).__name__, "settings": settings, "options": dict(options)}
    return hashlib.sha256(json.dumps(described, sort_keys=True, default=str).encode()).hexdigest()[:32]


def save_fold(spark: SparkSession, root: str, fold: int, members: Sequence[Model], curves: Sequence[Sequence[float]]) -> dict:
    """Save the models of a fold below ``root`` and publish them; returns the note of those that are valid."""
    own = f"{root}/fold={fold}-{uuid.uuid4().hex}"
    for k, member in enumerate(members):
        member.write().save(f"{own}/member={k}")
    kind = type(members[0]).__name__
    note = {"path": own, "kind": kind, "members": len(members), "curves": [list(c) for c in curves]}
    valid = publish(spark, f"{root}/manifest-{fold}", note)
    if valid["path"] != own:
        remove(spark, own)
    return valid


def saved_fold(spark: SparkSession, root: str, fold: int) -> dict | None:
    return published(spark, f"{root}/manifest-{fold}")


def load_members(note: Mapping) -> tuple[Model, ...]:
    return tuple(_KINDS[note["kind"]].load(f"{note['path']}/member={k}") for k in range(note["members"]))
