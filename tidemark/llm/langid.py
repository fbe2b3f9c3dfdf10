"""Language identification by nearest centroids.

A text is a vector of hashed byte n-grams, weighted by TF-IDF and normalised. Every language has several
centroids, clustered by cosine, since it has several kinds of text. A text belongs to the language of the
nearest centroid; it is rejected if that is farther than nearly all texts the centroid was made of.

Document frequencies cover all training rows. Centroids are clustered from at most ``fit_rows`` rows a
language, chosen by a hash of the key; that many vectors are one group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops as X
from tidemark.session import materialize

SLOTS = 4096
FIT_ROWS = 1000
CENTROIDS = 4
ROUNDS = 10
#: Share of a centroid's own texts that may be farther away than its radius.
OUTSIDE = 0.01
UNDETERMINED = "und"

_ROWS = 64
#: Bytes of letters, A-Z lower-cased; everything else separates words.
_FOLD = np.where(X.ALNUM & ~np.isin(np.arange(256), np.arange(48, 58)), X.LOWER, 32).astype(np.uint32)


def counts(piece: X.Piece, low: int, high: int) -> np.ndarray:
    """How often each slot occurs in rows ``low`` to ``high``: n-grams of one to three bytes."""
    rows, offsets = high - low, piece.offsets
    # A blank before and after each row.
    size = np.diff(offsets[low : high + 1])
    row = np.repeat(np.arange(rows), size + 2)
    text = np.full(len(row), 32, np.uint32)
    inside = np.ones(len(row), bool)
    ends = np.cumsum(size + 2)
    inside[ends - 1] = inside[ends - size - 2] = False
    text[inside] = _FOLD[piece.data[offsets[low] : offsets[high]]]
    kept = np.ones(len(row), bool)
    kept[1:] = (text[1:] != 32) | (text[:-1] != 32) | (row[1:] != row[:-1])
    text, row = text[kept], row[kept]

    total = np.zeros(rows * SLOTS, np.int64)
    code = np.zeros(len(text), np.uint32)
    for n in range(1, 4):
        code = code[: len(text) - n + 1] * np.uint32(256) + text[n - 1 :] + np.uint32(n << 24)
        slot = (code * np.uint32(2654435761)) >> np.uint32(20)
        same = row[: len(slot)] == row[n - 1 :]
        code = code & np.uint32(0xFFFFFF)
        total += np.bincount(row[: len(slot)][same] * SLOTS + slot[same], minlength=rows * SLOTS)
    return total.reshape(rows, SLOTS)


def _blocks(texts: pa.Array):
    for piece in X.pieces(texts):
        for low in range(0, piece.rows, _ROWS):
            high = min(piece.rows, low + _ROWS)
            yield piece.first + low, counts(piece, low, high)


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    radius: np.ndarray
    idf: np.ndarray


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(found.astype(np.float32)) * idf
    norm = np.linalg.norm(weighted, axis=1, keepdims=True)
    return weighted / np.where(norm > 0, norm, 1)


def cluster(points: np.ndarray, number: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and radii (smallest cosine that counts as near) by spherical k-means.

    The first centroid is the mean; each further one starts at the point farthest from those so far.
    """
    centres = points.mean(axis=0, keepdims=True)
    centres /= max(np.linalg.norm(centres), 1e-12)
    for _ in range(min(number, len(points)) - 1):
        farthest = (points @ centres.T).max(axis=1).argmin()
        centres = np.concatenate([centres, points[farthest : farthest + 1]])
    for _ in range(rounds):
        nearest = (points @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            if (nearest == k).any():
                mean = points[nearest == k].mean(axis=0)
                centres[k] = mean / max(np.linalg.norm(mean), 1e-12)
    cosine = points @ centres.T
    nearest = cosine.argmax(axis=1)
    radius = [
        np.quantile(cosine[nearest == k, k], OUTSIDE) if (nearest == k).any() else 1.0 for k in range(len(centres))
    ]
    return centres, np.array(radius)


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(
    docs: DataFrame,
    train: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "lang",
    fit_rows: int = FIT_ROWS,
    centroids: int = CENTROIDS,
) -> Model | None:
    """Learn from rows where ``train`` holds, with a label and a letter in the text; None without any."""
    rows = docs.where(train & F.col(label).isNotNull() & _has_letter(F.col(text)))
    rows = rows.select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("string").alias("label")
    )

    def frequencies(batches):
        # One row a task: in how many texts each slot occurs, and the number of texts at the end.
        total = np.zeros(SLOTS + 1, np.int64)
        for batch in batches:
            for _, found in _blocks(batch.column(0)):
                total[:SLOTS] += (found > 0).sum(axis=0)
                total[SLOTS] += len(found)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["total"])

    X.small_batches(docs.sparkSession)
    parts = rows.select("text").mapInArrow(frequencies, "total array<bigint>")
    sums = parts.select(F.posexplode("total").alias("slot", "n")).groupBy("slot").agg(F.sum("n").alias("n"))
    frequency = np.zeros(SLOTS + 1)
    for slot, n in sums.collect():  # one row a slot
        frequency[slot] = n
    if not frequency[SLOTS]:
        return None
    idf = np.log((1 + frequency[SLOTS]) / (1 + frequency[:SLOTS])).astype(np.float32) + 1

    # One row a language. Twice the rows asked for pass the hash, and the group cuts them to the bound.
    sizes = rows.groupBy("label").count().collect()
    part = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30))
    chosen = F.lit(False)
    for row in sizes:
        share = min(1.0, 2 * fit_rows / row["count"])
        chosen = chosen | ((F.col("label") == row["label"]) & (part < int(share * (1 << 30))))

    def embed(batch: pa.RecordBatch):
        for first, found in _blocks(batch.column(2)):
            at = slice(first, first + len(found))
            points = vectors(found, idf)
            flat = X.lists(points.ravel(), np.arange(len(points) + 1) * SLOTS)
            yield pa.RecordBatch.from_arrays([batch.column(0)[at], batch.column(1)[at], flat], ["rank", "label", "point"])

    def grouped(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").head(fit_rows)
        centres, radius = cluster(np.stack(group["point"].to_numpy()).astype(np.float32), centroids)
        return pd.DataFrame({"label": group["label"].iloc[0], "centre": list(centres), "radius": radius})

    # Rows that repeat key and text are one; without that all of them would pass the hash.
    sample = rows.where(chosen).select(part.alias("rank"), "label", "text").distinct()
    points = X.map_text(sample, embed, "rank long, label string, point array<float>")
    fitted = points.groupBy("label").applyInPandas(grouped, "label string, centre array<float>, radius double")
    fitted = sorted(materialize(fitted, "centroids").collect(), key=lambda r: (r["label"], r["centre"]))
    languages = sorted({r["label"] for r in fitted})
    return Model(
        languages,
        np.array([languages.index(r["label"]) for r in fitted]),
        np.array([r["centre"] for r in fitted], np.float32),
        np.array([r["radius"] for r in fitted]),
        idf,
    )


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``lang_pred``, ``score`` (the best cosine) and ``rejected``.

    Texts without a letter, empty and null ones are ``und`` with score 0, and all texts are if there is no
    model. A rejected text still names the nearest language.
    """
    letters = _has_letter(F.col(text))
    rows = docs.select(F.col(key).alias("key"), letters.alias("letters"), F.when(letters, F.col(text)).alias("text"))
    if model is None:
        return rows.select(
            F.col("key").alias(key),
            F.lit(UNDETERMINED).alias("lang_pred"),
            F.lit(0.0).alias("score"),
            F.lit(True).alias("rejected"),
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def nearest(batch: pa.RecordBatch):
        known = shared.value
        for first, found in _blocks(batch.column(2)):
            at = slice(first, first + len(found))
            cosine = vectors(found, known.idf) @ known.centroids.T
            best = cosine.argmax(axis=1)
            score = np.clip(cosine[np.arange(len(best)), best], 0, 1).astype(float)
            letters = batch.column(1)[at].to_numpy(zero_copy_only=False)
            names = [known.languages[known.owner[b]] if ok else UNDETERMINED for b, ok in zip(best, letters)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[at],
                    pa.array(names, pa.string()),
                    pa.array(np.where(letters, score, 0.0)),
                    pa.array(~letters | (score < known.radius[best])),
                ],
                ["key", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema[key].dataType.simpleString()
    found = X.map_text(rows, nearest, f"key {kind}, lang_pred string, score double, rejected boolean")
    return found.withColumnRenamed("key", key)
