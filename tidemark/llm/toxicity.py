"""Toxicity by a factorization machine over hashed terms.

Terms are words and the beginnings of words. Each has a weight and a short vector; the score of a text
adds the weights of its terms and, for every pair of terms, the product of their vectors. So a pair can
say what neither word says, such as an insult beside the name of a group.

Weights are learned by FTRL with an L1 term, which leaves words that say nothing at exactly zero. Vectors
are learned the same way, as steps away from small random ones, whatever the weight of their term: a pair
whose terms say nothing alone is learned too, and a term whose pairs say nothing does not move. The machine is fitted on at most ``fit_rows`` labelled rows chosen by a hash of the key, in one task; all rows
are scored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textops as X
from tidemark.session import materialize

SLOT_BITS = 24
#: Lengths in bytes of the beginnings of words.
BEGINNINGS = (4, 5)
FACTORS = 4
FIT_ROWS = 16_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 1.0
#: The same for vectors.
PAIR_ALPHA, PAIR_L1, PAIR_L2 = 0.3, 2.0, 1.0
#: Bound of a vector's gradient in one text. The gradient is a sum over all terms of the text; without a bound a few
#: long texts feed their own sums and throw the vectors far out.
PAIR_GRADIENT = 0.1
#: Terms in fewer fitted texts have no vector.
LEAST_TEXTS = 5


def terms(piece: X.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of every term, with repeats."""
    words = piece.words(X.ALNUM)
    row, size = words.row(), words.ends - words.starts
    rows, slots = [row], [words.hashes(X.LOWER)]
    for length in BEGINNINGS:
        long = size > length
        starts = words.starts[long]
        rows.append(row[long])
        slots.append(X.mix(X.hash_spans(piece.data, starts, starts + length, X.LOWER) + np.uint64(length)))
    return np.concatenate(rows), (np.concatenate(slots) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _distinct(rows: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((rows << SLOT_BITS) | slots)
    return both >> SLOT_BITS, both & ((1 << SLOT_BITS) - 1)


@dataclass
class Machine:
    """``bias``, and of each slot that says anything its number, weight and vector, in order."""

    bias: float
    slots: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    @cached_property
    def active(self) -> np.ndarray:
        out = np.zeros(1 << SLOT_BITS, bool)
        out[self.slots] = True
        return out

    def scores(self, piece: X.Piece) -> np.ndarray:
        rows, slots = terms(piece)
        some = self.active[slots]
        rows, slots = _distinct(rows[some], slots[some])
        at = np.searchsorted(self.slots, slots)
        total = self.bias + np.bincount(rows, self.weights[at], piece.rows)
        for factor in self.vectors.T:
            value = factor[at]
            total += (np.bincount(rows, value, piece.rows) ** 2 - np.bincount(rows, value**2, piece.rows)) / 2
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _moved(z: np.ndarray, n: np.ndarray, alpha: float, l1: float, l2: float) -> np.ndarray:
    """The FTRL step away from the start, for sums ``z`` of gradients and ``n`` of their squares."""
    shrunk = np.abs(z) - l1
    return np.where(shrunk > 0, -np.sign(z) * shrunk / ((BETA + np.sqrt(n)) / alpha + l2), 0.0)


def train(examples: list[tuple[int, np.ndarray]], epochs: int = EPOCHS, factors: int = FACTORS) -> Machine:
    """Fit on (label, distinct slots), in the given order.

    The bias learns freely, so that clean texts need no negative words. Every term of enough texts takes
    part in pairs. Kept are the terms with a weight or a vector that has moved.
    """
    if not examples:
        return Machine(0.0, np.empty(0, np.int64), np.empty(0), np.empty((0, factors)))
    bounds = np.cumsum([0, *(len(own) for _, own in examples)])
    slots, terms_of, texts = np.unique(
        np.concatenate([own for _, own in examples]), return_inverse=True, return_counts=True
    )
    weights, z, n = np.zeros(len(slots)), np.zeros(len(slots)), np.zeros(len(slots))
    vectors = np.random.default_rng(0).normal(0, 0.01, (len(slots), factors))
    vectors[texts < LEAST_TEXTS] = 0
    start, pair_z, pair_n = vectors.copy(), np.zeros(vectors.shape), np.zeros(vectors.shape)
    positive = sum(y for y, _ in examples)
    bias, bias_squares = float(np.log((positive + 1) / (len(examples) - positive + 1))), 1.0
    for _ in range(epochs):
        for k, (label, _) in enumerate(examples):
            own = terms_of[bounds[k] : bounds[k + 1]]
            weight = weights[own]
            paired = own[texts[own] >= LEAST_TEXTS]
            vector = vectors[paired]
            total = vector.sum(axis=0)
            margin = bias + weight.sum() + (total @ total - (vector * vector).sum()) / 2
            error = 1 / (1 + np.exp(-np.clip(margin, -35, 35))) - label
            if abs(error) < 1e-3:
                continue
            bias_squares += error * error
            bias -= error / np.sqrt(bias_squares)
            before, after = n[own], n[own] + error * error
            z[own] += error - (np.sqrt(after) - np.sqrt(before)) / ALPHA * weight
            n[own] = after
            weights[own] = _moved(z[own], after, ALPHA, L1, L2)
            gradient = np.clip(error * (total - vector), -PAIR_GRADIENT, PAIR_GRADIENT)
            before, after = pair_n[paired], pair_n[paired] + gradient**2
            pair_z[paired] += gradient - (np.sqrt(after) - np.sqrt(before)) / PAIR_ALPHA * (vector - start[paired])
            pair_n[paired] = after
            vectors[paired] = start[paired] + _moved(pair_z[paired], after, PAIR_ALPHA, PAIR_L1, PAIR_L2)
    some = (weights != 0) | (vectors != start).any(axis=1)
    return Machine(bias, slots[some].astype(np.int64), weights[some], vectors[some])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train_on: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    fit_rows: int = FIT_ROWS,
) -> Machine:
    """Learn from documents with a non-null label where ``train_on``, a condition on the key, holds.

    A key labelled several times counts with its largest label, and rows that repeat a key are one example with the
    first of their texts. Without labelled rows all scores are 0.5.
    """
    known = labels.where(train_on & F.col(label).isNotNull() & F.col(key).isNotNull())
    known = known.groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    rank = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    number = known.count()
    share = int(min(1.0, 1.1 * fit_rows / max(number, 1)) * (1 << 30))
    # At most fit_rows rows of two numbers: small enough to hand to every task.
    chosen = known.where(rank < share).withColumn("rank", rank).orderBy("rank", "key").limit(fit_rows)
    # Numbered, so that the order of the examples is the same on any layout.
    place = F.row_number().over(Window.orderBy("rank", "key")).cast("long")
    chosen = materialize(chosen.select("key", "label", place.alias("rank")), "labels")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    rows = rows.groupBy("rank", "label").agg(F.min("text").alias("text"))

    def slots_of(batch: pa.RecordBatch):
        for piece in X.pieces(batch.column(2)):
            rows, slots = _distinct(*terms(piece))
            at = slice(piece.first, piece.first + piece.rows)
            flat = X.lists(slots.astype(np.int32), np.searchsorted(rows, np.arange(piece.rows + 1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[at], batch.column(1)[at], flat], ["rank", "label", "slots"]
            )

    examples = X.map_text(rows.select("rank", "label", "text"), slots_of, "rank long, label int, slots array<int>")

    def learn(batches):
        found = []
        for batch in batches:
            offsets, flat = np.asarray(batch.column(2).offsets), np.asarray(batch.column(2).values)
            for k, label in enumerate(batch.column(1).to_pylist()):
                found.append((label, flat[offsets[k] : offsets[k + 1]].copy()))
        machine = train(found)
        lists = [machine.slots, machine.weights, machine.vectors.ravel()]
        columns = [pa.array([x.tolist()], pa.list_(pa.from_numpy_dtype(x.dtype))) for x in lists]
        yield pa.RecordBatch.from_arrays(
            [pa.array([machine.bias]), *columns], ["bias", "slots", "weights", "vectors"]
        )

    learned = examples.repartition(1).sortWithinPartitions("rank", "label").mapInArrow(
        learn, "bias double, slots array<bigint>, weights array<double>, vectors array<double>"
    )
    row = materialize(learned, "machine").first()
    if row is None:
        return train([])
    vectors = np.array(row["vectors"], float).reshape(-1, FACTORS)
    return Machine(row["bias"], np.array(row["slots"], np.int64), np.array(row["weights"], float), vectors)


def score(docs: DataFrame, machine: Machine, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``row``, a struct of ``columns`` of ``docs`` (all by default), and ``score``, from 0 to 1, higher for
    toxic texts.

    Null and empty texts have the score of a text without terms. Repeated rows stay repeated.
    """
    names = docs.columns if columns is None else columns
    rows = docs.select(F.struct(*names).alias("row"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batch: pa.RecordBatch):
        found = [shared.value.scores(piece) for piece in X.pieces(batch.column(1))]
        if found:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found))], ["row", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return X.map_text(rows, run, schema)
