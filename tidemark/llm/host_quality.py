"""Quality rules at host level.

Four rules are counted per document and added up per host. A host with few documents says little
about itself, so its failure rate is drawn towards the rate of all hosts by a beta prior that is fitted
to the hosts' rates by their mean and variance, each host counting by its documents. A host is rejected, with all its
documents, if its shrunk rate of any rule lies beyond what the prior allows: more than ``spread`` standard
deviations of the prior and more than ``excess`` above its mean, or above ``max_rate`` in any case.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops as X
from tidemark.session import materialize

#: Rule name and condition on the counts of a document. The first two make ``base_failed``.
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_symbols > n_words",
    "lines": "2 * n_dup_lines > n_lines",
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Bounds of a host's shrunk rate: standard deviations of the prior, least distance from its mean, and an absolute one.
SPREAD, EXCESS, MAX_RATE = 3.0, 0.1, 0.5
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def _count(piece: X.Piece) -> list[np.ndarray]:
    words = piece.words()
    rows = words.row()
    chars = X.SPACED[piece.data] & ((piece.data & 0xC0) != 0x80)

    starts, ends = piece.lines()
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[filled], ends[filled]
    line_row = np.searchsorted(piece.offsets, starts, "right") - 1
    line_bounds = np.searchsorted(starts, piece.offsets)
    keys = X.in_row(line_row, X.hash_spans(piece.data, starts, ends, X.SAME))
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True

    three = X.grams(words.hashes(), 3)
    inside = np.flatnonzero(rows[: len(three)] == rows[2:]) if len(three) else np.empty(0, int)
    twice = inside[X.repeated(X.in_row(rows[inside], three[inside]))]
    covered = np.zeros(len(rows), bool)
    for k in range(3):
        covered[twice + k] = True
    return [
        words.counts,
        piece.per_row(chars),
        piece.per_row(_SYMBOL[piece.data]),
        np.diff(line_bounds),
        X.per_range(~first, line_bounds),
        X.per_range(covered, words.bounds),
    ]


def _counts(batch: pa.RecordBatch):
    keys, hosts, texts = batch.columns
    for piece in X.pieces(texts):
        at = slice(piece.first, piece.first + piece.rows)
        columns = [pa.array(c, pa.int64()) for c in _count(piece)]
        yield pa.RecordBatch.from_arrays([keys[at], hosts[at], *columns], ["key", "host", *COUNTS])


def text_counts(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Counts of words, symbols, lines and repeats per document, from its whole text.

    Words are compared by 64-bit hashes. Null and empty texts have zeros everywhere.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(host).cast("string").alias("host"), F.col(text))
    kind = docs.schema[key].dataType.simpleString()
    columns = ", ".join(f"{c} long" for c in COUNTS)
    return X.map_text(rows, _counts, f"key {kind}, host string, {columns}")


def host_rates(
    counts: DataFrame, max_rate: float = MAX_RATE, spread: float = SPREAD, excess: float = EXCESS
) -> DataFrame:
    """Per host: documents, shrunk failure rate of each rule, and the verdict ``host_kept``.

    The prior of a rule has the documents' mean rate m and the strength m (1 - m) / v - 1, where v is the
    variance of the hosts' rates, weighted by their documents; without variance all hosts share the mean. Rows without
    a host are left out.
    """
    fails = [F.sum(F.expr(rule).cast("long")).alias(f"f_{name}") for name, rule in RULES.items()]
    hosts = counts.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n_docs"), *fails)
    n, moments = F.col("n_docs"), []
    for name in RULES:
        f = F.col(f"f_{name}")
        mean = F.sum(f) / F.sum(n)
        moments += [mean.alias(f"m_{name}"), (F.sum(f * f / n) / F.sum(n) - mean * mean).alias(f"v_{name}")]
    prior = hosts.agg(*moments).select(F.struct("*")).scalar()

    rates, fits = [], []
    for name in RULES:
        f, mean, var = F.col(f"f_{name}"), prior[f"m_{name}"], prior[f"v_{name}"]
        strength = mean * (1 - mean) / var - 1
        pooled = (f + mean * strength) / (n + strength)
        rate = F.when((var > 0) & (strength > 0), pooled).when(var > 0, f / n).otherwise(mean)
        rates.append(rate.alias(f"rate_{name}"))
        limit = mean + F.greatest(spread * F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(excess))
        fits.append(F.col(f"rate_{name}") <= F.least(limit, F.lit(max_rate)))
    rated = hosts.select("host", "n_docs", *rates)
    return rated.withColumn("host_kept", reduce(lambda a, b: a & b, fits))


def judge(
    docs: DataFrame,
    key: str = "doc_id",
    host: str = "source",
    text: str = "text",
    max_rate: float = MAX_RATE,
    salts: int = 32,
    spread: float = SPREAD,
    excess: float = EXCESS,
) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``host_kept`` and ``kept``.

    The host table is repeated ``salts`` times and documents pick a copy by their key, so that the rows
    of one large host meet their verdict in many tasks. A document without a host is judged by its own
    rules alone. Repeated rows stay repeated; an empty table gives no rows; other columns of ``docs``
    are not read.
    """
    counts = materialize(text_counts(docs, key, host, text), "text-counts")
    hosts = host_rates(counts, max_rate, spread, excess).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = counts.withColumn("salt", F.pmod(F.xxhash64("key", *COUNTS), F.lit(salts)).cast("int"))
    base_failed = F.expr(f"({RULES['short']}) OR ({RULES['repetitive']})")
    host_kept = F.coalesce(F.col("host_kept"), F.lit(True))
    return salted.join(hosts.drop("n_docs"), ["host", "salt"], "left").select(
        F.col("key").alias(key),
        *COUNTS,
        base_failed.alias("base_failed"),
        host_kept.alias("host_kept"),
        (~base_failed & host_kept).alias("kept"),
    )
