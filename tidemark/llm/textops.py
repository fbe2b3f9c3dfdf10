"""Words, lines and their 64-bit hashes of Arrow text columns, in NumPy.

All operators that look at words use these helpers inside ``mapInArrow``. A column is taken in
pieces of about ``PIECE`` bytes, so the working memory of a task does not depend on the batch. Bytes
are classed by a table of 256 entries; every byte of a multi-byte UTF-8 character is at least 0x80,
so classes of ASCII characters can be told apart without decoding.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

PIECE = 1 << 19
BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_U64 = np.uint64

_BYTES = np.arange(256)
#: Words between ASCII white space: space and 0x09-0x0D.
SPACED = ~np.isin(_BYTES, [0x20, 9, 10, 11, 12, 13])
#: Words of ASCII letters and digits and everything beyond ASCII.
ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
SAME = _BYTES.astype(np.uint8)
#: A-Z to a-z.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)

# Documents handed to Python at once. Rows can be long, so few of them make a batch.
BATCH_ROWS = "256"
_ROOT = str(Path(__file__).resolve().parents[2])


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python in small batches: their texts may be long.

    Workers that share the driver's disk also find this package where the driver has found it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def map_text(df: DataFrame, run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with one function per batch, in small batches."""
    small_batches(df.sparkSession)

    def over(batches):
        for batch in batches:
            yield from run(batch)

    return df.mapInArrow(over, schema)


@dataclass
class Piece:
    """Some rows of a text column: their bytes, end to end, and where each row starts."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each row are set in ``mask``."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return np.diff(total[self.offsets])

    def spans(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs set in ``mask``; no run goes beyond its row."""
        edge = np.zeros(len(mask) + 1, bool)
        edge[self.offsets] = True
        padded = np.concatenate([[False], mask, [False]])
        starts = np.flatnonzero(mask & (~padded[:-2] | edge[:-1]))
        ends = np.flatnonzero(mask & (~padded[2:] | edge[1:])) + 1
        return starts, ends

    def words(self, kind: np.ndarray = SPACED) -> Words:
        starts, ends = self.spans(kind[self.data])
        return Words(self, starts, ends, np.searchsorted(starts, self.offsets))

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the lines that newline characters separate, rows without text too."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]))
        ends = np.sort(np.concatenate([self.offsets[1:], breaks]))
        return starts, ends


@dataclass
class Words:
    """Words of a piece: byte spans, and ``bounds``, where each row's words start."""

    piece: Piece
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.piece.rows), self.counts)

    def hashes(self, letters: np.ndarray = SAME) -> np.ndarray:
        return hash_spans(self.piece.data, self.starts, self.ends, letters)


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[Piece]:
    """The rows of a string column in pieces of about ``size`` bytes; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size)))
        last = min(last, len(column))
        at = offsets[first : last + 1]
        yield Piece(first, data[at[0] : at[-1]], at - at[0])
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all others."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _powers(base: int) -> np.ndarray:
    steps = np.full(2 * BLOCK + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


_TABLES: list[np.ndarray] = []


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending byte spans after mapping each byte by ``letters``.

    A running polynomial over the bytes gives the hash of any span by one subtraction. Spans above
    ``BLOCK`` bytes take a digest instead, so that no table grows with a word.
    """
    if not _TABLES:
        _TABLES.extend((_powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))))
    up, down = _TABLES
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        low = int(starts[i])
        if ends[i] - low > BLOCK:
            digest = hashlib.blake2b(letters[data[low : ends[i]]].tobytes(), digest_size=8).digest()
            out[i] = np.frombuffer(digest, np.uint64)[0]
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        part = letters[data[low : ends[j - 1]]].astype(np.uint64) + _U64(1)
        total = np.concatenate([[_U64(0)], np.cumsum(part * up[: len(part)])])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbouring values, in order; empty if there are fewer."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:size].copy()
    for k in range(1, n):
        total *= _STEP
        total += hashes[k : k + size]
    return mix(total)


def repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(values)
    ranked = values[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(values), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def in_row(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values that differ where their rows differ."""
    return mix(values + rows.astype(np.uint64) * _U64(0xA24BAED4963EE407))


def per_range(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set in each of the ranges that ``bounds`` separates."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[bounds])


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """A list column whose row i holds ``values[bounds[i]:bounds[i + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))
