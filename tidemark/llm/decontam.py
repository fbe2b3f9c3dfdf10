"""Benchmark decontamination with an FM-index per training shard.

Every benchmark item gives windows of ten consecutive words (an item with fewer words is one window).
A task cuts its documents into shards of bounded size and indexes each; all windows are searched
backwards in the index, the occurrences are located, and their words are merged into removal spans.

Only runs of words that occur in some window can hold an occurrence, so a shard indexes those runs. The
windows are handed to the tasks in blocks of at most ``block_windows``; a larger benchmark takes one pass
over the documents per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textops as X
from tidemark.llm.fm_index import FIRST, GAP, FMIndex
from tidemark.session import materialize

WINDOW = 10
BLOCK_WINDOWS = 100_000
#: A shard ends after so many bytes of documents or indexed words.
SHARD_BYTES = 16 << 20
SHARD_WORDS = 1 << 19

# Occurrences so far of each row: first word, number of words, window.
_FOUND = [
    T.StructField("_firsts", T.ArrayType(T.IntegerType())),
    T.StructField("_sizes", T.ArrayType(T.IntegerType())),
    T.StructField("_windows", T.ArrayType(T.LongType())),
]


def _windows_batch(batch: pa.RecordBatch, size: int):
    items, texts = batch.columns
    for piece in X.pieces(texts):
        words = piece.words(X.ALNUM)
        hashes = words.hashes(X.LOWER).view(np.int64)
        out: dict[str, list] = {"item": [], "size": [], "window": [], "words": []}
        for row, (low, high) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
            length = min(size, high - low)
            if not length:
                continue
            runs = np.lib.stride_tricks.sliding_window_view(hashes[low:high], length)
            for run in np.unique(runs, axis=0):
                out["item"].append(items[piece.first + row].as_py())
                out["size"].append(int(length))
                out["window"].append(hashlib.blake2b(run.tobytes(), digest_size=16).digest())
                out["words"].append(run.tolist())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(out["item"], items.type),
                pa.array(out["size"], pa.int32()),
                pa.array([int.from_bytes(w[:8], "little", signed=True) for w in out["window"]], pa.int64()),
                pa.array(out["words"], pa.list_(pa.int64())),
            ],
            ["item", "size", "window", "words"],
        )


def windows(benchmark: DataFrame, key: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """The windows (item, size, window id, word hashes) of every item that has a word."""
    kind = benchmark.schema[key].dataType.simpleString()
    return X.map_text(
        benchmark.select(F.col(key).alias("item"), F.col(text)),
        lambda batch: _windows_batch(batch, size),
        f"item {kind}, size int, window bigint, words array<bigint>",
    )


@dataclass
class Block:
    """A bounded part of the windows, with their words as ranks in ``vocabulary``."""

    vocabulary: np.ndarray
    maybe: np.ndarray
    phrases: list[tuple[np.ndarray, np.ndarray]]

    @property
    def shortest(self) -> int:
        return min((p.shape[1] for _, p in self.phrases), default=1)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """``FIRST`` plus the rank of each word, or ``GAP`` for words in no window."""
        out = np.full(len(hashes), GAP, np.int64)
        some = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        known = hashes[some]
        rank = np.searchsorted(self.vocabulary, known)
        rank[rank == len(self.vocabulary)] = 0
        same = self.vocabulary[rank] == known
        out[some[same]] = rank[same] + FIRST
        return out


def _block(rows: list) -> Block:
    vocabulary = np.unique(np.array([w for r in rows for w in r["words"]], np.int64).view(np.uint64))
    maybe = np.zeros(1 << 16, bool)
    maybe[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    phrases = []
    for size in sorted({r["size"] for r in rows}):
        own = [r for r in rows if r["size"] == size]
        words = np.array([r["words"] for r in own], np.int64).view(np.uint64)
        phrases.append(
            (np.array([r["window"] for r in own], np.int64), np.searchsorted(vocabulary, words) + FIRST)
        )
    return Block(vocabulary, maybe, phrases)


def blocks(found: DataFrame, block_windows: int = BLOCK_WINDOWS) -> Iterator[tuple[Block, bool]]:
    """The distinct windows in blocks, and whether a block is the last; each reaches the driver alone and is of bounded size."""
    distinct = found.select("size", "window", "words").dropDuplicates(["window"])
    distinct = materialize(distinct, "windows")
    total = distinct.count()
    number = max(1, -(-total // block_windows))
    part = F.pmod(F.xxhash64("window"), F.lit(number))
    for k in range(number):
        yield _block(distinct.where(part == k).collect()), k == number - 1


class Shard:
    """Documents of one index: words that may match, and where they stand."""

    def __init__(self, block: Block):
        self.block = block
        self.batches: list[pa.RecordBatch] = []
        self.counts: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = self.bytes = self.words = 0

    def add(self, batch: pa.RecordBatch, texts: pa.Array) -> None:
        gap = np.array([GAP]), np.array([-1]), np.array([-1])
        for piece in X.pieces(texts):
            words = piece.words(X.ALNUM)
            symbols = self.block.symbols(words.hashes(X.LOWER))
            rows = words.row()
            known = symbols != GAP
            # Runs of words that occur in windows, within a row and long enough for one.
            edge = np.ones(len(known) + 1, bool)
            edge[1:-1] = (rows[1:] != rows[:-1]) | (known[1:] != known[:-1])
            starts = np.flatnonzero(edge)
            starts, ends = starts[:-1], starts[1:]
            good = (
                known[starts] & (ends - starts >= self.block.shortest) if len(known) else np.empty(0, bool)
            )
            for s, e in zip(starts[good], ends[good]):
                word = np.arange(s, e) - words.bounds[rows[s]]
                self.parts += [(symbols[s:e], rows[s:e] + self.rows, word), gap]
                self.words += e - s + 1
            self.rows += piece.rows
            self.counts.append(words.counts)
        self.batches.append(batch)
        self.bytes += batch.nbytes

    @property
    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or self.words >= SHARD_WORDS

    def occurrences(self) -> dict[int, list[tuple[int, int, int]]]:
        """By row: first word, number of words and window of each occurrence."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        if not self.parts:
            return found
        symbols, rows, word = (np.concatenate(x) for x in zip(*self.parts))
        index = FMIndex(symbols)
        for ids, phrases in self.block.phrases:
            low, high = index.search(phrases)
            number = high - low
            which = np.repeat(np.arange(len(ids)), number)
            within = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
            at = index.locate(low[which] + within)
            size = phrases.shape[1]
            for row, first, window in zip(rows[at].tolist(), word[at].tolist(), ids[which].tolist()):
                found.setdefault(row, []).append((first, size, window))
        return found


def _sharded(block: Block, column: int, emit: Callable) -> Callable:
    """A ``mapInArrow`` function: ``emit`` makes an output batch of a batch, its counts and occurrences."""

    def flush(shard: Shard):
        found, counts, row = shard.occurrences(), np.concatenate([[], *shard.counts]), 0
        for batch in shard.batches:
            own = [found.get(row + k, []) for k in range(len(batch))]
            yield emit(batch, counts[row : row + len(batch)], own)
            row += len(batch)

    def run(batches):
        shard = Shard(block)
        for batch in batches:
            shard.add(batch, batch.column(column))
            if shard.full:
                yield from flush(shard)
                shard = Shard(block)
        yield from flush(shard)

    return run


def _cover(occurrences: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Merged ranges of words inside occurrences; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for first, size, _ in sorted(occurrences):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], first + size)
        else:
            out.append((first, first + size))
    return out


def _char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets from the first to the last word of each range."""
    (piece,) = X.pieces(pa.array([text], pa.large_string()), 1 << 62)
    words, raw = piece.words(X.ALNUM), piece.data.tobytes()
    chars = lambda at: len(raw[:at].decode())
    return [(chars(words.starts[a]), chars(words.ends[b - 1])) for a, b in ranges]


def _earlier(batch: pa.RecordBatch, row: int, width: int) -> list[tuple[int, int, int]]:
    """Occurrences that earlier blocks have found, from the columns after the first ``width``."""
    return list(zip(*(column[row].as_py() for column in batch.columns[width:])))


def _collect(width: int, names: list[str]) -> Callable:
    """Add the occurrences of a block to the columns after the first ``width``."""

    def emit(batch: pa.RecordBatch, counts: np.ndarray, found: list) -> pa.RecordBatch:
        every = [_earlier(batch, k, width) + own for k, own in enumerate(found)]
        columns = [[[o[k] for o in own] for own in every] for k in range(3)]
        arrays = [pa.array(c, pa.list_(t)) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*batch.columns[:width], *arrays], names)

    return emit


def _through(rows: DataFrame, found: DataFrame, block_windows: int, at: int) -> tuple[DataFrame, Block]:
    """``rows`` with the occurrences of all blocks but the last in three more columns, and the last block.

    One block at a time is on the driver: with several, the rows are written once per block before the next one comes.
    """
    width = len(rows.columns)
    for block, last in blocks(found, block_windows):
        if last:
            return rows, block
        schema = T.StructType([*rows.schema.fields[:width], *_FOUND])
        rows = materialize(rows.mapInArrow(_sharded(block, at, _collect(width, schema.names)), schema), "searched")
        del block
    raise AssertionError("there is always a last block")


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def _report(batch: pa.RecordBatch, counts: np.ndarray, found: list) -> pa.RecordBatch:
    texts = batch.column(1)
    hit, spans, ids, digests = [], [], [], []
    for row, own in enumerate(found):
        own = _earlier(batch, row, 2) + own
        ranges = _cover(own)
        hit.append(sum(b - a for a, b in ranges))
        spans.append(
            [{"start": a, "end": b} for a, b in _char_spans(texts[row].as_py(), ranges)] if own else []
        )
        windows_hit = np.unique(np.array([o[2] for o in own], np.int64))
        ids.append(windows_hit.tolist())
        digests.append(hashlib.blake2b(windows_hit.tobytes(), digest_size=16).digest() if own else None)
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array(counts.astype(np.int64)),
            pa.array(hit, pa.int64()),
            pa.array(spans, pa.list_(_SPAN)),
            pa.array(ids, pa.list_(pa.int64())),
            pa.array(digests, pa.binary()),
        ],
        ["key", "n_words", "n_hit", "spans", "windows", "hit_set"],
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per document: ``n_words``, ``n_hit`` words inside occurrences, removal ``spans`` (character
    offsets), and ``items``, the sorted text ids of the items with an occurring window.

    Null and empty texts have no words; items without words match nothing; an empty benchmark finds
    nothing. Repeated rows stay repeated, and no other column is read.
    """
    found = materialize(windows(benchmark, item, item_text, size), "item-windows")
    kind = docs.schema[key].dataType.simpleString()
    X.small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows, block = _through(rows, found, block_windows, 1)
    hits = rows.mapInArrow(
        _sharded(block, 1, _report),
        f"key {kind}, n_words long, n_hit long, spans array<struct<start:int,end:int>>, "
        "windows array<bigint>, hit_set binary",
    )
    hits = materialize(hits, "hits")

    # Documents with the same windows have the same items, so each set of windows is looked up once.
    sets = hits.where("n_hit > 0").groupBy("hit_set").agg(F.first("windows").alias("windows"))
    items = (
        sets.select("hit_set", F.explode("windows").alias("window"))
        .join(found.select("window", F.col("item").cast("string").alias("item")), "window")
        .groupBy("hit_set")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    columns = [F.col("key").alias(key), "n_words", "n_hit", "spans"]
    none = F.array().cast("array<string>").alias("items")
    clean = hits.where("n_hit = 0").select(*columns, none)
    return hits.where("n_hit > 0").join(items, "hit_set").select(*columns, "items").union(clean)


def scrub(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``docs`` with every removal span cut out of its text; rows without one pass unchanged.

    Null and empty texts stay what they are, repeated rows stay repeated, other columns are kept as they are, and an empty
    table or benchmark changes nothing.
    """
    found = materialize(windows(benchmark, item, item_text, size), "item-windows")
    X.small_batches(docs.sparkSession)
    at, width = docs.columns.index(text), len(docs.columns)

    def cut(batch: pa.RecordBatch, counts: np.ndarray, hits: list) -> pa.RecordBatch:
        every = [_earlier(batch, row, width) + own for row, own in enumerate(hits)]
        kept = pa.RecordBatch.from_arrays(batch.columns[:width], batch.schema.names[:width])
        if not any(every):
            return kept
        texts, kind = batch.column(at).to_pylist(), batch.column(at).type
        for row, own in enumerate(every):
            for a, b in reversed(_char_spans(texts[row], _cover(own)) if own else []):
                texts[row] = texts[row][:a] + texts[row][b:]
        return kept.set_column(at, batch.schema.names[at], pa.array(texts, kind))

    schema = docs.schema
    rows, block = _through(docs, found, block_windows, at)
    return rows.mapInArrow(_sharded(block, at, cut), schema)
