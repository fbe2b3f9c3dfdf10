"""Passages that repeat across documents, by sparse suffix arrays.

Suffixes are retained at minimisers: positions whose run of ``GRAM`` words has the smallest hash in some
window of ``WINDOW`` positions. Equal passages choose equal positions, and every passage of ``LEAST`` words
holds a retained suffix at most ``SIDE`` words after its start, so at least ``SEED`` words of it follow.

Only suffixes whose first ``SEED`` words occur in another document go on. Those that also agree in
``SIDE`` words on either side are settled by grouping: in sorted order they would be neighbours. The others are
sorted by what follows, range-partitioned so that a frequent passage spreads over tasks, neighbours are
compared, and matches are extended left and right. A suffix may match a third one better on the left than
its neighbours; where a seed has more than two of these suffixes, all windows of ``LEAST`` words around it
are counted. No step looks at pairs other than neighbours. Seeds and contexts of very many documents are
dealt over many tasks wherever suffixes are joined on them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops as X
from tidemark.llm.spread import spread_join
from tidemark.session import materialize

LEAST = 50
SIDE = 20
SEED = LEAST - SIDE
WINDOW = SIDE + 1
GRAM = 5
_STEP = np.uint64(0x9FB21C651E98DF25)


def _slide(values: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """The best value of every window of ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values, size = best(values[:-size], values[size:]), 2 * size
    rest = width - size
    return best(values[:-rest], values[rest:]) if rest else values


def minimisers(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Retained positions; windows do not cross rows."""
    runs = X.grams(hashes, GRAM)
    if len(runs) < WINDOW:
        return np.empty(0, np.int64)
    least = _slide(runs, WINDOW, np.minimum)
    reach = WINDOW + GRAM - 2
    least[rows[: len(least)] != rows[reach : reach + len(least)]] = 0
    none = np.zeros(WINDOW - 1, np.uint64)
    most = _slide(np.concatenate([none, least, none]), WINDOW, np.maximum)
    return np.flatnonzero((most == runs) & (runs != 0))


def _around(hashes: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, steps) -> np.ndarray:
    """One hash of the words at ``at`` + each step; words outside ``low`` to ``high`` count as missing."""
    total = np.zeros(len(at), np.uint64)
    for step in steps:
        where = at + step
        inside = (where >= low) & (where < high)
        total = total * _STEP + np.where(inside, hashes[np.clip(where, 0, len(hashes) - 1)], np.uint64(0))
    return X.mix(total)


def _suffix_batch(batch: pa.RecordBatch):
    keys, texts = batch.columns
    for piece in X.pieces(texts):
        words = piece.words()
        hashes, rows = words.hashes(), words.row()
        at = minimisers(hashes, rows)
        low, high = words.bounds[rows[at]], words.bounds[rows[at] + 1]
        good = at + SEED <= high
        at, low, high = at[good], low[good], high[good]
        seeds = _around(hashes, at, low, high, range(SEED))
        around = _around(hashes, at, low, high, range(-SIDE, SEED + SIDE))
        bounds = np.searchsorted(at, words.bounds)
        digests = [
            hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest()
            for a, b in zip(words.bounds[:-1], words.bounds[1:])
        ]
        yield pa.RecordBatch.from_arrays(
            [
                keys[piece.first : piece.first + piece.rows],
                pa.array(digests, pa.binary()),
                pa.array(words.counts, pa.int64()),
                X.lists((at - low).astype(np.int32), bounds),
                X.lists(seeds.view(np.int64), bounds),
                X.lists(around.view(np.int64), bounds),
            ],
            ["key", "digest", "n_words", "at", "seed", "around"],
        )


def _context_batch(batch: pa.RecordBatch):
    """The words on either side of the wanted seeds, nearest first, as hashes."""
    keys, texts, wanted = batch.columns
    offsets, flat = np.asarray(wanted.offsets), wanted.values
    for piece in X.pieces(texts):
        words = piece.words()
        hashes = words.hashes().view(np.int64)
        out: list[list] = [[], [], [], [], []]
        for row in range(piece.rows):
            k = piece.first + row
            low, high = words.bounds[row], words.bounds[row + 1]
            own = flat.slice(offsets[k], offsets[k + 1] - offsets[k])
            for at, seed in zip(own.field("at").to_pylist(), own.field("seed").to_pylist()):
                p = low + at
                out[0].append(keys[k].as_py())
                out[1].append(at)
                out[2].append(seed)
                out[3].append(hashes[max(low, p - SIDE) : p][::-1])
                out[4].append(hashes[p + SEED : min(high, p + SEED + SIDE)])
        types = (keys.type, pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, types)], ["key", "at", "seed", "left", "right"]
        )


def _common(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _compare(rows) -> list[tuple]:
    """Matches of neighbours in an ordered run of (key, at, seed, left, right): key, at, left, right, other."""
    out, last = [], None
    for row in rows:
        if last and last[2] == row[2] and last[0] != row[0]:
            left, right = _common(last[3], row[3]), _common(last[4], row[4])
            if left + right >= LEAST - SEED:
                out += [(last[0], last[1], left, right, row[0]), (row[0], row[1], left, right, last[0])]
        last = row
    return out


def _neighbours(suffixes: DataFrame, kind: str) -> DataFrame:
    """Matches (key, at, left, right, other) of suffixes that are neighbours in sorted order."""
    order = ["seed", "right", "left", "key", "at"]
    columns = ["key", "at", "seed", "left", "right"]
    schema = (
        f"key {kind}, at int, seed long, left array<bigint>, right array<bigint>, n_left int, n_right int, "
        f"other {kind}, part int"
    )

    def run(batches):
        part, first, last, key_type = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            key_type = batch.schema.field(0).type
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            found = _compare(([last] if last else []) + rows)
            first = first or rows[0]
            last = rows[-1]
            yield emit([(k, at, None, None, None, a, b, o, None) for k, at, a, b, o in found], key_type)
        if first:
            # The ends of this partition, to be compared with those of its neighbours.
            yield emit([(*row, None, None, None, 2 * part + end) for end, row in enumerate((first, last))], key_type)

    def emit(rows: list, key_type: pa.DataType) -> pa.RecordBatch:
        longs = pa.list_(pa.int64())
        types = (
            key_type, pa.int32(), pa.int64(), longs, longs, pa.int32(), pa.int32(), key_type, pa.int32()
        )
        columns = list(zip(*rows)) or [[] for _ in types]
        names = [f.split()[0] for f in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    ranged = suffixes.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    compared = materialize(ranged.mapInArrow(run, schema), "neighbours")
    names = ["key", "at", F.col("n_left").alias("left"), F.col("n_right").alias("right"), "other"]
    found = compared.where("part IS NULL").select(*names)

    # Two rows for each partition: the last of one and the first of the next.
    ends = compared.where("part IS NOT NULL").select(*columns, "part")
    ends = ends.withColumn("pair", F.floor((F.col("part") + 1) / 2)).repartition("pair").sortWithinPartitions("part")

    def across(batches):
        pairs: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                pairs.setdefault(row[-1], []).append(row[:5])
            key_type = batch.schema.field(0).type
        rows = [m for run in pairs.values() if len(run) == 2 for m in _compare(run)]
        if rows:
            types = (key_type, pa.int32(), pa.int32(), pa.int32(), key_type)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], ["key", "at", "left", "right", "other"]
            )

    met = ends.select(*columns, "pair").mapInArrow(across, f"key {kind}, at int, left int, right int, other {kind}")
    return found.union(met)


def _windows(suffixes: DataFrame) -> DataFrame:
    """Matches of windows of ``LEAST`` words: one for each number of words left of the seed."""
    d = F.col("d")
    each = suffixes.select("key", "at", "seed", "left", "right", F.explode(F.sequence(F.lit(0), F.lit(SIDE))).alias("d"))
    each = each.where((F.size("left") >= d) & (F.size("right") >= SIDE - d))
    code = F.xxhash64("seed", "d", F.slice("left", F.lit(1), d), F.slice("right", F.lit(1), SIDE - d))
    each = each.select("key", "at", "d", "seed", code.alias("code"))
    both = each.groupBy("seed", "code").agg(
        F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("copies")
    )
    both = materialize(both.where("lo <> hi"), "windows")
    return spread_join(each, both, ["seed", "code"], ["key", "at"]).select(
        "key",
        "at",
        d.alias("left"),
        (SIDE - d).alias("right"),
        F.when(F.col("lo") == F.col("key"), F.col("hi")).otherwise(F.col("lo")).alias("other"),
    )


def _merge_batch(batch: pa.RecordBatch):
    keys, lists, others = batch.columns
    spans, numbers = [], []
    for own in lists.to_pylist():
        out: list[list[int]] = []
        for span in sorted((s["start"], s["end"]) for s in own):
            if out and span[0] <= out[-1][1]:
                out[-1][1] = max(out[-1][1], span[1])
            else:
                out.append(list(span))
        spans.append([{"start": a, "end": b} for a, b in out])
        numbers.append(sum(b - a for a, b in out))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    yield pa.RecordBatch.from_arrays(
        [keys, pa.array(numbers, pa.int64()), pa.array(spans, kind), others], ["key", "n", "spans", "other"]
    )


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with a passage of at least ``LEAST`` words that another document has too.

    Returns ``key``, ``n_words``, ``n_repeat_words``, ``spans`` (word positions, end exclusive) and
    ``partner``, the smallest other document found to share a passage. Words are separated by ASCII white
    space and compared as they are, by 64-bit hashes. Texts of equal words are one text: its copies have
    one span from end to end if it is long enough. Null, empty and shorter texts have no row, and so have
    passages that repeat inside one document only. Rows without a key are left out.
    """
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = (
        f"key {kind}, digest binary, n_words long, at array<int>, seed array<bigint>, around array<bigint>"
    )
    rows = materialize(X.map_text(docs, _suffix_batch, schema), "suffix-lists")
    rows = rows.where(F.col("n_words") >= LEAST)
    texts = rows.groupBy("digest").agg(
        F.min("key").alias("lo"), F.max("key").alias("hi"), F.first("n_words").alias("n_words")
    )
    texts = materialize(texts, "texts")
    own = rows.join(texts.select("digest", F.col("lo").alias("key")), ["digest", "key"], "left_semi")
    own = own.dropDuplicates(["key"])
    suffixes = own.select("key", F.explode(F.arrays_zip("at", "seed", "around")).alias("s")).select("key", "s.*")

    copies = F.count("*").alias("copies")
    seeds = suffixes.groupBy("seed").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), copies)
    seeds = materialize(seeds.where("lo <> hi").select("seed", "copies"), "seeds")
    candidates = materialize(spread_join(suffixes, seeds, ["seed"], ["key", "at"]), "candidates")
    alike = candidates.groupBy("seed", "around").agg(
        F.min("key").alias("lo"), F.max("key").alias("hi"), F.min_by("at", F.struct("key", "at")).alias("lo_at"), copies
    )
    alike = materialize(alike, "alike")
    groups = alike.where("lo <> hi")
    lengths = texts.select(F.col("lo").alias("key"), "n_words")
    context = ["seed", "around"]
    settled = spread_join(candidates, groups.select(*context, "lo", "hi", "copies"), context, ["key", "at"])
    settled = settled.join(lengths, "key").select(
        "key",
        "at",
        F.least(F.col("at"), F.lit(SIDE)).alias("left"),
        F.least(F.col("n_words") - F.col("at") - SEED, F.lit(SIDE)).cast("int").alias("right"),
        F.when(F.col("lo") == F.col("key"), F.col("hi")).otherwise(F.col("lo")).alias("other"),
    )
    # Contexts cut short by both ends of their texts do not make a passage.
    settled = settled.where(F.col("left") + F.col("right") >= LEAST - SEED)

    # The rest, and one suffix of each settled group with the same seed to compare it with.
    first = [F.col("lo").alias("key"), F.col("lo_at").alias("at"), "seed"]
    single = alike.where("lo = hi")
    # A context that one document has several times: all its places are wanted.
    again = single.where("copies > 1").select(*context, "copies")
    again = spread_join(candidates, again, context, ["key", "at"]).select("key", "at", "seed")
    mixed = alike.groupBy("seed").agg(F.count_if(F.col("lo") != F.col("hi")).alias("copies"), F.count_if(F.col("lo") == F.col("hi")).alias("singles"))
    mixed = materialize(mixed.where("copies > 0 AND singles > 0").select("seed", "copies"), "mixed-seeds")
    compared = spread_join(groups.drop("copies"), mixed, ["seed"], ["around"]).select(*first)
    wanted = single.where("copies = 1").select(*first).union(again).union(compared)
    wanted = wanted.groupBy("key").agg(F.collect_list(F.struct("at", "seed")).alias("wanted"))
    rest = X.map_text(
        docs.join(wanted, "key").select("key", "text", "wanted"),
        _context_batch,
        f"key {kind}, at int, seed long, left array<bigint>, right array<bigint>",
    )
    rest = materialize(rest, "contexts")
    near = materialize(_neighbours(rest, kind), "matches")
    # Two suffixes are neighbours; of more, any two may share most on the left.
    many = materialize(rest.groupBy("seed").agg(copies).where("copies > 2"), "many")
    counted = _windows(spread_join(rest, many, ["seed"], ["key", "at"]))

    found = settled.union(near).union(counted)
    found = found.select(
        "key",
        F.struct(
            (F.col("at") - F.col("left")).cast("int").alias("start"),
            (F.col("at") + SEED + F.col("right")).cast("int").alias("end"),
        ).alias("span"),
        "other",
    )
    spans = found.groupBy("key").agg(F.collect_set("span").alias("spans"), F.min("other").alias("other"))
    merged = X.map_text(
        spans,
        _merge_batch,
        f"key {kind}, n long, spans array<struct<start:int,end:int>>, other {kind}",
    )
    placed = texts.join(merged.withColumnRenamed("key", "lo"), "lo", "left")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    copied = F.col("lo") != F.col("hi")
    placed = placed.where(copied | F.col("n").isNotNull()).select(
        "digest",
        "lo",
        "hi",
        F.when(copied, F.col("n_words")).otherwise(F.col("n")).alias("n_repeat_words"),
        F.when(copied, whole).otherwise(F.col("spans")).alias("spans"),
        "other",
    )
    partner = F.when(F.col("lo") < F.col("key"), F.col("lo")).when(F.col("hi") > F.col("key"), F.col("hi"))
    return rows.select("key", "digest", "n_words").join(placed, "digest").select(
        F.col("key").alias(key),
        "n_words",
        "n_repeat_words",
        "spans",
        F.least("other", partner).alias("partner"),
    )
