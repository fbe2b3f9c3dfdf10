"""Near-duplicate documents by bottom-k sketches.

A document is its set of word shingles. One hash function orders all shingles, and the ``k`` smallest
values of a document are its sketch. Inverted lists of the retained values give candidates, the sketch
of a pair's union estimates their similarity, and the full sets decide.

Two documents of similarity 0.75 share about 48 of 64 retained values. Asking for 28 shared values
misses such a pair with a probability below 1e-8, and allows a prefix filter: with values ordered from
rare to frequent, the two must meet in the first ``len - 28 + 1`` values of both. So the values of a
passage that many documents share build lists only for documents that consist of it.

No list is expanded into its pairs. Every member is first compared with the list's most typical member.
That settles groups of copies. What is left are lists with members of several components. Lists with the
same largest component make a cluster; its members outside that component are compared with all members
of other components, block against block. A block counts overlaps by inverted lists of its own, so only
confirmed links leave it. Pairs inside one component need no comparison: more links would not change it. So
no link between components is lost, and copies cost one comparison each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textops as X
from tidemark.llm.components import components
from tidemark.session import materialize

SHINGLE = 5
SKETCH = 64
#: Shared part of the sketches that a candidate needs, far below the similarity asked for.
SHARED = 28 / 64
#: Estimates are off by about 0.05; this is far below 0.75.
ESTIMATE = 0.5
#: Bounds of a block when the members of a cluster are compared.
BLOCK_NODES = 1024
BLOCK_SHINGLES = 1 << 20


def shingle_sets(piece: X.Piece, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each row, as 64-bit hashes."""
    words = piece.words()
    hashes = words.hashes(X.LOWER)
    runs = X.grams(hashes, size)
    out = []
    for low, high in zip(words.bounds[:-1], words.bounds[1:]):
        if high - low >= size:
            own = runs[low : high - size + 1]
        else:
            own = X.grams(hashes[low:high], high - low) if high > low else runs[:0]
        out.append(np.unique(own.view(np.int64)))
    return out


def _sketch_batch(batch: pa.RecordBatch, shingle: int, k: int):
    keys, codes, texts = batch.columns
    for piece in X.pieces(texts):
        sets = shingle_sets(piece, shingle)
        ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        sketches = [s[:k] for s in sets]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sketches])])
        at = slice(piece.first, piece.first + piece.rows)
        yield pa.RecordBatch.from_arrays(
            [
                keys[at],
                codes[at],
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(ids, pa.binary()),
                X.lists(np.concatenate(sketches), bounds),
            ],
            ["key", "code", "n", "set_id", "sketch"],
        )


def sketches(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """Per row: ``key``, ``code`` of the text, set size ``n``, a 128-bit id of the whole set (null if empty), bottom-k sketch."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), _code(text), F.col(text))
    return X.map_text(
        rows,
        lambda batch: _sketch_batch(batch, shingle, k),
        f"key {kind}, code long, n long, set_id binary, sketch array<bigint>",
    )


def _code(text: str) -> Column:
    """A hash that tells apart the texts of one key."""
    return F.xxhash64(F.col(text).cast("string")).alias("code")


def _similar_size(a: str, b: str, percent: int) -> Column:
    """Sizes that allow the similarity at all."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return 100 * small >= percent * large


def _estimated(a: str, b: str, k: int) -> Column:
    """The sketches share enough, and the share of the union's sketch found in both is high enough."""
    x, y = F.col(f"{a}.sketch"), F.col(f"{b}.sketch")
    both = F.array_intersect(x, y)
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, k)
    common = F.size(F.array_intersect(union, both))
    return (F.size(both) >= SHARED * F.least(F.size(x), F.size(y))) & (common >= ESTIMATE * F.size(union))


def _confirm_batch(batch: pa.RecordBatch, shingle: int, percent: int):
    a, b, left, right = batch.columns

    def sets(texts: pa.Array) -> list[np.ndarray]:
        return [s for piece in X.pieces(texts) for s in shingle_sets(piece, shingle)]

    good = []
    for x, y in zip(sets(left), sets(right)):
        same = len(np.intersect1d(x, y, assume_unique=True))
        good.append(100 * same >= percent * (len(x) + len(y) - same) and same > 0)
    mask = pa.array(good, pa.bool_())
    yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, materialized."""
    kind = pairs.schema["a"].dataType.simpleString()
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("right"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    links = X.map_text(both, lambda batch: _confirm_batch(batch, shingle, percent), f"a {kind}, b {kind}")
    return materialize(links, "near-links")


def _overlaps(wanted: np.ndarray, values: np.ndarray, owners: np.ndarray, number: int) -> np.ndarray:
    """How many of the wanted values each owner has, by the inverted lists (``values`` in order)."""
    low, high = np.searchsorted(values, wanted), np.searchsorted(values, wanted, "right")
    size = high - low
    at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return np.bincount(owners[at], minlength=number)


def _postings(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    return values[order], owners[order]


def _compare_blocks(table: pa.Table, k: int, percent: int) -> pa.Table:
    """Links between the two sides of a block, one for each row of the left side and component."""
    kind = table.schema.field("node").type
    sides = []
    for left in (True, False):
        own = table.filter(pc.equal(table["left"], left))
        sets = [np.asarray(x.values) for x in own["shingles"]]
        sides.append((own["node"].to_pylist(), np.asarray(own["component"]), sets))
    (nodes, parts, sets), (others, other_parts, other_sets) = sides
    a, b = [], []
    if sets and other_sets:
        sizes = np.array([len(s) for s in other_sets])
        sketches = np.minimum(sizes, k)
        few, every = _postings([s[:k] for s in other_sets]), _postings(other_sets)
        for node, part, own in zip(nodes, parts, sets):
            possible = (other_parts != part) & (100 * np.minimum(sizes, len(own)) >= percent * np.maximum(sizes, len(own)))
            shared = _overlaps(own[:k], *few, len(others))
            possible &= (shared > 0) & (shared >= SHARED * np.minimum(sketches, min(k, len(own))))
            if not possible.any():
                continue
            same = _overlaps(own, *every, len(others))
            linked = np.flatnonzero(possible & (100 * same >= percent * (sizes + len(own) - same)))
            _, first = np.unique(other_parts[linked], return_index=True)
            a += [node] * len(first)
            b += [others[j] for j in linked[first]]
    return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind)})


def _shingled(batch: pa.RecordBatch, shingle: int):
    keys, texts = batch.columns
    for piece in X.pieces(texts):
        sets = shingle_sets(piece, shingle)
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        at = slice(piece.first, piece.first + piece.rows)
        yield pa.RecordBatch.from_arrays([keys[at], X.lists(np.concatenate(sets), bounds)], ["node", "shingles"])


def _between(open_lists: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, k: int, percent: int) -> DataFrame:
    """Links between components of the same cluster; ``open_lists`` has node, component and main."""
    kind = nodes.schema["node"].dataType.simpleString()
    members = open_lists.select("main", "node", "component").distinct()
    members = materialize(members.join(nodes.select("node", "n"), "node"), "members")
    blocks = members.groupBy("main").agg(F.count("*").alias("number"), F.sum("n").alias("words"))
    number = F.greatest(F.ceil(F.col("number") / BLOCK_NODES), F.ceil(F.col("words") / BLOCK_SHINGLES)).cast("int")
    placed = members.join(blocks.select("main", number.alias("blocks")), "main")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = placed.where("component <> main").select("main", "own", every.alias("other"), "node", "component")
    right = placed.select("main", every.alias("own"), F.col("own").alias("other"), "node", "component")
    cells = left.withColumn("left", F.lit(True)).union(right.withColumn("left", F.lit(False)))

    wanted = members.select(F.col("node").alias("key")).distinct()
    sets = X.map_text(
        texts.join(wanted, "key", "left_semi").select("key", "text"),
        lambda batch: _shingled(batch, shingle),
        f"node {kind}, shingles array<bigint>",
    )
    sets = materialize(sets.dropDuplicates(["node"]), "sets")
    found = cells.join(sets, "node").groupBy("main", "own", "other").applyInArrow(
        lambda table: _compare_blocks(table, k, percent), f"a {kind}, b {kind}"
    )
    return materialize(found, "more-links")


def _lists(nodes: DataFrame) -> DataFrame:
    """Members (value, node, n, weight) of the inverted lists that the prefix filter leaves."""
    members = nodes.select("node", "n", F.size("sketch").alias("len"), F.explode("sketch").alias("value"))
    shared = members.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    # As a table, so that the join can split the documents of a very frequent value.
    shared = materialize(shared, "shared")
    known = members.join(shared, "value")
    # At most k rows a node. Values of a single document come first in the order and count as passed.
    own = Window.partitionBy("node")
    prefix = F.col("len") - F.ceil(SHARED * F.col("len")) + 1 - (F.col("len") - F.count("*").over(own))
    ranked = known.select(
        "value",
        "node",
        "n",
        F.sum("df").over(own).alias("weight"),
        F.row_number().over(own.orderBy("df", "value")).alias("rank"),
        prefix.alias("prefix"),
    )
    return ranked.where("rank <= prefix").drop("rank", "prefix")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = 75,
    shingle: int = SHINGLE,
    k: int = SKETCH,
) -> DataFrame:
    """One row per document: ``key``, ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked if ``100 * intersection >= percent * union``; ``component_id`` is the smallest
    key reachable. Documents without words are linked with nothing. Equal sets are one node, so exact
    copies never meet in a pair. Rows without a key follow an equal set that has one, and are kept alone
    otherwise. Rows that repeat a key are one document; if their texts differ, the one with the smallest hash is its text, and
    all have its component. Other columns are not read, and an empty table gives no rows.
    """
    every = materialize(sketches(docs, key, text, shingle, k), "sketches")
    repeated = every.where("key IS NOT NULL AND set_id IS NOT NULL").groupBy("key").agg(
        F.min("code").alias("first"), F.count("*").alias("copies")
    )
    repeated = materialize(repeated.where("copies > 1").select("key", "first"), "repeated-keys")
    repeats = not repeated.isEmpty()
    rows = every
    if repeats:
        rows = every.join(repeated, "key", "left").where("first IS NULL OR code = first").drop("first")
    classes = rows.where("set_id IS NOT NULL").groupBy("set_id").agg(
        F.min("key").alias("node"), F.count("*").alias("copies")
    )
    classes = materialize(classes, "classes")
    named = classes.where("node IS NOT NULL").select("set_id", F.col("node").alias("key"))
    nodes = rows.join(named, ["set_id", "key"], "left_semi").select(F.col("key").alias("node"), "n", "sketch")
    nodes = materialize(nodes.dropDuplicates(["node"]), "nodes")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if repeats:
        # One text a key, however often its row is repeated.
        again = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), _code(text)).join(repeated, "key")
        once = again.where("code = first").select("key", "text").dropDuplicates(["key"])
        texts = texts.join(repeated, "key", "left_anti").union(once)

    lists = materialize(_lists(nodes), "lists")
    hubs = lists.groupBy("value").agg(F.max_by("node", F.struct("weight", "node")).alias("b"))
    pairs = lists.join(hubs, "value").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    hub_pairs = materialize(pairs, "hub-pairs")
    x, y = nodes.alias("x"), nodes.alias("y")
    likely = (
        hub_pairs.join(x, F.col("a") == F.col("x.node"))
        .join(y, F.col("b") == F.col("y.node"))
        .where(_similar_size("x", "y", percent) & _estimated("x", "y", k))
        .select("a", "b")
    )
    links = _confirmed(likely, texts, shingle, percent)
    found = components(links)

    # Lists whose members are not all in one component yet.
    placed = lists.select("value", "node").join(found, "node", "left")
    placed = placed.select("value", "node", F.coalesce("component", "node").alias("component"))
    sizes = placed.groupBy("value", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("value").agg(
        F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("parts")
    )
    open_lists = materialize(placed.join(largest.where("parts > 1"), "value").drop("parts"), "open-lists")
    if not open_lists.isEmpty():
        more = _between(open_lists, nodes, texts, shingle, k, percent)
        if not more.isEmpty():
            found = components(links.union(more))

    placed = classes.join(found, "node", "left")
    placed = placed.where("copies > 1 OR component IS NOT NULL").select(
        "set_id", F.coalesce("component", "node").alias("component_id")
    )
    out = rows.drop("sketch").join(placed, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("key")).otherwise(F.coalesce("component_id", "key"))
    out = out.select("key", "n", component.alias("component"))
    if repeats:
        # The other texts of a key go where its first one is.
        own = out.join(repeated.select("key"), "key", "left_semi").groupBy("key").agg(F.min("component").alias("component"))
        others = every.join(repeated, "key").where("code <> first")
        out = out.union(others.join(own, "key").select("key", "n", "component"))
    return out.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("key").eqNullSafe(F.col("component")).alias("kept"),
    )
