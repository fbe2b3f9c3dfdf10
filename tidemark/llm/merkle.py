"""A Merkle tree over the rows of a table, and proofs that climb it by a recursive query.

Every row is a leaf. The leaves of a group (a source) make a tree of runs of three, and the roots of all
groups, in the order of their names, make the tree above them. The levels are built ``STRIDE`` at a time:
the 3 ** STRIDE neighbours that meet within these levels are one bounded row, inside which the levels
are arrays. What is stored is one row per node with the siblings on its way up and the address of the node
where that way ends, so a proof follows the addresses: a recursive query starts at each leaf, meets
one stored node a step, appends the siblings and folds them into the hash that it carries.

Positions come from range-sorted chunks and the numbers of rows before each chunk, so that a group with most
of the rows is spread over many tasks. A step of the query moves one narrow row per leaf; the stored rows it
meets shrink by 3 ** STRIDE each time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

FAN = 3
#: Levels that a stored row leads up.
STRIDE = 6
#: The tree of the groups' roots; a group's own tree is named by "" or "=" and its name.
TOP = "^"


def digest(content: Column) -> Column:
    """The sha256 of a string or of bytes, as 32 bytes."""
    return F.unhex(F.sha2(content, 256))


def _node(children: Column) -> Column:
    """The hash over the hex texts of joined 32-byte digests."""
    return digest(F.lower(F.hex(children)))


def as_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_hash(columns: Sequence[Column]) -> Column:
    """The hash of a row: of each value its number of UTF-8 bytes, a colon and itself, or ``-`` for null."""
    parts = []
    for value in columns:
        text = value.cast("string")
        sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(sized, F.lit("-")))
    return digest(F.concat(*parts))


def _placed(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``at``, the position in their tree by ``order``, and ``size``, the rows of the tree."""
    order = ["tree", *order]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written once: a row's chunk and place in it must be the same whenever they are read.
    ranged = materialize(ranged.withColumn("place", F.monotonically_increasing_id()), name)
    chunk = F.shiftright("place", 33).alias("chunk")
    chunks = ranged.groupBy("tree", chunk).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    # One row for each tree and chunk it lies in.
    every, before = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("chunk")
    chunks = chunks.select(
        F.col("tree").alias("t"),
        F.col("chunk").alias("c"),
        (F.sum("n").over(before) - F.col("n") - F.col("first")).alias("shift"),
        F.sum("n").over(every).alias("size"),
    )
    found = ranged.join(chunks, (F.col("tree") == F.col("t")) & (F.shiftright("place", 33) == F.col("c")))
    return found.withColumn("at", F.col("place") + F.col("shift")).drop("t", "c", "shift", "place")


def _sides(level: Column, at: Column) -> Column:
    """The siblings left and right of position ``at`` in a level of 32-byte digests."""
    nth = at % FAN
    part = lambda k, wanted: F.when(wanted, F.coalesce(F.get(level, at - nth + k), F.expr("X''"))).otherwise(F.expr("X''"))
    left = [part(k, nth > k) for k in range(FAN - 1)]
    right = [part(k, nth < k) for k in range(1, FAN)]
    return F.struct(F.concat(*left).alias("left"), F.concat(*right).alias("right"))


def _above(level: Column, alone: Column) -> Column:
    """The next level of an array of digests; a single digest stays if its tree has no other."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(level) / FAN).cast("int") - 1)
    child = lambda run, k: F.coalesce(F.get(level, run * FAN + k), F.expr("X''"))
    made = F.transform(runs, lambda run: _node(F.concat(*[child(run, k) for k in range(FAN)])))
    return F.when(alone & (F.size(level) == 1), level).otherwise(made)


def _blocks(nodes: DataFrame, carried: Sequence[str], stride: int, name: str) -> DataFrame:
    """Blocks of neighbours: ``top`` is the digest above all of them, ``members`` have the ``path`` up to it.

    ``nodes`` has tree, at, size and digest. A block is a tree's last if it holds the whole tree.
    """
    width = FAN**stride
    member = F.struct("at", "digest", *carried)
    blocks = nodes.groupBy("tree", F.floor(F.col("at") / width).alias("block")).agg(
        F.array_sort(F.collect_list(member)).alias("own"),
        F.first("size").alias("size"),
    )
    blocks = blocks.withColumn("last", F.col("size") <= width)
    blocks = blocks.withColumn("level0", F.transform("own", lambda m: m["digest"]))
    for k in range(stride):
        blocks = blocks.withColumn(f"level{k + 1}", _above(F.col(f"level{k}"), F.col("last")))
    # Levels with siblings to fold; the last block ends as soon as one node is left.
    steps = F.lit(0)
    for k in range(stride):
        steps = steps + F.when(~F.col("last") | (F.size(f"level{k}") > 1), 1).otherwise(0)

    def with_path(m: Column) -> Column:
        place = (m["at"] % width).cast("int")
        path = [_sides(F.col(f"level{k}"), F.floor(place / FAN**k).cast("int")) for k in range(stride)]
        return F.struct(
            m["at"].alias("at"),
            m["digest"].alias("digest"),
            *[m[c].alias(c) for c in carried],
            F.slice(F.array(*path), F.lit(1), F.col("steps")).alias("path"),
        )

    blocks = blocks.withColumn("steps", steps).select(
        "tree",
        "block",
        "size",
        "last",
        F.element_at(f"level{stride}", 1).alias("top"),
        F.transform("own", with_path).alias("members"),
    )
    return materialize(blocks, name)


def _levels(leaves: DataFrame, carried: Sequence[str], stride: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks round by round until every tree is one node, and these nodes (tree, digest)."""
    width, rounds, roots = FAN**stride, [], []
    nodes = leaves
    while True:
        blocks = _blocks(nodes, carried if not rounds else [], stride, "tree-blocks")
        rounds.append(blocks)
        roots.append(blocks.where("last").select("tree", F.col("top").alias("digest")))
        going_on = blocks.where("NOT last")
        if going_on.isEmpty():
            break
        nodes = going_on.select(
            "tree",
            F.col("block").alias("at"),
            F.ceil(F.col("size") / width).alias("size"),
            F.col("top").alias("digest"),
        )
    found = roots[0]
    for more in roots[1:]:
        found = found.union(more)
    return rounds, found


@dataclass
class Manifest:
    """A built tree.

    ``leaves``: tree, ``leaf``, the carried columns, and the first part of the way up. ``nodes``: the stored nodes
    with the rest of it. A way is its ``path`` of siblings and the address (``up_tree``, ``up_round``,
    ``up_at``) of the node where it ends, null at the root. ``subroots``: tree and digest of each group.
    ``root``: one row, or none for an empty table.
    """

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: DataFrame


def _ways(blocks: DataFrame, number: int, stride: int, places: DataFrame | None) -> DataFrame:
    """The members of a round's blocks with their addresses: in their own tree, or in that of the groups."""
    rows = blocks.select("tree", "block", "last", F.inline("members"))
    up = rows
    if places is not None:
        up = rows.join(places, "tree")
        ends = F.struct(F.lit(TOP).alias("up_tree"), F.lit(0).alias("up_round"), F.col("place").alias("up_at"))
    else:
        none = {"up_tree": "string", "up_round": "int", "up_at": "long"}
        ends = F.struct(*[F.lit(None).cast(kind).alias(name) for name, kind in none.items()])
    on = F.struct(F.col("tree").alias("up_tree"), F.lit(number + 1).alias("up_round"), F.col("block").alias("up_at"))
    up = up.withColumn("way", F.when(F.col("last"), ends).otherwise(on)).withColumn("round", F.lit(number))
    return up.drop("block", "last", *(["place"] if places is not None else [])).select("*", "way.*").drop("way")


def build(
    docs: DataFrame,
    columns: Sequence[str],
    key: str,
    group: str,
    carried: Mapping[str, Column] | None = None,
    stride: int = STRIDE,
) -> Manifest:
    """Hash every row over ``columns``, and the tree over all of them.

    Within a group rows ascend by ``key`` (null first), rows of one key by their hash. Groups ascend
    by the bytes of their name, null first. ``carried`` columns stay with the leaves. Repeated rows are leaves of their
    own, and equal ones have the same hashes whichever comes first. An empty table has no root.
    """
    carried = dict(carried or {})
    names = [f"c{k}" for k in range(len(carried))]
    group_name = F.col(group).cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), group_name), F.lit("")).alias("tree"),
        F.col(key).alias("key"),
        leaf_hash([F.col(c) for c in columns]).alias("digest"),
        *[value.alias(name) for name, value in zip(names, carried.values())],
    )
    placed = _placed(rows, ["key", "digest"], "tree-leaves")
    rounds, subroots = _levels(placed, ["key", *names], stride)
    top = _placed(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("group"), "digest"), ["group"], "tree-groups")
    above, root = _levels(top, ["group"], stride)

    places = top.select(F.col("group").alias("tree"), F.col("at").alias("place"))
    leaves = _ways(rounds[0], 0, stride, places)
    leaves = leaves.select("tree", "digest", "key", *names, "path", "up_tree", "up_round", "up_at")
    way = ["tree", "round", "at", "path", "up_tree", "up_round", "up_at"]
    stored = [_ways(b, k, stride, places).select(way) for k, b in enumerate(rounds) if k]
    stored += [_ways(b, k, stride, None).select(way) for k, b in enumerate(above)]
    nodes = stored[0]
    for more in stored[1:]:
        nodes = nodes.union(more)
    nodes = materialize(nodes, "tree-nodes")
    for name, given in zip(names, carried):
        leaves = leaves.withColumnRenamed(name, given)
    return Manifest(leaves, nodes, subroots, root.select("digest"))


# The first SELECT folds the siblings of a leaf's own block, every further one those of a stored node.
_CLIMB = """
WITH RECURSIVE climb (tree, leaf, key, folded, proof, up_tree, up_round, up_at) AS (
  SELECT tree, digest, key,
    aggregate(path, claim, (h, s) -> unhex(sha2(lower(hex(concat(s.left, h, s.right))), 256))),
    aggregate(path, X'', (p, s) -> concat(p, s.left, s.right)),
    up_tree, up_round, up_at
  FROM {leaves}
  UNION ALL
  SELECT c.tree, c.leaf, c.key,
    aggregate(n.path, c.folded, (h, s) -> unhex(sha2(lower(hex(concat(s.left, h, s.right))), 256))),
    concat(c.proof, aggregate(n.path, X'', (p, s) -> concat(p, s.left, s.right))),
    n.up_tree, n.up_round, n.up_at
  FROM climb c JOIN {nodes} n ON c.up_tree = n.tree AND c.up_round = n.round AND c.up_at = n.at
)
SELECT tree, leaf, key, folded, proof FROM climb WHERE up_tree IS NULL
"""


def climb(manifest: Manifest, claim: str) -> DataFrame:
    """One row per leaf: ``tree``, ``leaf``, ``key``, ``proof`` (the siblings on its way to the root, one after the
    other) and ``folded``, the root that follows from them and the digest in column ``claim``.

    The number of rows a recursive query may return is unlimited for this session from here on: it grows with the
    leaves, while the number of steps is their logarithm.
    """
    spark = manifest.leaves.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    leaves = manifest.leaves.withColumn("claim", F.col(claim))
    return spark.sql(_CLIMB, leaves=leaves, nodes=manifest.nodes)


def verify(
    docs: DataFrame,
    columns: Sequence[str],
    claimed: Mapping[str, Column],
    key: str = "doc_id",
    group: str = "source",
    stride: int = STRIDE,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and
    ``verified``, digests as hex text.

    ``claimed`` gives what someone else holds in some of the ``columns``; ``folded_root`` is the root that
    follows from these values and the siblings of the true tree, and a row is verified if it is the root.
    Nulls in any column are hashed as such; a null group is a group of its own; empty texts differ from null ones.
    Repeated rows stay repeated. An empty table gives no rows. Columns that are not named are not read.
    """
    claim = leaf_hash([claimed.get(c, F.col(c)) for c in columns])
    manifest = build(docs, columns, key, group, {"claim": claim}, stride)
    found = climb(manifest, "claim")
    subroots = manifest.subroots.select("tree", F.col("digest").alias("subroot"))
    root = as_text(manifest.root.scalar())
    return found.join(subroots, "tree").select(
        F.col("key").alias(key),
        as_text(F.col("leaf")).alias("leaf"),
        as_text(F.col("subroot")).alias("subroot"),
        root.alias("root"),
        F.sha2(as_text(F.col("proof")), 256).alias("proof_sha256"),
        as_text(F.col("folded")).alias("folded_root"),
        (as_text(F.col("folded")) == root).alias("verified"),
    )
