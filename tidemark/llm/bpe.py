"""Byte-level BPE over a tree of parts of a text.

The tokens of a text are those of its halves but for a window around the middle. So a text is cut into leaves of
``LEAF`` characters, each leaf is encoded by itself, and neighbours are joined pair by pair up to the whole. A
join encodes a window around the border again and keeps all tokens outside. The window grows until one of two
reasons proves on each of its sides that the tokens outside stay what they are:

* A seam: white space after a character that is none. No match of the splitting pattern goes across a seam, none looks
  beyond it, and none depends on what lies before it. The tokens before and after a seam are those of the two texts
  alone.
* Inside a long run of letters, digits or marks, which is one match: merging takes the lowest rank first, so a sequence of
  tokens is that of their bytes if every two neighbours alone stay as they are. Then only the pairs where
  the window meets the outside have to be tried.

Texts beyond ``CHUNK`` characters are spread: their chunks are rows, encoded in any task, and joined level by level
by grouping neighbours. Decoding concatenates the bytes of the tokens up the same kind of tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops as X
from tidemark.session import materialize

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a leaf, and of a chunk that is a row of its own.
LEAF = 1024
CHUNK = 1 << 15
#: So many neighbours meet in a task of one level.
GROUP = 16
#: First size of a window on either side of a border.
WINDOW = 24
#: A contraction ends at most two letters after its apostrophe, and white space may leave its last character to
#: what follows: tokens so many characters inside a run belong to one match.
_MARGIN = 3
_BLANKS = frozenset(" \t\n\r")


def _kind(c: str) -> int:
    """1 letter, 2 digit, 3 mark, 4 white space, 0 anything whose class is not taken for granted."""
    if c.isascii():
        if c.isalpha():
            return 1
        if c.isdigit():
            return 2
        return 4 if c in _BLANKS else 3 if c > " " and c not in "'\x7f" else 0
    return 1 if "一" <= c <= "龥" or "À" <= c <= "ɏ" and c not in "×÷" else 0


def is_seam(text: str, at: int) -> bool:
    """White space at ``at``, after a character that is surely none."""
    return 0 < at < len(text) and text[at] in _BLANKS and _kind(text[at - 1]) in (1, 2, 3)


class Part:
    """A stretch of a text with its tokens."""

    __slots__ = ("text", "ids")

    def __init__(self, text: str, ids: list[int]):
        self.text, self.ids = text, ids


class Codec:
    """Encodes and decodes by the ranks of a file; one per worker process and file."""

    _known: dict[str, Codec] = {}

    @classmethod
    def of(cls, path: str | None) -> Codec:
        import public_tokenizers

        path = path or public_tokenizers.path(RANKS)
        if path not in cls._known:
            cls._known[path] = cls(path, public_tokenizers.PATTERN)
        return cls._known[path]

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = dict(zip(ranks.values(), ranks))
        self._stays: dict[tuple[int, int], bool] = {}

    def direct(self, text: str) -> list[int]:
        """The tokens of a short text."""
        return self.encoding.encode_ordinary(text)

    def stay(self, a: int, b: int) -> bool:
        """Whether two tokens of one match remain what they are when their bytes are merged anew."""
        found = self._stays.get((a, b))
        if found is None:
            if len(self._stays) > 1 << 16:
                self._stays.clear()
            found = self.encoding._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            self._stays[a, b] = found
        return found

    def _in_run(self, left: Part, right: Part) -> list[int] | None:
        """The joined tokens if the border lies deep inside one match, found from tokens around it alone."""
        size, kind = WINDOW, _kind(right.text[0])
        if not kind:
            return None
        while True:
            a, b = left.text[-size:], right.text[:size]
            if any(_kind(c) != kind for c in a) or any(_kind(c) != kind for c in b):
                return None
            before = self._tokens_within(reversed(left.ids), len(a.encode()) - 4 * _MARGIN)
            after = self._tokens_within(right.ids, len(b.encode()) - 4 * _MARGIN)
            if before > 1 and after > 1:
                # One token on either side is outside the window, but proves that it stays.
                low, high = len(left.ids) - before + 1, after - 1
                inside = [*left.ids[low:], *right.ids[:high]]
                middle = self.encoding._encode_single_piece(b"".join(map(self.bytes_of.__getitem__, inside)))
                if self.stay(left.ids[low - 1], middle[0]) and self.stay(middle[-1], right.ids[high]):
                    return left.ids[:low] + middle + right.ids[high:]
            if size >= len(left.text) and size >= len(right.text):
                return None
            size *= 2

    def _tokens_within(self, ids, size: int) -> int:
        """How many of the first ``ids`` have ``size`` bytes together at most."""
        number = 0
        for token in ids:
            size -= len(self.bytes_of[token])
            if size < 0:
                break
            number += 1
        return number

    def join(self, left: Part, right: Part) -> Part:
        """The part that holds both."""
        text = left.text + right.text
        if not left.text or not right.text:
            return Part(text, left.ids + right.ids)
        border, size = len(left.text), WINDOW
        low = high = None
        while low is None or high is None:
            if low is None:
                from_ = max(0, border - size)
                # The last seam wins; of windows that reach the start of the text all of it is encoded again.
                low = next((p for p in range(border, max(from_, 1) - 1, -1) if is_seam(text, p)), 0 if not from_ else None)
            if high is None:
                to = min(len(text), border + size)
                high = next((q for q in range(border, to) if is_seam(text, q)), len(text) if to == len(text) else None)
            if (low is None or high is None) and size > WINDOW:
                merged = self._in_run(left, right)
                if merged is not None:
                    return Part(text, merged)
            size *= 2
        kept = len(left.ids) - len(self.direct(text[low:border])) if low < border else len(left.ids)
        gone = len(self.direct(text[border:high])) if high > border else 0
        middle = self.direct(text[low:high]) if low < border < high else [*left.ids[kept:], *right.ids[:gone]]
        return Part(text, left.ids[:kept] + middle + right.ids[gone:])

    def reduce(self, parts: list[Part]) -> Part:
        """Join neighbours until one part is left."""
        while len(parts) > 1:
            paired = [self.join(a, b) for a, b in zip(parts[::2], parts[1::2])]
            parts = paired + parts[len(paired) * 2 :]
        return parts[0] if parts else Part("", [])

    def encode(self, text: str) -> list[int]:
        leaves = [text[k : k + LEAF] for k in range(0, len(text), LEAF)]
        return self.reduce([Part(leaf, self.direct(leaf)) for leaf in leaves]).ids

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of tokens; a token that the file does not have is an error."""
        parts = [
            b"".join(map(self.bytes_of.__getitem__, ids[k : k + LEAF])) for k in range(0, len(ids), LEAF)
        ]
        while len(parts) > 1:
            paired = [a + b for a, b in zip(parts[::2], parts[1::2])]
            parts = paired + parts[len(paired) * 2 :]
        return parts[0] if parts else b""


def _ids_column(found: list[list[int]], packed: bool) -> pa.Array:
    if packed:
        return pa.array([np.array(ids, "<u4").tobytes() for ids in found], pa.binary())
    return pa.array(found, pa.list_(pa.int32()))


def encode(
    docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None, packed: bool = False
) -> DataFrame:
    """One row per row of ``docs``: ``key`` and ``ids``, an array, or with ``packed`` their little-endian unsigned 32-bit
    numbers as binary.

    ``ranks`` is a file that every worker can read, by default a public one. Strings of special tokens are ordinary text. A
    null text is empty and has no ids. Repeated rows stay repeated, rows without a key too; an empty table gives no
    rows; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    ids = "binary" if packed else "array<int>"
    X.small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # Read when the plan is made, so that tests can set them.
    chunk, group = CHUNK, GROUP

    def whole(batches) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks)
        for batch in batches:
            found = [codec.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _ids_column(found, packed)], ["key", "ids"])

    short = rows.where(F.length("text") <= chunk).mapInArrow(whole, f"key {kind}, ids {ids}")

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, content in enumerate(batch.column(2).to_pylist()):
                parts = [content[a : a + chunk] for a in range(0, len(content), chunk)]
                same = pa.array([k] * len(parts))
                columns = [batch.column(0).take(same), batch.column(1).take(same)]
                at, texts = pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, at, texts], ["doc", "key", "at", "text"])

    def each(batches) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks)
        for batch in batches:
            found = pa.array([codec.encode(t) for t in batch.column(3).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "ids"])

    def meet(table: pa.Table) -> pa.Table:
        codec = Codec.of(ranks)
        table = table.sort_by("at")
        parts = [Part(t, i) for t, i in zip(table["text"].to_pylist(), table["ids"].to_pylist())]
        one = codec.reduce(parts)
        first = table.slice(0, 1).select(["doc", "key"])
        at = pa.array([table["at"][0].as_py() // group], pa.int64())
        columns = [*first.columns, at, pa.array([one.text], pa.string()), pa.array([one.ids], pa.list_(pa.int32()))]
        return pa.table(columns, ["doc", "key", "at", "text", "ids"])

    # Few texts are so long. Rows are told apart by a number, since keys may be null or repeat.
    long = rows.where(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("doc"), "key", "text")
    fields = f"doc long, key {kind}, at long, text string"
    parts = long.mapInArrow(cut, fields).repartition("doc", "at").mapInArrow(each, f"{fields}, ids array<int>")
    parts = materialize(parts, "chunks")
    while not parts.where("at > 0").isEmpty():
        near = parts.groupBy("doc", F.floor(F.col("at") / group).alias("near"))
        parts = materialize(near.applyInArrow(meet, f"{fields}, ids array<int>"), "chunks")

    def finish(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _ids_column(batch.column(1).to_pylist(), packed)], ["key", "ids"])

    joined = parts.select("key", "ids")
    if packed:
        joined = joined.mapInArrow(finish, f"key {kind}, ids binary")
    return short.union(joined).withColumnRenamed("key", key)


def decode(tokens: DataFrame, key: str = "doc_id", ids: str = "ids", ranks: str | None = None) -> DataFrame:
    """One row per row of ``tokens``: ``key``, ``ids`` and ``decoded``, the bytes that the ids stand for.

    ``ids`` are an array or packed as by ``encode``. Null ids are none, and no ids give no bytes. The bytes of whole texts are
    UTF-8; those of a part may begin or end inside a character, so they stay binary.
    """
    kind, form = (tokens.schema[c].dataType.simpleString() for c in (key, ids))
    X.small_batches(tokens.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks)
        for batch in batches:
            own = batch.column(1).to_pylist()
            if form == "binary":
                own = [np.frombuffer(x or b"", "<u4").tolist() for x in own]
            found = pa.array([codec.decode(x or []) for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], ["key", "ids", "decoded"])

    rows = tokens.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    found = rows.mapInArrow(run, f"key {kind}, ids {form}, decoded binary")
    return found.withColumnRenamed("key", key).withColumnRenamed("ids", ids)
