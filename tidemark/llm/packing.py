"""Packing of documents into sequences of bounded length.

Each task packs its documents online with a fixed number of open windows. A piece goes into the open
window where it leaves the least room. If it fits in none, the fullest one is filled up with the head of the
piece and emitted. What is open at the end of a task is packed again with the rest of other tasks, some
tasks at a time, until one is left; that one joins its windows and cuts the last into powers of two.
So only the rest of a task moves, and no sequence has padding.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops as X
from tidemark.llm.tokens import Encoder
from tidemark.session import materialize

LENGTH = 2048
OPEN = 32
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
#: So many tasks hand their rest to one.
MERGE = 32

_FIELDS = (
    "key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "open boolean, ids array<int>"
)
_BATCH = 4096


class Packer:
    """Bounded-space best fit. Pieces are (key, start, ids, doc_tokens)."""

    def __init__(self, length: int, most: int, first_id: int, keep_ids: bool):
        self.length, self.most, self.next, self.keep = length, most, first_id, keep_ids
        self.rooms: list[tuple[int, int]] = []  # of open windows: room left and number, in order
        self.windows: dict[int, list] = {}
        self.out: list[tuple] = []

    def _emit(self, number: int, pieces: list, is_open: bool = False) -> None:
        offset = 0
        for key, start, ids, tokens in pieces:
            code = zlib.crc32(ids.astype("<u4").tobytes())
            kept = ids if self.keep or is_open else None
            self.out.append((key, start, len(ids), code, tokens, number, offset, is_open, kept))
            offset += len(ids)

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, key, start: int, ids: np.ndarray, tokens: int) -> None:
        while len(ids) >= self.length:
            self._emit(self._new(), [(key, start, ids[: self.length], tokens)])
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            at = bisect.bisect_left(self.rooms, (len(ids), -1))
            if at == len(self.rooms) and at < self.most:
                number = self._new()
                self.windows[number] = [(key, start, ids, tokens)]
                bisect.insort(self.rooms, (self.length - len(ids), number))
                return
            # The tightest window that takes all of it, or else the fullest one, which is filled up.
            room, number = self.rooms.pop(at if at < len(self.rooms) else 0)
            head, rest = ids[:room], ids[room:]
            self.windows[number].append((key, start, head, tokens))
            if room > len(head):
                bisect.insort(self.rooms, (room - len(head), number))
            else:
                self._emit(number, self.windows.pop(number))
            start, ids = start + len(head), rest

    def leave(self) -> None:
        """Hand on the open windows."""
        for number, pieces in self.windows.items():
            self._emit(number, pieces, True)

    def finish(self) -> None:
        """Join the open windows; the last sequence is cut into powers of two."""
        pieces = [p for number in self.windows for p in self.windows[number]]
        rest = sum(len(p[2]) for p in pieces)
        number, sequence, room = None, [], 0
        for key, start, ids, tokens in pieces:
            while len(ids):
                if not room:
                    room = self.length if rest >= self.length else 1 << (rest.bit_length() - 1)
                    rest -= room
                    number, sequence = self._new(), []
                sequence.append((key, start, ids[:room], tokens))
                taken = len(sequence[-1][2])
                start, ids, room = start + taken, ids[taken:], room - taken
                if not room:
                    self._emit(number, sequence)

    def batches(self, kind: pa.DataType, least: int = 1) -> Iterator[pa.RecordBatch]:
        """What has been emitted, once there are ``least`` pieces."""
        if len(self.out) < least:
            return
        columns = list(zip(*self.out))
        self.out = []
        types = [kind, *[pa.int64()] * 6, pa.bool_()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        ids = [None if x is None else x.astype(np.int32) for x in columns[8]]
        arrays.append(pa.array(ids, pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays(
            arrays, [f.split()[0] for f in _FIELDS.format(kind="x").split(", ")]
        )


def _task_ids(turn: int) -> int:
    """The first sequence id of this task: 4 bits of the turn, 26 of the partition, 32 to count."""
    return (turn << 58) | (TaskContext.get().partitionId() << 32)


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    length: int = LENGTH,
    open_windows: int = OPEN,
    end_id: int = END_ID,
    keep_ids: bool = True,
) -> DataFrame:
    """The pieces of all documents: ``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and, with ``keep_ids``, the token ids.

    A document's ids end with ``end_id``; a null or empty text has only that. ``tokenizer`` is a file that
    every worker can read, by default a public one. Each row is packed by itself, also repeated rows and
    rows without a key; other columns are not read. An empty table gives no pieces.
    """
    kind = docs.schema[key].dataType.simpleString()
    fields = _FIELDS.format(kind=kind)
    session = docs.sparkSession
    X.small_batches(session)

    def first(batches):
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        encoder, packer, key_type = Encoder.of(path), Packer(length, open_windows, _task_ids(0), keep_ids), None
        for batch in batches:
            key_type = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            for piece in X.pieces(batch.column(1)):
                for k, ids in enumerate(encoder.rows(piece)):
                    ids = np.append(ids, np.uint32(end_id))
                    packer.add(keys[piece.first + k], 0, ids, len(ids))
                yield from packer.batches(key_type, _BATCH)
        packer.leave()
        yield from packer.batches(key_type)

    def again(turn: int, last: bool):
        def run(batches):
            packer, key_type = Packer(length, open_windows, _task_ids(turn), keep_ids), None
            for batch in batches:
                key_type = batch.schema.field(0).type
                keys, starts, tokens, ids = (c.to_pylist() for c in batch.columns[:4])
                for k in range(len(keys)):
                    packer.add(keys[k], starts[k], np.array(ids[k], np.uint32), tokens[k])
                yield from packer.batches(key_type, _BATCH)
            packer.finish() if last else packer.leave()
            yield from packer.batches(key_type)

        return run

    rows = docs.select(F.col(key).alias("key"), F.col(text))
    done = materialize(rows.mapInArrow(first, fields), "pieces")
    parts, turn = [done.where("NOT open")], 0
    while True:
        rest = done.where("open")
        tasks = rest.select(F.shiftright("sequence_id", 32)).distinct().count()
        if not tasks:
            break
        turn += 1
        last = tasks <= MERGE
        moved = rest.repartition(-(-tasks // MERGE), F.shiftright("sequence_id", 32)).sortWithinPartitions(
            "sequence_id", "offset"
        )
        moved = moved.select("key", "start", "doc_tokens", "ids")
        done = materialize(moved.mapInArrow(again(turn, last), fields), "pieces")
        parts.append(done.where("NOT open"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.withColumnRenamed("key", key).drop("open")
    return out if keep_ids else out.drop("ids")
