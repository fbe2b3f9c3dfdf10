"""Token ids of whole texts with a public byte-level tokenizer.

The tokenizer first splits a text into words with their leading space, numbers, marks and white space, and
then encodes each part by itself. Parts repeat, so a worker keeps the ids of the parts it has met, up to
``CACHE_PARTS`` parts and ``CACHE_IDS`` ids, and asks the tokenizer for new ones only. Splitting is done on bytes for rows
of ASCII and Latin letters; rows with any other character, and rows that hold the string of a token which the tokenizer
takes out before it splits, are encoded by the tokenizer as they are.
"""

from __future__ import annotations

import os

import numpy as np

from tidemark.llm import textops as X

CACHE_PARTS = 500_000
CACHE_IDS = 8_000_000
_LETTER, _DIGIT, _SPACE, _MARK = range(4)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
_KIND[0xC3:0xCA] = _LETTER
_KIND[0x80:0xC0] = _LETTER
_KIND[[b for b in range(128) if chr(b).isdigit()]] = _DIGIT
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
#: Endings that the tokenizer splits off after an apostrophe.
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def plain_rows(piece: X.Piece) -> np.ndarray:
    """Rows of ASCII and U+00C0 to U+024F, which are letters but for the signs of times and division."""
    data = piece.data
    odd = (data >= 0xC0) & ((data < 0xC3) | (data > 0xC9))
    after = np.append(data[1:], 0)
    odd |= (data == 0xC3) & ((after == 0x97) | (after == 0xB7))
    return piece.per_row(odd) == 0


def part_starts(piece: X.Piece) -> np.ndarray:
    """Where the parts of the rows begin."""
    data, size = piece.data, len(piece.data)
    row_start = np.zeros(size + 1, bool)
    row_start[piece.offsets] = True
    kind = _KIND[data]
    begin = row_start[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]

    # The last character of white space before a word: a blank belongs to the word.
    space = kind == _SPACE
    final = np.flatnonzero(space[:-1] & ~space[1:] & ~row_start[1:-1])
    blank = final[data[final] == 32]
    begin[final] = True
    begin[blank + 1] = False

    # An apostrophe that begins a part, and a known ending after it.
    quote = np.flatnonzero((data[:-1] == 39) & (kind[1:] == _LETTER) & begin[:-1] & ~row_start[1:-1])
    row_end = piece.offsets[np.searchsorted(piece.offsets, quote, "right")]
    for ending in _ENDINGS:
        stop = quote + 1 + len(ending)
        fits = stop <= row_end
        for k, letter in enumerate(ending):
            fits &= data[np.minimum(quote + 1 + k, size - 1)] == letter
        begin[quote[fits] + 1] = False
        inside = stop[fits]
        begin[inside[inside < size]] = True
    return np.flatnonzero(begin)


class Encoder:
    """Token ids of rows; one per worker process and tokenizer file."""

    _known: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def _without_added(self, piece: X.Piece, raw: bytes) -> np.ndarray:
        """Rows that hold no string of an added token."""
        out = np.ones(piece.rows, bool)
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                first, last = np.searchsorted(piece.offsets, [at, at + len(token) - 1], "right") - 1
                out[first] &= first != last
                at = raw.find(token, at + 1)
        return out

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        # Where the ids of each known part begin in the pool, and where the last ones end.
        self.starts, self.pool, self.used = np.zeros(1 << 12, np.int64), np.empty(1 << 16, np.uint32), 0

    def _learn(self, hashes: list[int], parts: list[str]) -> None:
        for code, found in zip(hashes, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)):
            ids = found.ids
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.empty(len(self.pool) + len(ids), np.uint32)])
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.index[code] = number = len(self.index)
            if number + 2 > len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros(len(self.starts), np.int64)])
            self.starts[number + 1] = self.used

    def rows(self, piece: X.Piece) -> list[np.ndarray]:
        """The ids of each row."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * piece.rows
        if not len(piece.data):
            return out
        if len(self.index) > CACHE_PARTS or self.used > CACHE_IDS:
            self.clear()
        raw = piece.data.tobytes()
        plain = plain_rows(piece) & self._without_added(piece, raw)
        starts = part_starts(piece)
        ends = np.append(starts[1:], len(piece.data))
        row = np.searchsorted(piece.offsets, starts, "right") - 1
        starts, ends, row = starts[plain[row]], ends[plain[row]], row[plain[row]]
        hashes, first, which = np.unique(
            X.hash_spans(piece.data, starts, ends, X.SAME), return_index=True, return_inverse=True
        )
        codes = hashes.tolist()
        new = [k for k, code in enumerate(codes) if code not in self.index]
        if new:
            at = first[new]
            parts = [raw[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            self._learn([codes[k] for k in new], parts)
        entry = np.fromiter((self.index[c] for c in codes), np.int64, len(codes))
        low, high = self.starts[entry], self.starts[entry + 1]
        size = (high - low)[which]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(low[which] - total[:-1], size) + np.arange(total[-1])]
        bounds = total[np.searchsorted(row, np.arange(piece.rows + 1))]
        for k in range(piece.rows):
            if plain[k]:
                out[k] = ids[bounds[k] : bounds[k + 1]]
            else:
                text = raw[piece.offsets[k] : piece.offsets[k + 1]].decode()
                found = self.tokenizer.encode(text, add_special_tokens=False)
                out[k] = np.array(found.ids, np.uint32)
        return out
