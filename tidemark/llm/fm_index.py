"""A full-text index of one training shard: Burrows-Wheeler transform, wavelet tree, sampled suffixes."""

from __future__ import annotations

import numpy as np

#: Symbols below this one are the end of the sequence and the gap between two runs.
END, GAP, FIRST = 0, 1, 2
#: Every so many positions a suffix position is kept for locating.
SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order, by doubling the compared length until no ties are left."""
    n = len(symbols)
    rank, length = symbols.astype(np.int64), 1
    while True:
        later = np.zeros(n, np.int64)
        later[: max(0, n - length)] = rank[length:] + 1
        key = rank * (n + max(2, int(rank.max()) + 2)) + later
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if new[order[-1]] == n - 1:
            return order
        rank, length = new, 2 * length


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector a level, zeros before ones at the next level."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max()).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        low, high = np.zeros_like(end), end
        for depth, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = (symbol >> (self.bits - 1 - depth)) & 1 == 1
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low


class FMIndex:
    """Counts and locates phrases in ``symbols``, which hold no ``END``."""

    def __init__(self, symbols: np.ndarray):
        text = np.concatenate([symbols, [END]]).astype(np.int64)
        order = suffix_order(text)
        self.last = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.tree = WaveletTree(self.last)
        self.sampled = order % SAMPLE == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each phrase (one phrase a row, of one length)."""
        symbol = np.minimum(phrases, len(self.before) - 2)
        known = (phrases == symbol).all(axis=1)
        low = self.before[symbol[:, -1]]
        high = self.before[symbol[:, -1] + 1]
        for column in reversed(range(phrases.shape[1] - 1)):
            c = symbol[:, column]
            low = self.before[c] + self.tree.rank(c, low)
            high = self.before[c] + self.tree.rank(c, high)
        return low, np.where(known, np.maximum(low, high), low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows, by stepping back to the next sampled one."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        open_rows = np.arange(len(rows))
        while len(open_rows):
            here = at[open_rows]
            done = self.sampled[here]
            out[open_rows[done]] = self.samples[self.sample_rank[here[done]]] + steps
            open_rows, here = open_rows[~done], here[~done]
            c = self.last[here]
            at[open_rows] = self.before[c] + self.tree.rank(c, here)
            steps += 1
        return out
