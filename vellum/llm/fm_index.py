"""An FM-index over words: BWT in a wavelet matrix of packed bits, backward search.

The suffixes are sorted by their first ``depth`` words only (ties by place), which is
enough for patterns up to that length: the rows before a pattern's interval are then exactly
the suffixes that are smaller than the pattern.
"""
from __future__ import annotations

import numpy as np

#: Words whose intervals are tabulated while the suffixes are sorted; a search starts there.
JUMP = 4


class Bits:
    """A packed bit vector with rank in constant time."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask).astype(np.int64)


class FMIndex:
    """``symbols``: the text as integers 0..sigma-1.  The last one must be a symbol that no
    pattern holds: it stands for the end of the text."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n, self.sigma = len(symbols), int(symbols.max(initial=0)) + 1
        rank, k, self.jump = symbols.astype(np.int64), 1, None
        while True:
            order = np.argsort(rank, kind="stable")
            if k >= depth:
                break
            s = rank[order]
            dense = np.empty(n, np.int64)
            new = np.concatenate([[True], s[1:] != s[:-1]])
            dense[order] = np.cumsum(new) - 1
            if k == JUMP:
                edge = np.append(np.flatnonzero(new), n).astype(np.int32)
                self.jump = edge[dense], edge[dense + 1]
            nxt = np.zeros(n, np.int64)
            nxt[:n - k] = dense[k:] + 1
            rank = dense * (n + 2) + nxt
            k *= 2
        self.suffixes = order
        self.levels, self.zeros = [], []
        self.width = max(1, (self.sigma - 1).bit_length())
        seq = symbols[order - 1]
        count = np.bincount(symbols, minlength=self.sigma)
        self.smaller = np.concatenate([[0], np.cumsum(count)])[:-1]
        start = np.zeros(self.sigma, np.int64)
        for level in range(self.width - 1, -1, -1):
            bit = (seq >> level) & 1
            b = Bits(bit)
            z = n - int(bit.sum())
            own = (np.arange(self.sigma) >> level) & 1
            ones = b.rank(start)
            start = np.where(own == 1, z + ones, start - ones)
            self.levels.append(b)
            self.zeros.append(z)
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.start = start

    def occurrences(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol c stands among the first i of the BWT."""
        at = i
        for k, (b, z) in enumerate(zip(self.levels, self.zeros)):
            ones = b.rank(at)
            at = np.where((c >> (self.width - 1 - k)) & 1 == 1, z + ones, at - ones)
        return at - self.start[c]

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of c + pattern from those of the patterns."""
        base = self.smaller[c]
        return base + self.occurrences(c, lo), base + self.occurrences(c, hi)


def earliest(symbols: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """For each place the first place in ``symbols`` where the same ``length`` symbols
    stand.  All places are streamed together, backwards, through one index; a pattern whose
    interval shrinks to one row stands at its own place only and leaves the stream."""
    first = places.copy()
    if not len(places):
        return first
    ix = FMIndex(symbols, length)
    live, j = np.arange(len(places)), length
    lo, hi = np.zeros(len(places), np.int64), np.full(len(places), len(symbols), np.int64)
    if ix.jump is not None and length >= JUMP:
        j -= JUMP
        lo, hi = (x[places + j].astype(np.int64) for x in ix.jump)
        on = hi - lo > 1
        live, lo, hi = live[on], lo[on], hi[on]
    for j in range(j - 1, -1, -1):
        lo, hi = ix.extend(symbols[places[live] + j], lo, hi)
        on = hi - lo > 1
        live, lo, hi = live[on], lo[on], hi[on]
    if len(live):
        key, back = np.unique(lo, return_inverse=True)
        end = np.zeros(len(key), np.int64)
        end[back] = hi
        low = np.minimum.reduceat(np.append(ix.suffixes, len(symbols)), np.stack([key, end], 1).ravel())[::2]
        first[live] = low[back]
    return first
