"""An FM-index over small integer symbols: suffix order, wavelet-tree ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffix order of ``text``, whose last symbol 0 occurs nowhere else. ``bits``: of the largest symbol.

    As many symbols as fit one number are sorted first; then only suffixes that still tie are sorted on, by the
    rank of what follows, twice as far each time.
    """
    n, depth = len(text), max(1, 62 // bits)
    wide = np.zeros(n + depth, np.int64)
    wide[:n] = text
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key = key << bits | wide[j : j + n]
    order = np.argsort(key)
    new = np.concatenate(([True], np.diff(key[order]) != 0))
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    alone = new & np.concatenate((new[1:], [True]))
    tied = np.flatnonzero(~alone)
    while len(tied):
        at = order[tied]
        key = rank[at] * n + rank[np.minimum(at + depth, n - 1)]
        by = np.argsort(key)
        order[tied] = at[by]
        key = key[by]
        new = np.concatenate(([True], np.diff(key) != 0))
        rank[order[tied]] = np.maximum.accumulate(np.where(new, tied, 0))
        alone = new & np.concatenate((new[1:], [True]))
        tied = tied[~alone]
        depth *= 2
    return order


class FMIndex:
    """Searches for phrases in ``text``, symbols from 1 on; the end mark 0 is added here."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE) -> None:
        self.bits = max(1, int(symbols).bit_length())
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text, self.bits)
        last = text[order - 1]  # the Burrows-Wheeler transform; the row of suffix 0 wraps to the end mark
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1 << self.bits))))
        marked = order % sample == 0
        self.marked, self.mark_rank, self.sampled = marked, np.cumsum(marked) - marked, order[marked]
        # wavelet tree, a level for each bit: ones before each place, and how many zeros the level has
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (last >> level & 1).astype(bool)
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            last = np.concatenate((last[~bit], last[bit]))
        self.begin = self._down(np.arange(1 << self.bits), np.zeros(1 << self.bits, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ones[at].astype(np.int64)
            at = np.where(symbol >> (self.bits - 1 - k) & 1, zeros + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` in the transform before row ``at``."""
        return self._down(symbol, at) - self.begin[symbol]

    def back(self, rows: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one symbol earlier."""
        at, symbol = rows, np.zeros(len(rows), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones[at].astype(np.int64)
            bit = ones[at + 1] > one
            symbol = symbol << 1 | bit
            at = np.where(bit, zeros + one, at - one)
        return self.less[symbol] + at - self.begin[symbol]

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase (a row of ``phrases``, padded at its end)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.less[-1])
        for step in range(int(length.max(initial=0))):
            live = np.flatnonzero((step < length) & (low < high))
            symbol = phrases[live, length[live] - 1 - step]
            low[live] = self.less[symbol] + self.rank(symbol, low[live])
            high[live] = self.less[symbol] + self.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled suffix and count the steps."""
        place, steps, at, left = np.empty(len(rows), np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(left):
            there = self.marked[at]
            place[left[there]] = self.sampled[self.mark_rank[at[there]]] + steps
            left, at = left[~there], self.back(at[~there])
            steps += 1
        return place
