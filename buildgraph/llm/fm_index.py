"""An FM-index over integer symbols: wavelet-tree ranks, backward search, sampled suffix positions.

Built with NumPy per training shard; searches take all patterns at once.
"""

from __future__ import annotations

import numpy as np

#: Every so many text positions the suffix array is kept.
SAMPLE = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by prefix doubling.

    Zeros are separators: each sorts as a symbol of its own, by position, so
    no comparison runs past one.
    """
    n = len(symbols)
    zeros = symbols == 0
    rank = np.where(zeros, np.cumsum(zeros), symbols.astype(np.int64) + int(zeros.sum()))
    step = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1 if step < n else 0
        order = np.lexsort((after, rank))
        change = np.ones(n, dtype=np.int64)
        change[1:] = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
        fresh = np.cumsum(change)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n or step >= n:
            return order
        step *= 2


class WaveletTree:
    """Rank queries over a symbol sequence, one level per bit, all queries at once."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self._bits = bits
        self._ones: list[np.ndarray] = []
        self._zeros: list[int] = []
        current = symbols
        for bit in range(bits - 1, -1, -1):
            one = ((current >> bit) & 1).astype(bool)
            self._ones.append(np.concatenate([[0], np.cumsum(one, dtype=np.int64)]))
            self._zeros.append(int(len(one) - one.sum()))
            current = np.concatenate([current[~one], current[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        lo = np.zeros_like(at)
        hi = at.copy()
        for level in range(self._bits):
            one = ((symbol >> (self._bits - 1 - level)) & 1).astype(bool)
            ones, zeros = self._ones[level], self._zeros[level]
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            hi = np.where(one, zeros + ones[hi], hi - ones[hi])
        return hi - lo


class FMIndex:
    """Index of a sequence of symbols in which 0 separates documents and gaps."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self._n = len(symbols)
        order = suffix_array(symbols)
        self._bwt = symbols[order - 1]  # position 0 wraps to the last symbol, a separator
        self._tree = WaveletTree(self._bwt, max(int(alphabet).bit_length(), 1))
        counts = np.bincount(symbols, minlength=alphabet + 1)
        self._before = np.concatenate([[0], np.cumsum(counts)])
        kept = (order % SAMPLE == 0) | (self._bwt == 0)
        self._kept = kept
        self._kept_rank = np.concatenate([[0], np.cumsum(kept)])
        self._positions = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of patterns (rows, padded on the left with 0), by backward search."""
        count, width = patterns.shape
        lo = np.zeros(count, dtype=np.int64)
        hi = np.full(count, self._n, dtype=np.int64)
        live = np.arange(count)
        for back in range(width):
            live = live[(lengths[live] > back) & (hi[live] > lo[live])]
            if not len(live):
                break
            symbol = patterns[live, width - 1 - back]
            base = self._before[symbol]
            lo[live] = base + self._tree.rank(symbol, lo[live])
            hi[live] = base + self._tree.rank(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: walk back to the next kept position."""
        rows = rows.copy()
        steps = np.zeros(len(rows), dtype=np.int64)
        out = np.zeros(len(rows), dtype=np.int64)
        live = np.arange(len(rows))
        while len(live):
            at = rows[live]
            done = self._kept[at]
            out[live[done]] = self._positions[self._kept_rank[at[done]]] + steps[live[done]]
            live = live[~done]
            at = rows[live]
            symbol = self._bwt[at]
            rows[live] = self._before[symbol] + self._tree.rank(symbol, at)
            steps[live] += 1
        return out
