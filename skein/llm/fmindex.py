"""An FM-index over integer sequences: suffix order, Burrows-Wheeler transform, wavelet matrix, sampled positions. All searches are vectorised."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling until all ranks differ; text ends with a symbol found nowhere else, so it stops."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while n > 1:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = fresh
        if rank[order[-1]] == n - 1:
            break
        step *= 2
    return order


class Wavelet:
    """Ranks of any symbol up to any place, one bit plane at a time, highest bit first."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.zeros_before, self.zeros = [], []
        current = values
        for level in range(self.levels):
            one = (current >> (self.levels - 1 - level) & 1).astype(bool)
            self.zeros_before.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            self.zeros.append(int(self.zeros_before[-1][-1]))
            current = np.concatenate([current[~one], current[one]])
        self.first = self.walk(np.arange(symbols), np.zeros(symbols, dtype=np.int64))

    def walk(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            before = self.zeros_before[level][place]
            place = np.where(symbol >> (self.levels - 1 - level) & 1, self.zeros[level] + place - before, before)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self.walk(symbol, place) - self.first[symbol]

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        symbol = np.zeros(len(place), dtype=np.int64)
        for level in range(self.levels):
            cum = self.zeros_before[level]
            before = cum[place]
            one = cum[place + 1] == before
            symbol = symbol << 1 | one
            place = np.where(one, self.zeros[level] + place - before, before)
        return symbol, place - self.first[symbol]


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int, sample: int = 8):
        """text: symbols 1 .. symbols-1; a 0 is put at its end."""
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text)
        self.n, self.sample = len(text), sample
        self.wavelet = Wavelet(text[order - 1], symbols)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:-1]
        marked = order % sample == 0
        self.marked_before = np.concatenate([[0], np.cumsum(marked)])
        self.positions = order[marked]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one row of the suffixes that start with each pattern (rows of equal length), by backward search."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        alive = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, column]
            a = self.below[symbol] + self.wavelet.rank(symbol, low[alive])
            b = self.below[symbol] + self.wavelet.rank(symbol, high[alive])
            low[alive], high[alive] = a, b
            alive = alive[a < b]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows: steps back through the transform to the next sampled position."""
        out, steps, open_ = np.empty(len(rows), dtype=np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            hit = self.marked_before[rows + 1] > self.marked_before[rows]
            out[open_[hit]] = self.positions[self.marked_before[rows[hit]]] + steps
            open_, rows = open_[~hit], rows[~hit]
            if len(open_):
                symbol, rank = self.wavelet.access(rows)
                rows = self.below[symbol] + rank
            steps += 1
        return out
