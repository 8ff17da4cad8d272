"""A full-text index over words: suffix array, Burrows-Wheeler transform, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be the least and occur once."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = new
        width *= 2
        if rank[order[-1]] == n - 1:
            return order


class WaveletMatrix:
    """Ranks of any symbol in logarithmic time, for whole arrays of queries at once."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        level = text
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(level) - self.ones[-1][-1]))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        self.last = level

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the given place."""
        start, end = np.zeros_like(place), place
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[k], self.zeros[k]
            up = ((symbol >> b) & 1).astype(bool)
            start = np.where(up, zeros + ones[start], start - ones[start])
            end = np.where(up, zeros + ones[end], end - ones[end])
        return end - start


class FMIndex:
    """Counts and locates phrases in a sequence of symbols below ``sigma``; symbol 0 is kept for the end."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8) -> None:
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.tree = WaveletMatrix(self.bwt, sigma)
        self.sampled = order % sample == 0
        self.sample_no = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]
        self.size = len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of many phrases of one length: the suffix range [low, high) of each row."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, column]
            low = self.below[symbol] + self.tree.rank(symbol, low)
            high = self.below[symbol] + self.tree.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks, walking back to the next sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = ~self.sampled[rows]
        while open_.any():
            at = rows[open_]
            symbol = self.bwt[at]
            rows[open_] = self.below[symbol] + self.tree.rank(symbol, at)
            steps[open_] += 1
            open_ = ~self.sampled[rows]
        return self.samples[self.sample_no[rows]] + steps
