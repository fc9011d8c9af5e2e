"""A compressed FM-index in numpy: Burrows-Wheeler transform in a wavelet tree of packed bit rows."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols or more, by doubling; what is equal so far keeps its place."""
    rank, done = text.astype(np.int64), 1
    while True:
        if done >= depth:
            return np.argsort(rank, kind="stable")
        ahead = np.zeros(len(rank), np.int64)
        ahead[: len(rank) - done] = rank[done:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key)
        new = np.cumsum(np.r_[False, key[order][1:] != key[order][:-1]])
        rank = np.empty(len(key), np.int64)
        rank[order] = new
        done *= 2


class BitRow:
    """Bits with the number of ones before each word of 64: rank in constant time, 1.5 bits a bit."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        room = np.zeros((n + 64) // 64 * 64, np.uint8)
        room[:n] = bits
        self.words = np.packbits(room, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)
        self.zeros = n - int(ones.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        inside = self.words[word] & ((_U(1) << (at & 63).astype(np.uint64)) - _U(1))
        return self.before[word] + np.bitwise_count(inside)


class FmIndex:
    """Backward search over texts of symbols 1.., ended by 0. Patterns of up to `depth` symbols are found exactly."""

    def __init__(self, text: np.ndarray, depth: int):
        self.order = suffix_order(text, depth)
        last = text[self.order - 1]
        self.sigma = int(text.max()) + 1
        self.levels = max(1, (self.sigma - 1).bit_length())
        self.rows, symbols = [], last
        for level in range(self.levels - 1, -1, -1):  # ones of a level go behind its zeros
            bits = (symbols >> level) & 1
            self.rows.append(BitRow(bits))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        before = np.cumsum(np.bincount(text, minlength=self.sigma + 1)) - np.bincount(text, minlength=self.sigma + 1)
        every = np.arange(self.sigma)
        self.shift = before[every] - self._down(every, np.zeros(self.sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, row in zip(range(self.levels - 1, -1, -1), self.rows, strict=True):
            ones = row.ones(at)
            at = np.where((symbol >> level) & 1, row.zeros + ones, at - ones)
        return at

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes among [low, high) that have the symbol before them, as their own interval."""
        n = len(symbol)
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.concatenate([self.shift[symbol]] * 2)
        return both[:n], both[n:]
