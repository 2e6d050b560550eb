"""A compressed FM-index over sequences of integers, with all operations on whole arrays of queries."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """A wavelet tree stored level by level: one bit a symbol and level, with a count every 64 bits."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.words, self.ranks, self.zeros = [], [], []
        for level in reversed(range(self.bits)):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.packbits(np.r_[bit, np.zeros(-len(bit) % 64 + 64, dtype=bool)], bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.ranks.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the prefixes of these lengths end among equal symbols on the last level; differences are ranks."""
        for k, level in enumerate(reversed(range(self.bits))):
            at = i >> 6
            below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ranks[k][at] + np.bitwise_count(self.words[k][at] & below)
            i = np.where(c >> level & 1, self.zeros[k] + ones, i - ones)
        return i


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in the order of their first `depth` symbols or more, by prefix doubling; 0 ends all comparisons."""
    n, rank, width = len(text), text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while width < depth:
        after = np.zeros(n, dtype=np.int64)
        after[: n - width] = rank[width:]
        key = rank * (int(rank.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        step = np.r_[False, key[order][1:] != key[order][:-1]]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(step) + 1
        width *= 2
        if rank[order[-1]] == n:
            break
    return order


class FMIndex:
    """Backward search for patterns of up to `depth` symbols; every position of the text has a weight.

    The text's symbols are 0 to n_symbols - 1; 0 separates texts and is never searched.
    """

    def __init__(self, text: np.ndarray, n_symbols: int, weights: np.ndarray, depth: int) -> None:
        order = sorted_suffixes(text, depth)
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=n_symbols))]
        self.weights = np.r_[0, np.cumsum(weights[order])]
        self.tree = WaveletMatrix(text[order - 1], n_symbols)
        symbols = np.arange(n_symbols)
        self.begin = self.tree.descend(symbols, np.zeros(n_symbols, dtype=np.int64))

    def matched(self, text: np.ndarray, ends: np.ndarray, most: int, least: int = 2) -> np.ndarray:
        """Matching statistics: for each end, how many symbols up to it, `most` at most, form a sequence whose places in
        the index weigh at least `least` together."""
        lengths = np.zeros(len(ends), dtype=np.int64)
        live, at = np.arange(len(ends)), ends.astype(np.int64)
        lo, hi = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), len(text), dtype=np.int64)
        for done in range(1, most + 1):
            c = text[at]
            both = self.tree.descend(np.concatenate([c, c]), np.concatenate([lo, hi]))
            shift = self.first[c] - self.begin[c]
            lo, hi = both[: len(c)] + shift, both[len(c) :] + shift
            found = (self.weights[hi] - self.weights[lo] >= least) & (c != 0)
            live, at, lo, hi = live[found], at[found] - 1, lo[found], hi[found]
            lengths[live] = done
            if not len(live):
                break
        return lengths
