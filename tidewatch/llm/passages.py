"""Word hashes and minimizer segments of texts, computed for a batch of documents at once."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes are remembered at a time.
REMEMBERED = 1_000_000


class WordHashes(dict):
    """The 64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out *= _MIX
        out += words[i : i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each `size` consecutive values, by doubling."""
    n, width = len(x) - size + 1, 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:n], x[size - width : size - width + n])


def segments(hashes: np.ndarray, starts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows of one text with one minimizer, the smallest hash of a gram in the window.

    hashes: of the words of all texts, one after another; starts: where each text starts, and the end of the last. Gives
    for each run the text's number, the first window's word in the text, the number of windows, the minimizer and how
    often it stands in the run. The runs take every window of every text once, windows with equal words have equal
    minimizers, and two equal windows have their minimizer at two places.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(hashes) < window:
        return none, none, none, none.astype(np.uint64), none
    grams = gram_hashes(hashes, gram)
    low = sliding_min(grams, window - gram + 1)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(low)]
    at = np.flatnonzero(np.arange(len(low)) + window <= starts[1:][text])
    if not len(at):
        return none, none, none, none.astype(np.uint64), none
    new = np.r_[True, (low[at[1:]] != low[at[:-1]]) | (text[at[1:]] != text[at[:-1]]) | (np.diff(at) != 1)]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(at)])
    begin = at[first]
    held = count + window - gram
    before = np.r_[0, np.cumsum(held)[:-1]]
    same = grams[np.repeat(begin - before, held) + np.arange(int(held.sum()))] == np.repeat(low[begin], held)
    return text[begin], begin - starts[text[begin]], count, low[begin], np.add.reduceat(same.astype(np.int64), before)
