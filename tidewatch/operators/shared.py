"""Pairs of items that share keys, counted in one task for a block of items, which has the members of its keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import pieces

#: Pairs that are in memory at once, about.
PIECE_PAIRS = 1_000_000


def counted(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(a, b, rare) of pairs that share `least` keys or may, with common ones, from rows (block, own, items, common): a key's
    members, of which the first `own` are the block's and meet all after them, with how many common keys they have."""
    own, sizes, items, common = [], [], [], []
    for batch in batches:
        own.append(batch.column(1).to_numpy())
        sizes.append(batch.column(2).value_lengths().to_numpy())
        items.append(batch.column(2).flatten().to_numpy())
        common.append(batch.column(3).flatten().to_numpy())
    if not own:
        return
    own, sizes, items, common = (np.concatenate(x).astype(np.int64) for x in (own, sizes, items, common))
    names, item = np.unique(items, return_inverse=True)
    more = np.zeros(len(names), np.int64)
    more[item] = common
    at = pieces.places(np.cumsum(sizes) - sizes, own)
    at = at[np.argsort(item[at], kind="stable")]
    n = (np.repeat(np.cumsum(sizes), sizes)[at] - at - 1) if len(at) else at
    at, n = at[n > 0], n[n > 0]
    for chunk in pieces.chunks(item[at], n, PIECE_PAIRS):
        pair, shared = pieces.together(_pairs(item, at[x], n[x], len(names)) for x in chunk)
        a, b = np.divmod(pair, len(names))
        enough = shared + np.minimum(more[a], more[b]) >= least
        a, b, shared = names[a[enough]], names[b[enough]], shared[enough]
        for k in range(0, len(a), 65_536):
            x, y = a[k : k + 65_536], b[k : k + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(shared[k : k + 65_536])], ["a", "b", "rare"])


def _pairs(item: np.ndarray, at: np.ndarray, n: np.ndarray, names: int) -> tuple[np.ndarray, ...]:
    pair = np.repeat(item[at] * names, n) + item[pieces.places(at + 1, n)]
    pair.sort()
    return pieces.summed(pair, np.ones(len(pair), np.int64), in_order=True)
