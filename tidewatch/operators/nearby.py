"""Pairs of wallets whose trades lie near each other, counted in squares of wallets instead of as a row for each pair of trades."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces

#: Trades that a block of wallets has at most and at least, about; pairs of trades that are in memory at once, about.
MOST_TRADES, LEAST_TRADES, PIECE_PAIRS = 2_000_000, 100_000, 1_000_000
#: Times that share an array.
SPAN_MS = 3_600_000
_NEVER = np.iinfo(np.int64).min


def _blocks(trades: int, tasks: int) -> int:
    """As many blocks as make a square for each task, fewer where trades are few, and more where a block would be too large."""
    return max(1, -(-trades // MOST_TRADES), min(int(np.ceil(np.sqrt(2 * tasks))), -(-trades // LEAST_TRADES)))


def near_pairs(trades: DataFrame, within: int) -> DataFrame:
    """(a, b, hits, n) of trades(wallet, market, ts_ms), for wallets in either order: how many trades of a have one of b
    in the same market within so many ms, and the smaller of both wallets' counts of trades.

    Wallets are dealt to blocks. Two blocks make a square, one task, which has all trades of both: what is shuffled is each
    trade once a block, packed, and not the pairs of trades, whose number grows with the square of the trades of a minute.
    """
    blocks = _blocks(trades.count(), int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # without a market or a time a trade counts for its wallet only
    known = F.when(F.col("ts_ms").isNotNull(), F.col("market"))
    f = trades.filter("wallet is not null").select("wallet", known.alias("market"), F.coalesce("ts_ms", F.lit(0)).alias("ts_ms"), F.pmod(F.xxhash64("wallet"), F.lit(blocks)).cast("int").alias("block"))
    rows = f.groupBy("block", "market", F.floor(F.col("ts_ms") / SPAN_MS).alias("span")).agg(F.collect_list(F.struct("wallet", "ts_ms")).alias("x"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    packed = rows.select("block", "market", F.transform("x", lambda x: x["wallet"]).alias("wallets"), F.transform("x", lambda x: x["ts_ms"]).alias("times"), other)
    high, low = F.greatest("block", "other"), F.least("block", "other")
    square = F.shiftright(high * (high + 1), 1) + low
    dealt = packed.select(square.alias("square"), (F.col("block") == high).alias("upper"), (F.col("block") == low).alias("lower"), "market", "wallets", "times")
    dealt = dealt.repartitionById(blocks * (blocks + 1) // 2, "square")
    return dealt.mapInArrow(lambda batches: _squares(batches, within), "a long, b long, hits long, n long")


def _squares(batches: Iterator[pa.RecordBatch], within: int) -> Iterator[pa.RecordBatch]:
    """All pairs of the squares of a task, square by square."""
    squares: dict[int, tuple[list, list]] = {}
    codes: dict[str | None, int] = {None: -1}
    for batch in batches:
        square, upper, lower, market, wallets, times = (batch.column(i) for i in range(6))
        for i in range(batch.num_rows):
            code = codes.setdefault(market[i].as_py(), len(codes))
            row = code, *(np.array(x[i].values.to_numpy(), np.int64) for x in (wallets, times))
            for side, there in zip(squares.setdefault(square[i].as_py(), ([], [])), (upper, lower), strict=True):
                if there[i].as_py():
                    side.append(row)
    while squares:
        upper, lower = squares.popitem()[1]
        if upper and lower:
            same = len(upper) == len(lower) and all(x is y for x, y in zip(upper, lower, strict=True))
            a = _Trades(upper)
            yield from _square(a, a if same else _Trades(lower), within)


class _Trades:
    """Trades of a block by market and time, with the number of their wallet and the time of its trade before in the market."""

    def __init__(self, rows: list):
        market = np.repeat(np.array([m for m, *_ in rows]), [len(w) for _, w, _ in rows])
        at = np.concatenate([t for *_, t in rows])
        self.wallets, wallet = np.unique(np.concatenate([w for _, w, _ in rows]), return_inverse=True)
        self.totals = np.bincount(wallet, minlength=len(self.wallets))
        there = market >= 0
        market, at, wallet = market[there], at[there], wallet[there]
        order = np.lexsort((at, wallet, market))
        market, at, wallet = market[order], at[order], wallet[order]
        before = np.full(len(at), _NEVER)
        again = np.flatnonzero((market[1:] == market[:-1]) & (wallet[1:] == wallet[:-1])) + 1
        before[again] = at[again - 1]
        order = np.lexsort((at, market))
        self.market, self.at, self.wallet, self.before = market[order], at[order], wallet[order], before[order]

    def slices(self) -> dict[int, slice]:
        if not len(self.market):
            return {}
        starts = np.flatnonzero(np.diff(self.market, prepend=-1))
        return {int(self.market[s]): slice(s, e) for s, e in zip(starts, [*starts[1:], len(self.market)], strict=True)}


def _square(a: _Trades, b: _Trades, within: int) -> Iterator[pa.RecordBatch]:
    low, high = np.zeros(len(a.at), np.int64), np.zeros(len(a.at), np.int64)
    there = b.slices()
    for market, s in a.slices().items():
        if o := there.get(market):
            low[s] = o.start + np.searchsorted(b.at[o], a.at[s] - within)
            high[s] = o.start + np.searchsorted(b.at[o], a.at[s] + within, "right")
    met = np.flatnonzero(high > low)
    met = met[np.argsort(a.wallet[met], kind="stable")]
    low, n = low[met], (high - low)[met]
    # a wallet that has more pairs goes on in several pieces, whose sums are put together
    for chunk in pieces.chunks(a.wallet[met], n, PIECE_PAIRS):
        yield from _batches(a, b, *pieces.together(_counted(a, b, met[x], low[x], n[x], within) for x in chunk))


def _counted(a: _Trades, b: _Trades, rows: np.ndarray, low: np.ndarray, n: np.ndarray, within: int):
    """Pairs of wallets, as one number each, with the trades of either that have one of the other near.

    A trade counts once however many match: with the first of the other wallet's trades that do, told by the trade before it.
    """
    q = pieces.places(low, n)
    p = np.repeat(rows, n)
    if a is b:
        up = b.wallet[q] > a.wallet[p]
        p, q = p[up], q[up]
    code = (a.wallet[p] * len(b.wallets) + b.wallet[q]) * 4
    code += (b.before[q] < a.at[p] - within) * 2 + (a.before[p] < b.at[q] - within)
    code.sort()
    return pieces.summed(code >> 2, code >> 1 & 1, code & 1, in_order=True)


def _batches(a: _Trades, b: _Trades, pair: np.ndarray, hits_a: np.ndarray, hits_b: np.ndarray, rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(pair), rows):
        x, y = np.divmod(pair[k : k + rows], len(b.wallets))
        n, x, y = np.minimum(a.totals[x], b.totals[y]), a.wallets[x], b.wallets[y]
        for one, two, hits in ((x, y, hits_a), (y, x, hits_b)):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (one, two, hits[k : k + rows], n)], ["a", "b", "hits", "n"])
