"""Streaming twins of the trade operators. Each takes a streaming DataFrame with an event time and gives one back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(trades: DataFrame, key: str = "trade_id", late: str = "1 hour") -> DataFrame:
    """Each key once while the watermark keeps it; later repeats within the bound are dropped."""
    return trades.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def windowed_volume(trades: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and volume of each market and event-time window, final once the watermark has passed its end."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return trades.withWatermark("ts", late).groupBy(w.alias("w"), "market").agg(F.count("*").alias("n"), F.sum("usd").alias("usd")).select("market", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "usd")


def bursts(trades: DataFrame, large: float, gap: str = "5 minutes", least: int = 3, late: str = "10 minutes") -> DataFrame:
    """Sessions of large trades of a market; smaller trades in between don't count. A session closes on the watermark."""
    s = trades.filter(F.col("usd") >= large).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "market").agg(F.count("*").alias("n"), F.sum("usd").alias("usd"))
    return s.filter(F.col("n") >= least).select("market", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "usd")


def enriched(trades: DataFrame, markets: DataFrame, wallets: DataFrame) -> DataFrame:
    """Stream-static joins: trades of unknown markets go, unknown wallets are flagged as new."""
    known = wallets.select("wallet", F.lit(True).alias("_known"))
    return trades.join(markets, "market").join(known, "wallet", "left").withColumn("new_wallet", F.col("_known").isNull()).drop("_known")


def spikes(trades: DataFrame, z: float = 2.0, least: int = 5, cooldown_s: int = 60, late: str | None = "10 minutes") -> DataFrame:
    """Trades whose value lies z deviations above what the market has seen before, no closer than the cooldown.

    The state of a market is count, mean, sum of squared differences and the time of the last spike: bounded, whatever
    the history. Times are whole milliseconds, as everywhere; of one instant the smaller trade_id is first. A market
    without trades for a day is forgotten. late: None if the stream has a watermark.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, mean, m2, last = state.get if state.exists else (0, 0.0, 0.0, -1)
        found = []
        rows = pd.concat(list(batches)).sort_values(["ts_ms", "trade_id"])
        for trade, at, ms, usd in zip(rows.trade_id, rows.ts, rows.ts_ms.tolist(), rows.usd, strict=True):
            std = (m2 / n) ** 0.5 if n else 0.0
            if n >= least and std > 0 and usd - mean >= z * std and (last < 0 or ms - last >= cooldown_s * 1000):
                found.append((key[0], trade, at, (usd - mean) / std))
                last = ms
            n += 1
            shift = usd - mean
            mean += shift / n
            m2 += shift * (usd - mean)
        state.update((n, mean, m2, last))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows.ts_ms.max())) + 86_400_000)
        yield pd.DataFrame(found, columns=["market", "trade_id", "ts", "z"])

    marked = trades.withWatermark("ts", late) if late else trades
    return marked.select("market", "trade_id", "ts", F.unix_millis("ts").alias("ts_ms"), "usd").groupBy("market").applyInPandasWithState(step, "market string, trade_id long, ts timestamp, z double", "n long, mean double, m2 double, last long", "append", "EventTimeTimeout")


def upserting(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: batches land in a folder each, so that a batch that is written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
