"""Episodes of anomalous volume as a stateful stream: they begin, rise to peaks, and end when nothing follows for a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Deviations above the mean of the hours before, hours that this needs, calm hours after which an episode is over.
DEVIATIONS, NEEDED, CALM_HOURS = 1.5, 5, 3
HOUR_MS = 3_600_000
_EVENTS = "market string, kind string, at_ms long, start_ms long, peak double, hours long"


def processor(deviations: float = DEVIATIONS, needed: int = NEEDED, calm: int = CALM_HOURS, hour_ms: int = HOUR_MS) -> StatefulProcessor:
    """The processor of a market's hours. Its class is made here, so that it travels whole: the worker in which Spark asks
    for its state at the driver doesn't import this package."""

    def closes(last: int) -> int:
        """When an episode is over whose last anomalous hour began then; hours come as they end."""
        return last + (calm + 1) * hour_ms

    class Episodes(StatefulProcessor):
        """State of a market: count, mean and squares of its hours, and the episode that is open: start, last hour, peak, hours.

        Hours come as rows (market, start, usd), a few a batch; an event-time timer ends an episode that nothing follows.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("market", "n long, mean double, m2 double, start long, last long, peak double, hours long")

        # Spark passes arguments by these names
        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            n, mean, m2, start, last, peak, hours = self.state.get() if self.state.exists() else (0, 0.0, 0.0, -1, -1, 0.0, 0)
            out = []
            for at, usd in sorted((int(a), float(u)) for batch in rows for a, u in zip(batch.start_ms, batch.usd, strict=True)):
                if start >= 0 and at - last > calm * hour_ms:
                    out.append((key[0], "end", last, start, peak, hours))
                    self.handle.deleteTimer(closes(last))
                    start = -1
                if n >= needed and m2 > 0 and usd >= mean + deviations * (m2 / n) ** 0.5:
                    if start < 0:
                        start, peak, hours = at, usd, 0
                        out.append((key[0], "begin", at, start, usd, 1))
                    else:
                        self.handle.deleteTimer(closes(last))
                        if usd > peak:
                            peak = usd
                            out.append((key[0], "peak", at, start, usd, hours + 1))
                    last, hours = at, hours + 1
                    self.handle.registerTimer(closes(last))
                n += 1
                shift = usd - mean
                mean += shift / n
                m2 += shift * (usd - mean)
            self.state.update((n, mean, m2, start, last, peak, hours))
            yield pd.DataFrame(out, columns=["market", "kind", "at_ms", "start_ms", "peak", "hours"])

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            n, mean, m2, start, last, peak, hours = self.state.get()
            out = []
            if start >= 0 and closes(last) <= expiredTimerInfo.getExpiryTimeInMs():
                out.append((key[0], "end", last, start, peak, hours))
                self.state.update((n, mean, m2, -1, last, 0.0, 0))
            yield pd.DataFrame(out, columns=["market", "kind", "at_ms", "start_ms", "peak", "hours"])

        def close(self) -> None:
            pass

    return Episodes()


def episodes(trades: DataFrame, late: str = "1 hour") -> DataFrame:
    """(market, kind, at_ms, start_ms, peak, hours): events of episodes of a stream of trades(ts, market, usd).

    Hours are summed first, in parallel, so that what reaches a market's state is a row an hour. They are final when the
    watermark has passed them. Needs the RocksDB state store.
    """
    hours = trades.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "market").agg(F.sum("usd").alias("usd"))
    rows = hours.select("market", F.unix_millis("w.start").alias("start_ms"), F.window_time("w").alias("at"), "usd")
    return rows.groupBy("market").transformWithStateInPandas(statefulProcessor=processor(), outputStructType=_EVENTS, outputMode="Append", timeMode="EventTime")
