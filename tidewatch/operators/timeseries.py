"""Roll-ups of trades and prices over epoch-aligned buckets. Buckets without rows are not made."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import bucket_ms

#: Name -> width; a week by division starts on Thursday, a month is flat.
INTERVALS = {"1m": 60_000, "5m": 300_000, "15m": 900_000, "1h": 3_600_000, "4h": 14_400_000, "1d": 86_400_000, "1w": 604_800_000, "1M": 2_592_000_000}


def ohlcv(rows: DataFrame, width_ms: int, keys: Sequence[str], price: str, volume: str, order: Sequence[str]) -> DataFrame:
    """Open, high, low, close, VWAP, volume and count; the VWAP is the mean price where no volume is.

    order decides first and last; it must be unique in a bucket for the result to be.
    """
    at = F.struct(*order)
    vwap = F.coalesce(F.try_divide(F.sum(F.col(price) * F.col(volume)), F.sum(volume)), F.avg(price))
    return rows.groupBy(*keys, bucket_ms(F.col("ts_ms"), width_ms).alias("bucket")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), vwap.alias("vwap"), F.sum(volume).alias("volume"), F.count("*").alias("n")
    )


def interval_stats(rows: DataFrame, width_ms: int, keys: Sequence[str], large: float) -> DataFrame:
    """Trades, volume, buys, sells, distinct wallets, large trades, mean and largest trade of each bucket."""
    return rows.groupBy(*keys, bucket_ms(F.col("ts_ms"), width_ms).alias("bucket")).agg(
        F.count("*").alias("n"),
        F.sum("usd").alias("volume"),
        F.sum(F.when(F.col("side") == "BUY", F.col("usd")).otherwise(0.0)).alias("buys"),
        F.sum(F.when(F.col("side") == "SELL", F.col("usd")).otherwise(0.0)).alias("sells"),
        F.countDistinct("wallet").alias("wallets"),
        F.count_if(F.col("usd") >= large).alias("large"),
        F.avg("usd").alias("mean"),
        F.max("usd").alias("largest"),
    )


def rolled_up_by_age(rows: DataFrame, now_ms: int, tiers: Sequence[tuple[int, int]], keys: Sequence[str], price: str, volume: str) -> DataFrame:
    """Older rows in wider buckets: tiers are (age in ms, width in ms), the widest that an age reaches counts; younger
    rows than the first tier stay apart by millisecond. Price is volume-weighted, volume summed."""
    width = F.lit(1)
    for age, w in sorted(tiers):
        width = F.when(F.lit(now_ms) - F.col("ts_ms") > age, F.lit(w)).otherwise(width)
    rows = rows.withColumn("width_ms", width.cast("long"))
    start = (F.floor(F.col("ts_ms") / F.col("width_ms")) * F.col("width_ms")).cast("long")
    vwap = F.coalesce(F.try_divide(F.sum(F.col(price) * F.col(volume)), F.sum(volume)), F.avg(price))
    return rows.groupBy(*keys, "width_ms", start.alias("bucket")).agg(vwap.alias("price"), F.sum(volume).alias("volume"), F.count("*").alias("n"))


def zero_filled(counts: DataFrame, key: str, domain: Sequence, value: str) -> DataFrame:
    """One row for each value of a fixed domain."""
    full = counts.sparkSession.createDataFrame([(d,) for d in domain], f"{key} {counts.schema[key].dataType.simpleString()}")
    return full.join(counts, key, "left").select(key, F.coalesce(value, F.lit(0)).cast("long").alias(value))


def trend(current: Column, previous: Column) -> Column:
    """Change in percent, rounded half up; 100 from nothing to something, 0 from nothing to nothing."""
    change = F.floor(F.try_divide(current - previous, previous) * 100 + 0.5)
    return F.when(previous != 0, change).when(current > 0, F.lit(100)).otherwise(F.lit(0)).cast("long")
