"""Order books as arrays of levels: aggregation, depth, impact and statistics by walking the levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows with m, the median of the key's values, nulls left out; null where a key has none.

    A key's rows are sorted, which can spill, and its middle ones found by their numbers: rows travel once, and no map of
    a key's values is held or travels. What is then grouped by the key doesn't travel again.
    """
    w = Window.partitionBy(key)
    at, n = F.row_number().over(w.orderBy(F.col(value).asc_nulls_last())), F.count(value).over(w)
    middle = F.when(F.col("_at").isin(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1), F.col(value))
    return rows.withColumn("_at", at).withColumn("_n", n).withColumn("m", F.avg(middle).over(w)).drop("_at", "_n")


def aggregated(levels: DataFrame, interval: float) -> DataFrame:
    """levels(book, side, price, size) on a price grid: bids go down to it, asks up; levels without size go."""
    grid = F.when(F.col("side") == "bid", F.floor(F.col("price") / interval)).otherwise(F.ceil(F.col("price") / interval)) * interval
    return levels.filter("size > 0").groupBy("book", "side", F.round(grid, 9).alias("price")).agg(F.sum("size").alias("size"), F.count("*").alias("levels"))


def with_depth(levels: DataFrame) -> DataFrame:
    """Cumulative size and value from the best price outwards, with the position of the level."""
    best_first = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy("book", "side").orderBy(best_first)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return levels.withColumns({"place": F.row_number().over(w), "depth": F.sum("size").over(run), "value": F.sum(F.col("price") * F.col("size")).over(run)})


def fill_price(levels: DataFrame, side: str, volume: float) -> DataFrame:
    """(book, average, worst) of taking a volume from one side; no row where the side doesn't hold it."""
    d = with_depth(levels).filter(F.col("side") == side)
    taken = F.greatest(F.least(F.col("size"), F.lit(volume) - (F.col("depth") - F.col("size"))), F.lit(0.0))
    a = d.withColumn("taken", taken).filter("taken > 0").groupBy("book").agg(F.sum("taken").alias("got"), F.sum(F.col("taken") * F.col("price")).alias("paid"), F.max_by("price", "place").alias("worst"))
    return a.filter(F.col("got") >= volume - 1e-9).select("book", F.try_divide("paid", "got").alias("average"), "worst")


def book_stats(levels: DataFrame) -> DataFrame:
    """Best prices, spread, middle, volume of the five best levels and the ratio of bids to asks."""
    d = with_depth(levels)
    of = lambda side, c: F.when(F.col("side") == side, F.col(c))
    a = d.groupBy("book").agg(F.max(of("bid", "price")).alias("bid"), F.min(of("ask", "price")).alias("ask"), F.sum(F.when((F.col("side") == "bid") & (F.col("place") <= 5), F.col("size")).otherwise(0.0)).alias("bids"), F.sum(F.when((F.col("side") == "ask") & (F.col("place") <= 5), F.col("size")).otherwise(0.0)).alias("asks"))
    return a.withColumns({"spread": F.col("ask") - F.col("bid"), "middle": (F.col("ask") + F.col("bid")) / 2, "ratio": F.try_divide("bids", "asks")})


def within(levels: DataFrame, share: float) -> DataFrame:
    """(book, side, size) no further than a share of the middle from it."""
    w = Window.partitionBy("book")
    best = F.max(F.when(F.col("side") == "bid", F.col("price"))).over(w), F.min(F.when(F.col("side") == "ask", F.col("price"))).over(w)
    return levels.withColumn("middle", (best[0] + best[1]) / 2).filter(F.abs(F.col("price") - F.col("middle")) <= F.col("middle") * share).groupBy("book", "side").agg(F.sum("size").alias("size"))


def latest(deltas: DataFrame) -> DataFrame:
    """The state of books after all deltas (book, side, price, size, at): the last size of each level, without the empty."""
    return deltas.groupBy("book", "side", "price").agg(F.max_by("size", "at").alias("size")).filter("size > 0")


def expected_impact(usd: Column, depth: Column, coefficient_bps: float = 10.0) -> Column:
    """Basis points for a trade: the coefficient for each percent of the depth, 0.01 for each 100,000 without a book."""
    return F.when(depth > 0, F.try_divide(usd, depth) * 100 * coefficient_bps).otherwise(usd / 1e5 * 0.01 * 1e4)
