"""Readers and writers: parquet, JSON and CSV with fixed schemas, streams of files, and idempotent sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRADE = "trade_id string, asset_id string, market string, maker string, taker string, side string, price string, size string, timestamp string"


def raw_trades(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of trades; numbers are strings on the wire. A line that doesn't parse keeps its text in _corrupt."""
    return spark.read.schema(TRADE + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def parsed_trades(raw: DataFrame, large: float = 10_000.0) -> DataFrame:
    """Typed trades: value = price times size; rows without an id, a price, or a size above 0 go. Times are epoch
    seconds or milliseconds, or ISO; what none of these reads is null."""
    n = F.col("timestamp").try_cast("double")
    ts = F.coalesce(F.timestamp_millis(F.when(n.isNotNull(), F.when(n < 1e11, n * 1000).otherwise(n)).cast("long")), F.try_to_timestamp("timestamp"))
    typed = raw.withColumns({"price": F.col("price").try_cast("double"), "size": F.col("size").try_cast("double"), "side": F.upper("side"), "ts": ts})
    sound = typed.filter("trade_id is not null and price is not null and not isnan(price) and size > 0 and not isnan(size)")
    return sound.withColumn("usd", F.col("price") * F.col("size")).withColumn("large", F.col("usd") >= large).drop("timestamp")


def trade_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """The same JSON as a stream of files; at most `files` new ones a trigger."""
    return spark.readStream.schema(TRADE).option("maxFilesPerTrigger", files).json(path)


def append_new(rows: DataFrame, path: str, key: str, partition: str | None = None) -> None:
    """Append the rows whose key the table doesn't have, each key once. A missing table is made."""
    spark = rows.sparkSession
    once = rows.dropDuplicates([key])
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        once = once.join(spark.read.parquet(path).select(key), key, "left_anti")
    writer = once.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def merged(old: DataFrame, new: DataFrame, key: str, arrival: str, keep_first: Sequence[str]) -> DataFrame:
    """Upsert as a full rewrite: of each key the first arrival's economic columns and the last one's others."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c != key and c not in keep_first]
    return both.groupBy(key).agg(*[F.min_by(c, arrival).alias(c) for c in keep_first], *[F.max_by(c, arrival).alias(c) for c in rest]).select(*both.columns)


def retained(rows: DataFrame, cutoff_ms: int) -> tuple[DataFrame, DataFrame]:
    """(what stays, what is archived) by age."""
    return rows.filter(F.col("ts_ms") >= cutoff_ms), rows.filter(F.col("ts_ms") < cutoff_ms)


def exploded_levels(books: DataFrame) -> DataFrame:
    """Books with arrays of bids and asks as level rows."""
    side = lambda name, label: books.select("book", F.lit(label).alias("side"), F.inline(name))
    return side("bids", "bid").unionByName(side("asks", "ask"))


def zipped_outcomes(markets: DataFrame) -> DataFrame:
    """Parallel arrays of names, tokens and prices as a row each; the shorter ones end in nulls."""
    return markets.select("market", F.posexplode(F.arrays_zip("names", "tokens", "prices")).alias("place", "x")).select("market", "place", F.col("x.names").alias("name"), F.col("x.tokens").alias("token"), F.col("x.prices").try_cast("double").alias("price"))


def latest_of_each(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")
