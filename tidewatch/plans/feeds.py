"""Feeds and tables as they come and go: wire formats, idempotent appends, upserts, arrays as rows, enriched streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as t
from ..functions import stats
from ..sources import files
from ..streaming import trades as streaming
from .cycles import _folder
from .models import _stream

r = stats.rounded
#: Every how manyth trade comes without an id on the wire, with words for a size, and in seconds instead of milliseconds.
NO_ID, NO_SIZE, IN_SECONDS = 97, 89, 3


def src_parsed_trades(spark, sf):
    """Trades by market from JSON lines on which numbers are strings and some rows are unsound; they are appended twice,
    the second time with rows that are new, and each is there once."""
    e = t.trades(spark, sf).select("trade_id", "market", "side", "usd", "size", "ts_ms")
    n = F.col("trade_id")
    text = lambda c: c.cast("string")
    wire = e.select(
        F.when(n % NO_ID != 0, text(n)).alias("trade_id"), F.concat(F.lit("a-"), "market").alias("asset_id"), "market", F.lower("side").alias("side"), F.lit("1.5").alias("price"),
        F.when(n % NO_SIZE == 0, F.lit("many")).otherwise(text(F.col("size"))).alias("size"), text(F.when(n % IN_SECONDS == 0, F.floor(F.col("ts_ms") / 1000)).otherwise(F.col("ts_ms"))).alias("timestamp"),
    )
    at = _folder(spark, "feed")
    wire.write.json(f"{at}/wire")
    rows = files.parsed_trades(files.raw_trades(spark, f"{at}/wire"), 100.0)
    files.append_new(rows.filter(F.col("trade_id").cast("long") % 2 == 0), f"{at}/table", "trade_id")
    files.append_new(rows, f"{at}/table", "trade_id")
    there = spark.read.parquet(f"{at}/table")
    return there.groupBy("market", "side").agg(F.count("*").alias("n"), F.countDistinct("trade_id").alias("ids"), r(F.sum("usd"), 3).alias("usd"), F.count_if("large").alias("large"), F.min(F.unix_seconds("ts")).alias("first"))


def set_upserted_markets(spark, sf):
    """Markets after two feeds of their fills, the first half and all of them: the first price, the last size and time stay."""
    f = t.fills(spark, sf).filter("market % 10 = 0").groupBy("market", "ts_ms").agg(F.max("price").alias("price"), F.sum("size").alias("size"))
    old = files.merged(f.filter("ts_ms % 172800000 = 0"), f.limit(0), "market", "ts_ms", ["price"])
    return files.merged(old, f.filter("ts_ms % 172800000 != 0"), "market", "ts_ms", ["price"]).select("market", "ts_ms", r("size", 3).alias("size"))


def book_exploded(spark, sf):
    """Books sent as arrays of bids and asks, as rows again, and their sides' best prices by outcome arrays zipped."""
    f = t.fills(spark, sf).groupBy("market", "side").agg(F.array_sort(F.collect_set(F.struct(F.floor("price").cast("double").alias("price"), F.col("size").alias("size")))).alias("levels"))
    books = f.groupBy(F.col("market").cast("string").alias("book")).agg(F.flatten(F.collect_list(F.when(F.col("side") == "BUY", F.col("levels")))).alias("bids"), F.flatten(F.collect_list(F.when(F.col("side") != "BUY", F.col("levels")))).alias("asks"))
    levels = files.exploded_levels(books).groupBy("book", "side").agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))
    sent = levels.groupBy(F.col("book").alias("market")).agg(F.sort_array(F.collect_list(F.struct("side", "n", "high"))).alias("x"))
    sent = sent.select("market", F.transform("x", lambda s: s["side"]).alias("names"), F.transform("x", lambda s: s["n"].cast("string")).alias("tokens"), F.transform("x", lambda s: s["high"].cast("string")).alias("prices"))
    return files.zipped_outcomes(sent).select(F.col("market").cast("long").alias("market"), "place", F.col("name").alias("side"), F.col("token").cast("long").alias("levels"), "price")


def stream_latest_trades(spark, sf):
    """The latest trade of each wallet from a stream enriched with its market's volume and whether the wallet is known,
    through a sink that upserts by batch; known are wallets with an even id."""
    e = t.trades(spark, sf)
    markets = e.groupBy("market").agg(F.count("*").alias("market_trades"))
    known = e.filter("wallet % 2 = 0").select("wallet").distinct()
    out, at = streaming.enriched(_stream(spark, sf), markets, known), _folder(spark, "latest")
    q = out.withColumn("order", F.struct("ts", "trade_id")).writeStream.foreachBatch(streaming.upserting(f"{at}/out", "wallet", "order")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    batches = spark.read.parquet(f"{at}/out")
    last = files.latest_of_each(batches, "wallet", ["ts", "trade_id"])
    return last.select("wallet", "trade_id", "market", F.unix_millis("ts").alias("ts_ms"), "usd", "market_trades", "new_wallet")


QUERIES = {f.__name__: f for f in (src_parsed_trades, set_upserted_markets, book_exploded, stream_latest_trades)}

ORACLE_SQL = {
    "src_parsed_trades": t.sql(
        "trades",
        f"""SELECT market, side, count(*) AS n, count(DISTINCT trade_id) AS ids, round(sum(1.5 * size), 3) AS usd, count(*) FILTER (1.5 * size >= 100) AS large, min(ts_ms // 1000) AS first FROM trades
        WHERE trade_id % {NO_ID} != 0 AND trade_id % {NO_SIZE} != 0 AND size > 0 GROUP BY ALL""",
    ),
    "set_upserted_markets": t.sql(
        "fills",
        ",f AS (SELECT market, ts_ms, sum(size) AS size FROM fills WHERE market % 10 = 0 GROUP BY ALL) SELECT market, max(ts_ms) AS ts_ms, round(arg_max(size, ts_ms), 3) AS size FROM f GROUP BY market",
    ),
    "book_exploded": t.sql(
        "fills",
        """,l AS (SELECT DISTINCT market, CASE WHEN side = 'BUY' THEN 'bid' ELSE 'ask' END AS side, floor(price) AS price, size FROM fills),
        s AS (SELECT market, side, count(*) AS levels, max(price) AS price FROM l GROUP BY ALL)
        SELECT market, (row_number() OVER (PARTITION BY market ORDER BY side) - 1)::INT AS place, side, levels, price FROM s""",
    ),
    "stream_latest_trades": t.sql(
        "trades",
        """,m AS (SELECT market, count(*) AS market_trades FROM trades GROUP BY market), x AS (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY ts_ms DESC, trade_id DESC) AS i FROM trades)
        SELECT wallet, trade_id, market, ts_ms, usd, market_trades, wallet % 2 != 0 AS new_wallet FROM x JOIN m USING (market) WHERE i = 1""",
    ),
}
