"""Bindings of the star-schema tables to trading concepts; see README for the rules.

Every time is epoch milliseconds in UTC, a long named ts_ms, so that nothing depends on a session's time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000, 86_400_000

#: The same bindings for the SQL that queries are compared with, as common table expressions.
SQL = {
    "trades": """trades AS (SELECT event_id AS trade_id, epoch_us(ts) // 1000 AS ts_ms, user_id AS wallet, event_type AS market, value AS usd,
        CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) AS size FROM events)""",
    "fills": """fills AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS market, o_custkey AS wallet, l_suppkey AS counterparty, epoch_us(l_shipdate) // 1000 AS ts_ms,
        l_extendedprice AS usd, l_quantity AS size, l_extendedprice / l_quantity AS price, CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS side,
        l_returnflag = 'N' AS win, l_extendedprice * (1 - l_discount) * (1 + l_tax) - l_extendedprice AS pnl
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "markets": "markets AS (SELECT p_partkey AS market, p_name AS title, p_brand AS brand, split_part(p_type, ' ', 1) AS category, p_size AS size_class, p_retailprice AS list_price FROM part)",
    "wallets": "wallets AS (SELECT c_custkey AS wallet, c_name AS label, c_mktsegment AS kind, c_acctbal AS balance, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)",
}


def sql(names: str, body: str) -> str:
    """Body with the named bindings before it; rounding is that of functions.stats.rounded."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body.replace("round(", "round(1e-7 + ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ms(name: str):
    return F.floor(F.unix_micros(F.col(name).cast("timestamp")) / 1000).cast("long")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fine-grained trade stream: events, side by the parity of event_id, size from the properties."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("trade_id"),
        _ms("ts").alias("ts_ms"),
        F.col("user_id").alias("wallet"),
        F.col("event_type").alias("market"),
        F.col("value").alias("usd"),
        F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.get_json_object("props", "$.k").try_cast("double").alias("size"),
    )


#: Orders that are broadcast at most, once they are counted.
MOST_BROADCAST = 2_000_000


def fills(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """The large trade fact: line items with the wallet of their order, `of` these wallets if given. (order_id, line) is not unique.

    Where the wallets have few orders, these are broadcast, so that the line items need no shuffle.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    if of is not None:
        orders = orders.join(of, orders["o_custkey"] == of["wallet"], "left_semi").checkpoint()
        if orders.count() <= MOST_BROADCAST:
            orders = F.broadcast(orders)
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("market"),
        F.col("o_custkey").alias("wallet"),
        F.col("l_suppkey").alias("counterparty"),
        _ms("l_shipdate").alias("ts_ms"),
        F.col("l_extendedprice").alias("usd"),
        F.col("l_quantity").alias("size"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"),
        (F.col("l_returnflag") == "N").alias("win"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) - F.col("l_extendedprice")).alias("pnl"),
    )


def line_ends(spark: SparkSession, sf_dir: str) -> tuple[int | None, int | None]:
    """The first and the last time of all line items, from a scan without a join: fills lie between them."""
    at = _ms("l_shipdate")
    return tuple(table(spark, sf_dir, "lineitem").agg(F.min(at), F.max(at)).first())


#: Rows that one task takes, about, where fills are gathered by market.
TASK_ROWS = 400_000


def by_market(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """These columns of the fills, dealt by market to as many tasks as the line items need, so that a task's share stays.

    Narrow rows grow when they are sorted and summed: partitions merged by their bytes would hold millions of them.
    """
    tasks = -(-table(spark, sf_dir, "lineitem").count() // TASK_ROWS)
    return fills(spark, sf_dir).select("market", *columns).filter("market is not null").repartition(max(1, tasks), "market")


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("market"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.substring_index("p_type", " ", 1).alias("category"), F.col("p_size").alias("size_class"), F.col("p_retailprice").alias("list_price")
    )


def wallets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return joined.select(F.col("c_custkey").alias("wallet"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("balance"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
