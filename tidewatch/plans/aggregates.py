"""Queries over buckets, categories and totals."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import tables as t
from ..functions import stats
from ..operators import timeseries as ts

LARGE = 900.0
#: The end of the events, fixed so that "now" never moves; queries take it as the last millisecond seen.
_MAX = "(SELECT max(ts_ms) AS now FROM trades)"


def _rounded(df, *names, places=4):
    return df.withColumns({n: stats.rounded(n, places) for n in names})


def ts_ohlcv(spark, sf):
    out = ts.ohlcv(t.trades(spark, sf), t.HOUR, ["market"], "usd", "size", ["ts_ms", "trade_id"])
    return _rounded(out, "vwap", "volume")


def ts_ohlcv_daily_fills(spark, sf):
    """By category and day over the large fact; the dimension is joined after the pre-aggregation by market."""
    by_market = t.fills(spark, sf).groupBy("market", stats.bucket_ms(F.col("ts_ms"), t.DAY).alias("bucket")).agg(F.sum(F.col("price") * F.col("size")).alias("pv"), F.sum("size").alias("v"), F.max("price").alias("high"), F.min("price").alias("low"), F.count("*").alias("n"))
    out = by_market.join(t.markets(spark, sf).select("market", "category"), "market").groupBy("category", "bucket").agg(F.try_divide(F.sum("pv"), F.sum("v")).alias("vwap"), F.sum("v").alias("volume"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("n").alias("n"))
    return _rounded(out, "vwap", "volume", "high", "low")


def ts_interval_stats(spark, sf):
    return _rounded(ts.interval_stats(t.trades(spark, sf), 4 * t.HOUR, ["market"], LARGE), "volume", "buys", "sells", "mean")


def ts_rolled_up_by_age(spark, sf):
    """Age tiers on the days of the events: over 2, 7 and 20 days old into hours, four hours and days."""
    rows = t.trades(spark, sf)
    now = rows.agg(F.max("ts_ms")).first()[0] or 0
    out = ts.rolled_up_by_age(rows, now, [(2 * t.DAY, t.HOUR), (7 * t.DAY, 4 * t.HOUR), (20 * t.DAY, t.DAY)], ["market"], "usd", "size")
    return _rounded(out, "price", "volume")


def ts_week_from_sunday(spark, sf):
    rows = t.trades(spark, sf)
    return _rounded(rows.groupBy(stats.sunday_week_ms(F.col("ts_ms")).alias("week")).agg(F.avg("usd").alias("price"), F.sum("usd").alias("volume"), F.count("*").alias("n")), "price", "volume")


def ts_retention(spark, sf):
    rows = t.trades(spark, sf)
    now = rows.agg(F.max("ts_ms").alias("now"))
    return rows.join(F.broadcast(now), F.col("ts_ms") >= F.col("now") - 7 * t.DAY).groupBy("market").agg(F.count("*").alias("kept"), F.min("ts_ms").alias("first"))  # one row


def agg_trade_stats(spark, sf):
    return _rounded(t.fills(spark, sf).agg(F.count("*").alias("n"), F.coalesce(F.sum("usd"), F.lit(0.0)).alias("volume"), F.coalesce(F.avg("usd"), F.lit(0.0)).alias("mean"), F.min("usd").alias("least"), F.max("usd").alias("most")), "volume", "mean", places=2)


def agg_market_stats(spark, sf):
    out = t.fills(spark, sf).groupBy("market").agg(F.count("*").alias("n"), F.sum("usd").alias("volume"), F.avg("usd").alias("mean"), F.countDistinct("wallet").alias("traders"))
    return _rounded(out, "volume", "mean", places=2)


def agg_wallet_stats(spark, sf):
    f = t.fills(spark, sf)
    out = f.groupBy("wallet").agg(F.count("*").alias("n"), F.sum("usd").alias("volume"), F.count_if(F.col("side") == "BUY").alias("buys"), F.count_if(F.col("side") == "SELL").alias("sells"), F.count_if("win").alias("wins"), F.countDistinct("market").alias("markets"), F.max("usd").alias("largest"))
    return _rounded(out, "volume", places=2)


def agg_stream_stats(spark, sf):
    """Volume, VWAP, buy/sell ratio (null without sells), trades a second and distinct wallets of each market."""
    out = t.trades(spark, sf).groupBy("market").agg(
        F.count("*").alias("n"), F.sum(F.col("usd") * F.col("size")).alias("pv"), F.sum("size").alias("volume"), F.try_divide(F.count_if(F.col("side") == "BUY"), F.count_if(F.col("side") == "SELL")).alias("buy_sell"),
        F.try_divide(F.count("*") * 1000.0, F.max("ts_ms") - F.min("ts_ms")).alias("per_second"), F.countDistinct("wallet").alias("wallets"),
    )
    return _rounded(out.select("market", "n", F.try_divide("pv", "volume").alias("vwap"), "volume", "buy_sell", stats.rounded("per_second", 8).alias("per_second"), "wallets"), "vwap", "volume", "buy_sell")


def agg_usd_summary(spark, sf):
    """Totals by side and over all, with fees of 30 basis points."""
    f = t.fills(spark, sf).withColumn("fee", F.col("usd") * 30 / 10_000)
    out = f.rollup("side").agg(F.count("*").alias("n"), F.sum("usd").alias("usd"), F.sum("fee").alias("fees"), F.sum(F.col("usd") + F.col("fee")).alias("gross"))
    return _rounded(out.withColumn("side", F.coalesce("side", F.lit("ALL"))), "usd", "fees", "gross", places=2)


def agg_dashboard(spark, sf):
    """The last day against the one before in one pass."""
    rows = t.trades(spark, sf)
    rows = rows.join(F.broadcast(rows.agg(F.max("ts_ms").alias("now"))), F.col("ts_ms") > F.col("now") - 2 * t.DAY)  # one row
    new = F.col("ts_ms") > F.col("now") - t.DAY
    count, usd = (lambda c: F.count_if(c)), (lambda c: F.coalesce(F.sum(F.when(c, F.col("usd"))), F.lit(0.0)))
    large = F.col("usd") >= LARGE
    distinct = lambda c: F.countDistinct(F.when(c, F.col("wallet")))
    out = rows.agg(*[x for name, f in (("trades", count), ("volume", usd), ("wallets", distinct)) for x in (f(new).alias(name), f(~new).alias(f"{name}_before"))], count(new & large).alias("large"), count(~new & large).alias("large_before"))
    names = ("trades", "volume", "wallets", "large")
    return _rounded(out.select(*out.columns, *[ts.trend(F.col(n), F.col(f"{n}_before")).alias(f"{n}_trend") for n in names]), "volume", "volume_before", places=2)


def agg_by_region_zero_filled(spark, sf):
    counts = t.wallets(spark, sf).groupBy(F.col("region").alias("name")).agg(F.count("*").alias("n"))
    return ts.zero_filled(counts, "name", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "OCEANIA"], "n")


def agg_by_kind(spark, sf):
    return t.wallets(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), stats.rounded(F.avg("balance"), 4).alias("balance"))


def agg_alert_stats(spark, sf):
    """Alerts are large fills; counts by severity, by side and over all in one pass of grouping sets."""
    rank = stats.ladder(F.col("usd"), [(90_000, "critical"), (70_000, "high"), (50_000, "medium")], "low")
    a = t.fills(spark, sf).filter("usd >= 40000").withColumn("severity", rank)
    sets = a.groupingSets([["severity"], ["side"], []], "severity", "side").agg(F.count("*").alias("n"))
    return sets.select(F.coalesce("severity", F.lit("*")).alias("severity"), F.coalesce("side", F.lit("*")).alias("side"), "n")


def agg_category_shares(spark, sf):
    """Share of each wallet's trades and volume by category, for wallets with the normalised concentration."""
    f = t.fills(spark, sf).join(t.markets(spark, sf).select("market", "category"), "market")
    by = f.groupBy("wallet", "category").agg(F.count("*").alias("n"), F.sum("usd").alias("usd"))
    w = Window.partitionBy("wallet")
    return by.select("wallet", "category", "n", stats.rounded(F.try_divide("n", F.sum("n").over(w)), 6).alias("trade_share"), stats.rounded(F.try_divide("usd", F.sum("usd").over(w)), 6).alias("volume_share"))


def agg_concentration(spark, sf):
    """Herfindahl index over categories, its normalised form (1 for a single key), the primary share and the score."""
    f = t.fills(spark, sf).join(t.markets(spark, sf).select("market", "category"), "market")
    by = f.groupBy("wallet", "category").agg(F.sum("usd").alias("usd"))
    share = by.withColumn("share", F.try_divide("usd", F.sum("usd").over(Window.partitionBy("wallet"))))
    out = share.groupBy("wallet").agg(F.sum(F.col("share") * F.col("share")).alias("hhi"), F.max("share").alias("primary"), F.count("*").alias("k"))
    norm = F.when(F.col("k") == 1, 1.0).otherwise(F.try_divide(F.col("hhi") - 1 / F.col("k"), 1 - 1 / F.col("k")))
    even = stats.clamp((F.col("hhi") - 1 / 14) / (1 - 1 / 14), 0.0, 1.0)
    score = stats.clamp(40 * even + 60 * F.col("primary"), 0.0, 100.0)
    return out.select("wallet", stats.rounded("hhi", 5).alias("hhi"), stats.rounded(norm, 5).alias("hhi_normalised"), stats.rounded("primary", 5).alias("primary_share"), stats.rounded(score, 3).alias("score"))


def agg_gini(spark, sf):
    """Gini coefficient of each market's trade sizes in its rank form."""
    f = t.fills(spark, sf)
    w = Window.partitionBy("market")
    r = f.select("market", "usd", F.row_number().over(w.orderBy("usd")).alias("i"), F.count("*").over(w).alias("n"))
    return r.groupBy("market").agg(stats.rounded(F.coalesce(F.try_divide(F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("usd")), F.max("n") * F.sum("usd")), F.lit(0.0)), 5).alias("gini"))


def agg_window_distribution(spark, sf):
    """Mean, median, population deviation, percentiles and variation of hourly volumes of each market."""
    v = t.trades(spark, sf).groupBy("market", stats.bucket_ms(F.col("ts_ms"), t.HOUR).alias("b")).agg(F.sum("usd").alias("v"))
    p = F.percentile("v", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.95)]))
    out = v.groupBy("market").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most"), p.alias("p"))
    names = ("p25", "median", "p75", "p95")
    out = out.select("market", "n", "mean", "std", "least", "most", *[F.col("p")[i].alias(x) for i, x in enumerate(names)], F.try_divide("std", "mean").alias("variation"))
    return _rounded(out, "mean", "std", "least", "most", *names, "variation")


def agg_trade_size_stats(spark, sf):
    """Percentiles, adjusted skewness and variation of the last 10,000 trades of each market."""
    w = Window.partitionBy("market").orderBy(F.desc("ts_ms"), F.desc("trade_id"))
    last = t.trades(spark, sf).withColumn("i", F.row_number().over(w)).filter("i <= 10000")
    usd = F.col("usd")
    a = last.groupBy("market").agg(F.count("*").alias("n"), F.avg("usd").alias("mean"), F.stddev_pop("usd").alias("std"), F.sum("usd").alias("s1"), F.sum(usd * usd).alias("s2"), F.sum(usd * usd * usd).alias("s3"), F.percentile("usd", F.array(*[F.lit(x) for x in (0.1, 0.5, 0.9, 0.99, 0.999)])).alias("p"))
    skew = stats.adjusted_skewness(F.col("n"), F.col("mean"), F.col("std"), F.col("s3"), F.col("s2"), F.col("s1"))
    out = a.select("market", "n", "mean", "std", skew.alias("skewness"), F.try_divide("std", "mean").alias("variation"), *[F.col("p")[i].alias(x) for i, x in enumerate(("p10", "p50", "p90", "p99", "p999"))])
    return _rounded(out, "mean", "std", "skewness", "variation", "p10", "p50", "p90", "p99", "p999", places=3)


def agg_position_sizing(spark, sf):
    """Sample deviation, moment skewness and excess kurtosis of each wallet's position sizes."""
    f, usd = t.fills(spark, sf), F.col("usd")
    a = f.groupBy("wallet").agg(F.count("*").alias("n"), F.avg("usd").alias("m"), F.stddev_samp("usd").alias("s"), F.avg(usd * usd).alias("q2"), F.avg(usd * usd * usd).alias("q3"), F.median("usd").alias("median")).filter("n >= 3")
    m3 = F.col("q3") - 3 * F.col("m") * F.col("q2") + 2 * F.col("m") * F.col("m") * F.col("m")
    return a.select("wallet", "n", stats.rounded("m", 2).alias("mean"), stats.rounded("s", 2).alias("std"), stats.rounded("median", 2).alias("median"), stats.rounded(F.when(F.col("s") > 0, m3 / F.pow("s", F.lit(3.0))).otherwise(0.0), 4).alias("skewness"))


def agg_hour_histogram(spark, sf):
    """Trades and volume of the 24 hours of the day (UTC), zero-filled."""
    counts = t.trades(spark, sf).groupBy((F.floor(F.col("ts_ms") / t.HOUR) % 24).alias("hour")).agg(F.count("*").alias("n"), F.sum("usd").alias("usd"))
    return spark.range(24).select(F.col("id").alias("hour")).join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"), stats.rounded(F.coalesce("usd", F.lit(0.0)), 4).alias("usd"))


def agg_day_histogram(spark, sf):
    """Trades of the seven days of the week, Sunday first, zero-filled."""
    day = F.pmod(F.floor(F.col("ts_ms") / t.DAY) + 4, F.lit(7))
    counts = t.trades(spark, sf).groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    return spark.range(7).select(F.col("id").alias("day")).join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def agg_hour_baseline(spark, sf):
    """Per market and hour of day: mean and deviation of hourly volume, and the factor to the overall mean."""
    v = t.trades(spark, sf).groupBy("market", stats.bucket_ms(F.col("ts_ms"), t.HOUR).alias("b")).agg(F.sum("usd").alias("v"))
    by = v.groupBy("market", (F.floor(F.col("b") / t.HOUR) % 24).alias("hour")).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("*").alias("n"), F.sum("v").alias("total"))
    w = Window.partitionBy("market")
    overall = F.try_divide(F.sum("total").over(w), F.sum("n").over(w))
    period = F.when(F.col("hour").between(14, 20), "peak").when((F.col("hour") >= 22) | (F.col("hour") < 6), "off").otherwise("standard")
    return _rounded(by.select("market", "hour", "n", "mean", "std", F.try_divide(overall, F.col("mean")).alias("factor"), period.alias("period")), "mean", "std", "factor")


def agg_win_windows(spark, sf):
    """Wins, losses, profit factor (null without losses) and mean profit of each wallet in look-back windows."""
    f = t.fills(spark, sf)
    now = f.agg(F.max("ts_ms").alias("now"))
    windows = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(d).alias("days")) for n, d in (("30d", 30), ("365d", 365), ("all", 100_000))])
    rows = f.crossJoin(F.broadcast(now)).select("wallet", "win", "pnl", "ts_ms", "now", F.inline(windows)).filter(F.col("ts_ms") >= F.col("now") - F.col("days").cast("long") * F.lit(t.DAY))  # one row
    out = rows.groupBy("wallet", "window").agg(F.count_if("win").alias("wins"), F.count_if(~F.col("win")).alias("losses"), F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))).alias("up"), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl"))).alias("down"), F.avg("pnl").alias("mean"))
    return out.select("wallet", "window", "wins", "losses", stats.rounded(F.try_divide("up", "down"), 4).alias("profit_factor"), stats.rounded("mean", 2).alias("mean"))


def agg_category_win_rates(spark, sf):
    f = t.fills(spark, sf).join(t.markets(spark, sf).select("market", "category"), "market")
    return f.groupBy("category").agg(F.count("*").alias("n"), F.count_if("win").alias("wins"), stats.rounded(F.try_divide(F.count_if("win") * 100.0, F.count("*")), 4).alias("win_rate"), stats.rounded(F.sum("pnl"), 2).alias("pnl"))


def agg_weighted_accuracy(spark, sf):
    """Raw and conviction-weighted accuracy of each wallet; conviction follows the size of the position."""
    weight = F.when(F.col("usd") >= 80_000, 2.0).when(F.col("usd") >= 50_000, 1.5).when(F.col("usd") >= 20_000, 1.0).when(F.col("usd") >= 5_000, 0.5).otherwise(0.2)
    f = t.fills(spark, sf).withColumn("w", weight)
    out = f.groupBy("wallet").agg(F.count("*").alias("n"), F.try_divide(F.count_if("win") * 100.0, F.count("*")).alias("accuracy"), (F.try_divide(F.sum(F.when(F.col("win"), F.col("w")).otherwise(0.0)), F.sum("w")) * 100).alias("weighted"))
    tier = stats.ladder(stats.rounded("accuracy", 6), [(90, "exceptional"), (80, "excellent"), (70, "very_good"), (60, "good"), (55, "above_average"), (50, "average"), (40, "below_average")], "poor")
    return _rounded(out.withColumn("tier", tier), "accuracy", "weighted")


QUERIES = {f.__name__: f for f in (
    ts_ohlcv, ts_ohlcv_daily_fills, ts_interval_stats, ts_rolled_up_by_age, ts_week_from_sunday, ts_retention, agg_trade_stats, agg_market_stats, agg_wallet_stats, agg_stream_stats, agg_usd_summary, agg_dashboard,
    agg_by_region_zero_filled, agg_by_kind, agg_alert_stats, agg_category_shares, agg_concentration, agg_gini, agg_window_distribution, agg_trade_size_stats, agg_position_sizing, agg_hour_histogram, agg_day_histogram,
    agg_hour_baseline, agg_win_windows, agg_category_win_rates, agg_weighted_accuracy,
)}

_HOURLY = "v AS (SELECT market, ts_ms // 3600000 * 3600000 AS b, sum(usd) AS v FROM trades GROUP BY ALL)"
_BY_CATEGORY = "c AS (SELECT f.*, category FROM fills f JOIN markets m ON f.market = m.market)"

ORACLE_SQL = {
    "ts_ohlcv": t.sql("trades", "SELECT market, ts_ms // 3600000 * 3600000 AS bucket, arg_min(usd, (ts_ms, trade_id)) AS open, max(usd) AS high, min(usd) AS low, arg_max(usd, (ts_ms, trade_id)) AS close, round(coalesce(sum(usd * size) / nullif(sum(size), 0), avg(usd)), 4) AS vwap, round(sum(size), 4) AS volume, count(*) AS n FROM trades GROUP BY ALL"),
    "ts_ohlcv_daily_fills": t.sql("fills markets", "SELECT category, ts_ms // 86400000 * 86400000 AS bucket, round(sum(price * size) / sum(size), 4) AS vwap, round(sum(size), 4) AS volume, round(max(price), 4) AS high, round(min(price), 4) AS low, count(*) AS n FROM fills f JOIN markets m ON f.market = m.market GROUP BY ALL"),
    "ts_interval_stats": t.sql("trades", f"SELECT market, ts_ms // 14400000 * 14400000 AS bucket, count(*) AS n, round(sum(usd), 4) AS volume, round(coalesce(sum(usd) FILTER (side = 'BUY'), 0), 4) AS buys, round(coalesce(sum(usd) FILTER (side = 'SELL'), 0), 4) AS sells, count(DISTINCT wallet) AS wallets, count(*) FILTER (usd >= {LARGE}) AS large, round(avg(usd), 4) AS mean, max(usd) AS largest FROM trades GROUP BY ALL"),
    "ts_rolled_up_by_age": t.sql("trades", f"SELECT market, w AS width_ms, ts_ms // w * w AS bucket, round(coalesce(sum(usd * size) / nullif(sum(size), 0), avg(usd)), 4) AS price, round(sum(size), 4) AS volume, count(*) AS n FROM (SELECT *, (CASE WHEN now - ts_ms > 20 * 86400000 THEN 86400000 WHEN now - ts_ms > 7 * 86400000 THEN 14400000 WHEN now - ts_ms > 2 * 86400000 THEN 3600000 ELSE 1 END)::BIGINT AS w FROM trades, {_MAX}) GROUP BY ALL"),
    "ts_week_from_sunday": t.sql("trades", "SELECT (ts_ms // 86400000 - (ts_ms // 86400000 + 4) % 7) * 86400000 AS week, round(avg(usd), 4) AS price, round(sum(usd), 4) AS volume, count(*) AS n FROM trades GROUP BY ALL"),
    "ts_retention": t.sql("trades", f"SELECT market, count(*) AS kept, min(ts_ms) AS first FROM trades, {_MAX} WHERE ts_ms >= now - 7 * 86400000 GROUP BY ALL"),
    "agg_trade_stats": t.sql("fills", "SELECT count(*) AS n, round(coalesce(sum(usd), 0), 2) AS volume, round(coalesce(avg(usd), 0), 2) AS mean, min(usd) AS least, max(usd) AS most FROM fills"),
    "agg_market_stats": t.sql("fills", "SELECT market, count(*) AS n, round(sum(usd), 2) AS volume, round(avg(usd), 2) AS mean, count(DISTINCT wallet) AS traders FROM fills GROUP BY market"),
    "agg_wallet_stats": t.sql("fills", "SELECT wallet, count(*) AS n, round(sum(usd), 2) AS volume, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells, count(*) FILTER (win) AS wins, count(DISTINCT market) AS markets, max(usd) AS largest FROM fills GROUP BY wallet"),
    "agg_stream_stats": t.sql("trades", "SELECT market, count(*) AS n, round(sum(usd * size) / nullif(sum(size), 0), 4) AS vwap, round(sum(size), 4) AS volume, round(count(*) FILTER (side = 'BUY') / nullif(count(*) FILTER (side = 'SELL'), 0), 4) AS buy_sell, round(count(*) * 1000.0 / nullif(max(ts_ms) - min(ts_ms), 0), 8)::DOUBLE AS per_second, count(DISTINCT wallet) AS wallets FROM trades GROUP BY market"),
    "agg_usd_summary": t.sql("fills", "SELECT coalesce(side, 'ALL') AS side, count(*) AS n, round(sum(usd), 2) AS usd, round(sum(usd * 30 / 10000), 2) AS fees, round(sum(usd + usd * 30 / 10000), 2) AS gross FROM fills GROUP BY ROLLUP (side)"),
    "agg_dashboard": t.sql("trades", f"""SELECT *, {", ".join(f"CASE WHEN {n}_before != 0 THEN floor(({n} - {n}_before) / {n}_before * 100 + 0.5) WHEN {n} > 0 THEN 100 ELSE 0 END::BIGINT AS {n}_trend" for n in ("trades", "volume", "wallets", "large"))} FROM (
        SELECT count(*) FILTER (new) AS trades, count(*) FILTER (NOT new) AS trades_before, round(coalesce(sum(usd) FILTER (new), 0), 2) AS volume, round(coalesce(sum(usd) FILTER (NOT new), 0), 2) AS volume_before,
        count(DISTINCT wallet) FILTER (new) AS wallets, count(DISTINCT wallet) FILTER (NOT new) AS wallets_before, count(*) FILTER (new AND usd >= {LARGE}) AS large, count(*) FILTER (NOT new AND usd >= {LARGE}) AS large_before
        FROM (SELECT *, ts_ms > now - 86400000 AS new FROM trades, {_MAX} WHERE ts_ms > now - 2 * 86400000))"""),
    "agg_by_region_zero_filled": t.sql("wallets", "SELECT name, count(wallet) AS n FROM (SELECT unnest(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST', 'OCEANIA']) AS name) LEFT JOIN wallets ON region = name GROUP BY name"),
    "agg_by_kind": t.sql("wallets", "SELECT kind, count(*) AS n, round(avg(balance), 4) AS balance FROM wallets GROUP BY kind"),
    "agg_alert_stats": t.sql("fills", "SELECT coalesce(severity, '*') AS severity, coalesce(side, '*') AS side, count(*) AS n FROM (SELECT side, CASE WHEN usd >= 90000 THEN 'critical' WHEN usd >= 70000 THEN 'high' WHEN usd >= 50000 THEN 'medium' ELSE 'low' END AS severity FROM fills WHERE usd >= 40000) GROUP BY GROUPING SETS ((severity), (side), ())"),
    "agg_category_shares": t.sql("fills markets", f",{_BY_CATEGORY} SELECT wallet, category, n, round(n / sum(n) OVER (PARTITION BY wallet), 6) AS trade_share, round(usd / sum(usd) OVER (PARTITION BY wallet), 6) AS volume_share FROM (SELECT wallet, category, count(*) AS n, sum(usd) AS usd FROM c GROUP BY ALL)"),
    "agg_concentration": t.sql("fills markets", f""",{_BY_CATEGORY} SELECT wallet, round(hhi, 5) AS hhi, round(CASE WHEN k = 1 THEN 1 ELSE (hhi - 1 / k) / (1 - 1 / k) END, 5) AS hhi_normalised, round(p, 5) AS primary_share,
        round(least(greatest(40 * least(greatest((hhi - 1 / 14) / (1 - 1 / 14), 0), 1) + 60 * p, 0), 100), 3) AS score
        FROM (SELECT wallet, sum(share * share) AS hhi, max(share) AS p, count(*) AS k FROM (SELECT wallet, usd / sum(usd) OVER (PARTITION BY wallet) AS share FROM (SELECT wallet, category, sum(usd) AS usd FROM c GROUP BY ALL)) GROUP BY wallet)"""),
    "agg_gini": t.sql("fills", "SELECT market, round(coalesce(sum((2 * i - n - 1) * usd) / nullif(max(n) * sum(usd), 0), 0), 5) AS gini FROM (SELECT market, usd, row_number() OVER (PARTITION BY market ORDER BY usd) AS i, count(*) OVER (PARTITION BY market) AS n FROM fills) GROUP BY market"),
    "agg_window_distribution": t.sql("trades", f",{_HOURLY} SELECT market, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(min(v), 4) AS least, round(max(v), 4) AS most, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS p75, round(quantile_cont(v, 0.95), 4) AS p95, round(stddev_pop(v) / avg(v), 4) AS variation FROM v GROUP BY market"),
    "agg_trade_size_stats": t.sql("trades", """SELECT market, n, round(m, 3) AS mean, round(s, 3) AS std, round(CASE WHEN n >= 3 AND s > 0 THEN n * z / ((n - 1) * (n - 2)) ELSE 0 END, 3) AS skewness, round(s / m, 3) AS variation, round(p[1], 3) AS p10, round(p[2], 3) AS p50, round(p[3], 3) AS p90, round(p[4], 3) AS p99, round(p[5], 3) AS p999
        FROM (SELECT market, any_value(n) AS n, any_value(m) AS m, any_value(s) AS s, sum(((usd - m) / nullif(s, 0)) ^ 3) AS z, quantile_cont(usd, [0.1, 0.5, 0.9, 0.99, 0.999]) AS p FROM (SELECT market, usd, count(*) OVER w AS n, avg(usd) OVER w AS m, stddev_pop(usd) OVER w AS s
        FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY ts_ms DESC, trade_id DESC) AS i FROM trades) WHERE i <= 10000 WINDOW w AS (PARTITION BY market)) GROUP BY market)"""),
    "agg_position_sizing": t.sql("fills", "SELECT wallet, n, round(m, 2) AS mean, round(s, 2) AS std, round(med, 2) AS median, round(CASE WHEN s > 0 THEN m3 / s ^ 3 ELSE 0 END, 4) AS skewness FROM (SELECT wallet, count(*) AS n, any_value(m) AS m, stddev_samp(usd) AS s, median(usd) AS med, avg((usd - m) ^ 3) AS m3 FROM (SELECT wallet, usd, avg(usd) OVER (PARTITION BY wallet) AS m FROM fills) GROUP BY wallet HAVING count(*) >= 3)"),
    "agg_hour_histogram": t.sql("trades", "SELECT hour, count(trade_id) AS n, round(coalesce(sum(usd), 0), 4) AS usd FROM (SELECT unnest(range(24)) AS hour) LEFT JOIN trades ON ts_ms // 3600000 % 24 = hour GROUP BY hour"),
    "agg_day_histogram": t.sql("trades", "SELECT day, count(trade_id) AS n FROM (SELECT unnest(range(7)) AS day) LEFT JOIN trades ON (ts_ms // 86400000 + 4) % 7 = day GROUP BY day"),
    "agg_hour_baseline": t.sql("trades", f",{_HOURLY} SELECT market, hour, n, round(mean, 4) AS mean, round(std, 4) AS std, round(sum(total) OVER w / sum(n) OVER w / mean, 4) AS factor, CASE WHEN hour BETWEEN 14 AND 20 THEN 'peak' WHEN hour >= 22 OR hour < 6 THEN 'off' ELSE 'standard' END AS period FROM (SELECT market, b // 3600000 % 24 AS hour, avg(v) AS mean, stddev_pop(v) AS std, count(*) AS n, sum(v) AS total FROM v GROUP BY ALL) WINDOW w AS (PARTITION BY market)"),
    "agg_win_windows": t.sql("fills", "SELECT wallet, \"window\", count(*) FILTER (win) AS wins, count(*) FILTER (NOT win) AS losses, round(sum(pnl) FILTER (pnl > 0) / nullif(sum(-pnl) FILTER (pnl < 0), 0), 4) AS profit_factor, round(avg(pnl), 2) AS mean FROM fills, (SELECT max(ts_ms) AS now FROM fills), (VALUES ('30d', 30), ('365d', 365), ('all', 100000)) x(\"window\", days) WHERE ts_ms >= now - days::BIGINT * 86400000 GROUP BY wallet, \"window\""),
    "agg_category_win_rates": t.sql("fills markets", f",{_BY_CATEGORY} SELECT category, count(*) AS n, count(*) FILTER (win) AS wins, round(count(*) FILTER (win) * 100.0 / count(*), 4)::DOUBLE AS win_rate, round(sum(pnl), 2) AS pnl FROM c GROUP BY category"),
    "agg_weighted_accuracy": t.sql("fills", """SELECT wallet, n, round(a, 4) AS accuracy, round(w, 4) AS weighted, CASE WHEN round(a, 6) >= 90 THEN 'exceptional' WHEN round(a, 6) >= 80 THEN 'excellent' WHEN round(a, 6) >= 70 THEN 'very_good' WHEN round(a, 6) >= 60 THEN 'good' WHEN round(a, 6) >= 55 THEN 'above_average' WHEN round(a, 6) >= 50 THEN 'average' WHEN round(a, 6) >= 40 THEN 'below_average' ELSE 'poor' END AS tier
        FROM (SELECT wallet, count(*) AS n, count(*) FILTER (win)::DOUBLE * 100 / count(*) AS a, coalesce(sum(w) FILTER (win), 0) / sum(w) * 100 AS w FROM (SELECT *, (CASE WHEN usd >= 80000 THEN 2.0 WHEN usd >= 50000 THEN 1.5 WHEN usd >= 20000 THEN 1.0 WHEN usd >= 5000 THEN 0.5 ELSE 0.2 END)::DOUBLE AS w FROM fills) GROUP BY wallet)"""),
}
