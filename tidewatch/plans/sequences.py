"""Queries over ordered trades."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import tables as t
from ..functions import stats
from ..operators import sequences as seq

r = stats.rounded
LARGE = 300.0
MINUTE = 60_000
_AT = ["ts_ms", "trade_id"]
_FILL = ["ts_ms", "order_id", "line", "market", "counterparty", "usd", "pnl"]


def seq_market_bursts(spark, sf):
    """Three or more large trades of a market no more than 30 minutes apart; small ones in between don't count."""
    large = t.trades(spark, sf).filter(F.col("usd") >= LARGE / 3)
    out = seq.sessions(large, ["market"], _AT, 30 * MINUTE, 3)
    rate = F.try_divide(F.col("n") * float(MINUTE), F.greatest(F.col("end") - F.col("start"), F.lit(1)))
    return out.select("market", "start", "end", "n", r("usd", 4).alias("usd"), stats.ladder(rate, [(5, "critical"), (2, "high"), (1, "medium"), (0.5, "low")], "none").alias("intensity"))


def seq_wallet_bursts(spark, sf):
    out = seq.sessions(t.trades(spark, sf), ["wallet"], _AT, 60 * MINUTE, 2)
    return out.withColumn("usd", r("usd", 4))


def seq_streaks(spark, sf):
    return seq.streaks(t.fills(spark, sf).filter("pnl != 0"), "wallet", _FILL, "win")


def seq_reactivation(spark, sf):
    return seq.largest_gap(t.fills(spark, sf).select("wallet", "ts_ms").distinct(), "wallet", ["ts_ms"], 30 * t.DAY)


def seq_activity_timeline(spark, sf):
    """Trades a day of each wallet, flagged if it comes 30 days or more after the day before."""
    days = t.fills(spark, sf).groupBy("wallet", stats.bucket_ms(F.col("ts_ms"), t.DAY).alias("day")).agg(F.count("*").alias("n"))
    before = F.lag("day").over(Window.partitionBy("wallet").orderBy("day"))
    return days.withColumn("reactivated", F.coalesce(F.col("day") - before >= 30 * t.DAY, F.lit(False)))


def _intervals(spark, sf):
    w = Window.partitionBy("wallet").orderBy(*_AT)
    return t.trades(spark, sf).select("wallet", "ts_ms", "trade_id", (F.col("ts_ms") - F.lag("ts_ms").over(w)).alias("gap")).filter("gap is not null")


def seq_interval_stats(spark, sf):
    out = _intervals(spark, sf).groupBy("wallet").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.median("gap").alias("median"), F.stddev_pop("gap").alias("std"), F.count_if(F.col("gap") < MINUTE).alias("under_minute"), F.count_if(F.col("gap") < 5 * MINUTE).alias("under_five"))
    return out.select("wallet", "n", r("mean", 1).alias("mean"), r("median", 1).alias("median"), r("std", 1).alias("std"), r(F.when(F.col("n") < 2, 1.0).otherwise(F.try_divide("std", "mean")), 6).alias("variation"), "under_minute", "under_five")


def seq_regularity(spark, sf):
    """Share of a wallet's intervals that are alike within a day; groups are made greedily in order."""
    arrays = _intervals(spark, sf).groupBy("wallet").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "trade_id", "gap"))).alias("x")).select("wallet", F.transform("x", lambda v: v["gap"].cast("double")).alias("gaps"))
    return seq.regularity(arrays, "wallet", "gaps", t.DAY)


def seq_martingale(spark, sf):
    """How often a wallet's next position is about twice as large after a loss."""
    w = Window.partitionBy("wallet").orderBy(*_FILL)
    steps = t.fills(spark, sf).select("wallet", F.try_divide("usd", F.lag("usd").over(w)).alias("ratio"), F.lag("win").over(w).alias("won")).filter("won = false")
    return steps.groupBy("wallet").agg(F.count("*").alias("losses"), r(F.avg(F.col("ratio").between(1.8, 2.2).cast("double")), 6).alias("share"))


def seq_pyramiding(spark, sf):
    """Wallets and markets with two or more positions on one side, each larger than the one before."""
    w = Window.partitionBy("wallet", "market").orderBy(*_FILL)
    steps = t.fills(spark, sf).select("wallet", "market", "side", "usd", F.lag("usd").over(w).alias("b"))
    out = steps.groupBy("wallet", "market").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("usd") > F.col("b"), F.lit(True))).alias("rising"), F.countDistinct("side").alias("sides"))
    return out.filter("n >= 2 and rising and sides = 1").select("wallet", "market", "n")


#: Trailing windows of volumes.
WINDOWS = {"1m": MINUTE, "5m": 5 * MINUTE, "15m": 15 * MINUTE, "1h": t.HOUR, "4h": 4 * t.HOUR, "24h": t.DAY}


def seq_rolling_volume(spark, sf):
    """Six trailing windows of each market at each trade: count, sum, mean and velocity, the change a minute from first to last."""
    out = seq.rolling(t.trades(spark, sf).select("trade_id", "market", "ts_ms", "usd"), ["market"], "trade_id", "usd", WINDOWS)
    columns = []
    for name in WINDOWS:
        n, total, minutes = F.col(f"n_{name}"), F.col(f"sum_{name}"), (F.col("ts_ms") - F.col(f"first_ms_{name}")) / MINUTE
        velocity = F.when(minutes > 0, (F.col("last") - F.col(f"first_{name}")) / minutes).otherwise(0.0)
        columns += [n, r(total, 3).alias(f"sum_{name}"), r(total / n, 3).alias(f"mean_{name}"), (r(velocity, 3) + 0.0).alias(f"velocity_{name}")]
    return out.select("trade_id", "market", *columns)


def seq_breaches(spark, sf):
    """Hours whose volume lies two deviations or more from the market's day before, by severity."""
    hourly = t.trades(spark, sf).groupBy("market", stats.bucket_ms(F.col("ts_ms"), t.HOUR).alias("ts_ms")).agg(F.sum("usd").alias("v"))
    w = Window.partitionBy("market").orderBy("ts_ms").rangeBetween(-t.DAY, -1)
    z = stats.population_z(F.col("v"), F.col("m"), F.col("s"))
    rows = hourly.withColumns({"m": F.avg("v").over(w), "s": F.stddev_pop("v").over(w), "n": F.count("*").over(w)}).filter("n >= 5").withColumn("z", r(z, 5))
    return rows.filter("abs(z) >= 2").select("market", "ts_ms", r("v", 3).alias("volume"), "z", stats.ladder(F.abs("z"), [(4, "critical"), (3, "high"), (2.5, "medium")], "low").alias("severity"))


def seq_sliding_windows(spark, sf):
    """Windows of an hour every ten minutes from each market's first trade: three wallets or more make a cluster."""
    out = seq.anchored_totals(t.trades(spark, sf), ["market"], t.HOUR, 10 * MINUTE)
    return out.filter("n >= 4 and wallets >= 3").withColumn("usd", r("usd", 4))


def seq_drawdown(spark, sf):
    out = seq.drawdown(t.fills(spark, sf), "wallet", _FILL, "pnl")
    return out.select("wallet", r("total", 2).alias("total"), r("drawdown", 2).alias("drawdown"))


def seq_cumulative_pnl(spark, sf):
    """Daily and running profit of each wallet."""
    d = t.fills(spark, sf).groupBy("wallet", stats.bucket_ms(F.col("ts_ms"), t.DAY).alias("day")).agg(F.sum("pnl").alias("pnl"))
    w = Window.partitionBy("wallet").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("wallet", "day", r("pnl", 2).alias("pnl"), r(F.sum("pnl").over(w), 2).alias("running"))


def seq_trend_split(spark, sf):
    """Win rate of the first 70 % of a wallet's positions against the rest."""
    w = Window.partitionBy("wallet")
    rows = t.fills(spark, sf).select("wallet", "win", F.row_number().over(w.orderBy(*_FILL)).alias("i"), F.count("*").over(w).alias("n")).filter("n >= 10")
    early = F.col("i") * 10 <= F.col("n") * 7
    a = rows.groupBy("wallet").agg(F.avg(F.when(early, F.col("win").cast("double"))).alias("a"), F.avg(F.when(~early, F.col("win").cast("double"))).alias("b"))
    change = r((F.col("b") - F.col("a")) * 100, 5)
    return a.select("wallet", r("a", 6).alias("early"), r("b", 6).alias("late"), F.when(change > 5, "improving").when(change < -5, "declining").otherwise("stable").alias("trend"))


def seq_ranks(spark, sf):
    """Leaderboard by win rate: rank, and the share of wallets below."""
    a = t.fills(spark, sf).groupBy("wallet").agg(F.count("*").alias("n"), r(F.avg(F.col("win").cast("double")), 6).alias("rate")).filter("n >= 5")
    total = a.agg(F.count("*").alias("all"))
    ranked = seq.ranked(a, -F.floor(F.col("rate") * 1000), [F.desc("rate"), F.desc("n"), "wallet"]).crossJoin(F.broadcast(total))  # one row
    return ranked.select("wallet", "rate", "rank", r(F.coalesce(F.try_divide((F.col("all") - F.col("rank")) * 100.0, F.col("all") - 1), F.lit(100.0)), 5).alias("percentile"))


def seq_volume_trend(spark, sf):
    """Slope of the last five days of each market's volume over their mean: rising, falling or stable."""
    d = t.trades(spark, sf).groupBy("market", F.floor(F.col("ts_ms") / t.DAY).alias("day")).agg(F.sum("usd").alias("v"))
    last = d.withColumn("i", F.row_number().over(Window.partitionBy("market").orderBy(F.desc("day")))).filter("i <= 5")
    a = last.groupBy("market").agg(F.count("*").alias("n"), F.sum("day").alias("sx"), F.sum("v").alias("sy"), F.sum(F.col("day") * F.col("v")).alias("sxy"), F.sum(F.col("day") * F.col("day")).alias("sxx"))
    slope = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    rel = r(F.coalesce(F.try_divide(slope * F.col("n"), "sy"), F.lit(0.0)), 6)
    return a.select("market", rel.alias("slope"), F.when(rel > 0.1, "increasing").when(rel < -0.1, "decreasing").otherwise("stable").alias("trend"))


def seq_average_cost(spark, sf):
    out = seq.average_cost(t.fills(spark, sf), ["wallet", "market"], _FILL[:3] + ["counterparty", "usd", "pnl"])
    return out.select("wallet", "market", r("size", 4).alias("size"), r("cost", 2).alias("cost"), r("realised", 2).alias("realised"))


def seq_down_sampled(spark, sf):
    """Each market's prices by largest triangles to 100 points; greedy, so checked by its own test."""
    return seq.lttb(t.trades(spark, sf).select("market", "ts_ms", F.col("usd").alias("price")), "market", "ts_ms", "price", 100)


def seq_first_trades(spark, sf):
    """Each wallet's first trade against all first trades: multiple of the mean, z-score, outlier."""
    first = t.trades(spark, sf).groupBy("wallet").agg(F.min_by(F.struct("trade_id", "ts_ms", "usd"), F.struct(*_AT)).alias("x")).select("wallet", "x.*")
    a = first.agg(F.avg("usd").alias("m"), F.stddev_pop("usd").alias("s"))
    j = first.crossJoin(F.broadcast(a))  # one row
    return j.select("wallet", "trade_id", "usd", r(F.try_divide("usd", "m"), 5).alias("multiple"), r(stats.population_z(F.col("usd"), F.col("m"), F.col("s")), 5).alias("z")).withColumn("outlier", F.col("z") >= 2)


def seq_quota(spark, sf):
    """Alerts that a cap of three a wallet and day would let through, in order."""
    w = Window.partitionBy("wallet", F.floor(F.col("ts_ms") / t.DAY)).orderBy(*_AT)
    return t.trades(spark, sf).filter("usd >= 50").select("trade_id", "wallet", F.row_number().over(w).alias("nth")).filter("nth <= 3")


def seq_deduplicated(spark, sf):
    """Trades of a wallet in a market that come more than an hour after the last one let through."""
    return seq.admitted(t.trades(spark, sf), ["wallet", "market"], ["ts_ms", "trade_id"], t.HOUR)


QUERIES = {f.__name__: f for f in (
    seq_market_bursts, seq_wallet_bursts, seq_streaks, seq_reactivation, seq_activity_timeline, seq_interval_stats, seq_regularity, seq_martingale, seq_pyramiding, seq_rolling_volume, seq_breaches, seq_sliding_windows,
    seq_drawdown, seq_cumulative_pnl, seq_trend_split, seq_ranks, seq_volume_trend, seq_average_cost, seq_down_sampled, seq_first_trades, seq_quota, seq_deduplicated,
)}

_O = "ts_ms, order_id, line, market, counterparty, usd, pnl"


def _runs(key: str, source: str, gap: int, least: int, more: str) -> str:
    return f"""SELECT {key}, min(ts_ms) AS start, max(ts_ms) AS "end", count(*) AS n, round(sum(usd), 4) AS usd{more} FROM (SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY ts_ms, trade_id) AS run FROM
        (SELECT *, coalesce((ts_ms - lag(ts_ms) OVER (PARTITION BY {key} ORDER BY ts_ms, trade_id) > {gap})::INT, 1) AS new FROM {source})) GROUP BY {key}, run HAVING count(*) >= {least}"""


ORACLE_SQL = {
    "seq_market_bursts": t.sql("trades", _runs("market", f"(SELECT * FROM trades WHERE usd >= {LARGE / 3})", 30 * MINUTE, 3, ", CASE WHEN count(*) * 60000.0 / greatest(max(ts_ms) - min(ts_ms), 1) >= 5 THEN 'critical' WHEN count(*) * 60000.0 / greatest(max(ts_ms) - min(ts_ms), 1) >= 2 THEN 'high' WHEN count(*) * 60000.0 / greatest(max(ts_ms) - min(ts_ms), 1) >= 1 THEN 'medium' WHEN count(*) * 60000.0 / greatest(max(ts_ms) - min(ts_ms), 1) >= 0.5 THEN 'low' ELSE 'none' END AS intensity")),
    "seq_wallet_bursts": t.sql("trades", _runs("wallet", "trades", 60 * MINUTE, 2, "")),
    "seq_streaks": t.sql("fills", f"""SELECT wallet, coalesce(max(n) FILTER (win), 0) AS longest_true, coalesce(max(n) FILTER (NOT win), 0) AS longest_false, arg_max(CASE WHEN win THEN n ELSE -n END, run) AS current FROM (SELECT wallet, run, win, count(*) AS n FROM
        (SELECT *, sum(c) OVER (PARTITION BY wallet ORDER BY {_O} ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, coalesce((win != lag(win) OVER (PARTITION BY wallet ORDER BY {_O}))::INT, 1) AS c FROM fills WHERE pnl != 0)) GROUP BY ALL) GROUP BY wallet"""),
    "seq_reactivation": t.sql("fills", "SELECT wallet, before, after, gap FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY gap DESC, after) AS i FROM (SELECT wallet, lag(ts_ms) OVER w AS before, ts_ms AS after, ts_ms - lag(ts_ms) OVER w AS gap FROM (SELECT DISTINCT wallet, ts_ms FROM fills) WINDOW w AS (PARTITION BY wallet ORDER BY ts_ms)) WHERE gap > 2592000000) WHERE i = 1"),
    "seq_activity_timeline": t.sql("fills", "SELECT wallet, day, n, coalesce(day - lag(day) OVER (PARTITION BY wallet ORDER BY day) >= 2592000000, false) AS reactivated FROM (SELECT wallet, ts_ms // 86400000 * 86400000 AS day, count(*) AS n FROM fills GROUP BY ALL)"),
    "seq_interval_stats": t.sql("trades", "SELECT wallet, count(*) AS n, round(avg(gap), 1) AS mean, round(median(gap), 1) AS median, round(stddev_pop(gap), 1) AS std, round(CASE WHEN count(*) < 2 THEN 1 ELSE stddev_pop(gap) / avg(gap) END, 6) AS variation, count(*) FILTER (gap < 60000) AS under_minute, count(*) FILTER (gap < 300000) AS under_five FROM (SELECT wallet, ts_ms - lag(ts_ms) OVER (PARTITION BY wallet ORDER BY ts_ms, trade_id) AS gap FROM trades) WHERE gap IS NOT NULL GROUP BY wallet"),
    "seq_martingale": t.sql("fills", f"SELECT wallet, count(*) AS losses, round(avg((ratio BETWEEN 1.8 AND 2.2)::INT), 6) AS share FROM (SELECT wallet, usd / lag(usd) OVER w AS ratio, lag(win) OVER w AS won FROM fills WINDOW w AS (PARTITION BY wallet ORDER BY {_O})) WHERE NOT won GROUP BY wallet"),
    "seq_pyramiding": t.sql("fills", f"SELECT wallet, market, count(*) AS n FROM (SELECT *, coalesce(usd > lag(usd) OVER (PARTITION BY wallet, market ORDER BY {_O}), true) AS up FROM fills) GROUP BY wallet, market HAVING count(*) >= 2 AND bool_and(up) AND count(DISTINCT side) = 1"),
    "seq_rolling_volume": t.sql(
        "trades",
        "SELECT trade_id, market, "
        + ", ".join(
            f"count(*) OVER w{n} AS n_{n}, round(sum(usd) OVER w{n}, 3) AS sum_{n}, round(avg(usd) OVER w{n}, 3) AS mean_{n}, round(CASE WHEN ts_ms > min(ts_ms) OVER w{n} THEN (arg_max(usd, (ts_ms, trade_id)) OVER w{n} - arg_min(usd, (ts_ms, trade_id)) OVER w{n}) / ((ts_ms - min(ts_ms) OVER w{n}) / 60000) ELSE 0 END, 3) + 0 AS velocity_{n}"
            for n in WINDOWS
        )
        + " FROM trades WINDOW "
        + ", ".join(f"w{n} AS (PARTITION BY market ORDER BY ts_ms RANGE BETWEEN {width} PRECEDING AND CURRENT ROW)" for n, width in WINDOWS.items()),
    ),
    "seq_breaches": t.sql("trades", """SELECT market, ts_ms, round(v, 3) AS volume, z, CASE WHEN abs(z) >= 4 THEN 'critical' WHEN abs(z) >= 3 THEN 'high' WHEN abs(z) >= 2.5 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT *, round(CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END, 5) AS z FROM (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s, count(*) OVER w AS n
        FROM (SELECT market, ts_ms // 3600000 * 3600000 AS ts_ms, sum(usd) AS v FROM trades GROUP BY ALL) WINDOW w AS (PARTITION BY market ORDER BY ts_ms RANGE BETWEEN 86400000 PRECEDING AND 1 PRECEDING)) WHERE n >= 5) WHERE abs(z) >= 2"""),
    "seq_sliding_windows": t.sql("trades", "SELECT market, s AS window_start, count(*) AS n, count(DISTINCT wallet) AS wallets, round(sum(usd), 4) AS usd, count(*) FILTER (side = 'BUY') AS buys FROM (SELECT x.*, unnest(range(greatest(0, ceil((ts_ms - f - 3600000) / 600000)::BIGINT), (ts_ms - f) // 600000 + 1)) * 600000 + f AS s FROM trades x JOIN (SELECT market, min(ts_ms) AS f FROM trades GROUP BY market) USING (market)) GROUP BY market, s HAVING count(*) >= 4 AND count(DISTINCT wallet) >= 3"),
    "seq_drawdown": t.sql("fills", f"SELECT wallet, round(arg_max(c, ({_O})), 2) AS total, round(max(p - c), 2) AS drawdown FROM (SELECT *, greatest(max(c) OVER (PARTITION BY wallet ORDER BY {_O} ROWS UNBOUNDED PRECEDING), 0) AS p FROM (SELECT *, sum(pnl) OVER (PARTITION BY wallet ORDER BY {_O} ROWS UNBOUNDED PRECEDING) AS c FROM fills)) GROUP BY wallet"),
    "seq_cumulative_pnl": t.sql("fills", "SELECT wallet, day, round(pnl, 2) AS pnl, round(sum(pnl) OVER (PARTITION BY wallet ORDER BY day), 2) AS running FROM (SELECT wallet, ts_ms // 86400000 * 86400000 AS day, sum(pnl) AS pnl FROM fills GROUP BY ALL)"),
    "seq_trend_split": t.sql("fills", f"SELECT wallet, round(a, 6) AS early, round(b, 6) AS late, CASE WHEN round((b - a) * 100, 5) > 5 THEN 'improving' WHEN round((b - a) * 100, 5) < -5 THEN 'declining' ELSE 'stable' END AS trend FROM (SELECT wallet, avg(win::INT) FILTER (i * 10 <= n * 7) AS a, avg(win::INT) FILTER (i * 10 > n * 7) AS b FROM (SELECT wallet, win, row_number() OVER (PARTITION BY wallet ORDER BY {_O}) AS i, count(*) OVER (PARTITION BY wallet) AS n FROM fills) WHERE n >= 10 GROUP BY wallet)"),
    "seq_ranks": t.sql("fills", "SELECT wallet, rate, rank, round(coalesce((total - rank) * 100.0 / nullif(total - 1, 0), 100)::DOUBLE, 5) AS percentile FROM (SELECT *, row_number() OVER (ORDER BY rate DESC, n DESC, wallet) AS rank, count(*) OVER () AS total FROM (SELECT wallet, count(*) AS n, round(avg(win::INT), 6) AS rate FROM fills GROUP BY wallet HAVING count(*) >= 5))"),
    "seq_volume_trend": t.sql("trades", "SELECT market, s AS slope, CASE WHEN s > 0.1 THEN 'increasing' WHEN s < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM (SELECT market, round(coalesce(regr_slope(v, day) / nullif(avg(v), 0), 0), 6) AS s FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY day DESC) AS i FROM (SELECT market, ts_ms // 86400000 AS day, sum(usd) AS v FROM trades GROUP BY ALL)) WHERE i <= 5 GROUP BY market)"),
    "seq_first_trades": t.sql("trades", "SELECT wallet, trade_id, usd, round(usd / m, 5) AS multiple, round(CASE WHEN s > 0 THEN (usd - m) / s ELSE 0 END, 5) AS z, round(CASE WHEN s > 0 THEN (usd - m) / s ELSE 0 END, 5) >= 2 AS outlier FROM (SELECT *, avg(usd) OVER () AS m, stddev_pop(usd) OVER () AS s FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY ts_ms, trade_id) AS i FROM trades) WHERE i = 1)"),
    "seq_quota": t.sql("trades", "SELECT trade_id, wallet, nth FROM (SELECT *, row_number() OVER (PARTITION BY wallet, ts_ms // 86400000 ORDER BY ts_ms, trade_id) AS nth FROM trades WHERE usd >= 50) WHERE nth <= 3"),
    "seq_regularity": "WITH RECURSIVE "
    + t.SQL["trades"]
    + f""", h AS (SELECT wallet, ts_ms, trade_id, ts_ms - lag(ts_ms) OVER (PARTITION BY wallet ORDER BY ts_ms, trade_id) AS gap FROM trades),
        g AS (SELECT wallet, gap, row_number() OVER (PARTITION BY wallet ORDER BY ts_ms, trade_id) AS i, count(*) OVER (PARTITION BY wallet) AS n FROM h WHERE gap IS NOT NULL),
        f AS (SELECT DISTINCT wallet, 0::BIGINT AS i, []::BIGINT[] AS heads, []::BIGINT[] AS counts FROM g
            UNION ALL SELECT wallet, j, CASE WHEN p > 0 THEN heads ELSE list_append(heads, gap) END, CASE WHEN p > 0 THEN list_concat(list_concat(counts[1:p - 1], [counts[p] + 1]), counts[p + 1:]) ELSE list_append(counts, 1) END
            FROM (SELECT f.wallet, g.i AS j, heads, counts, gap, coalesce(list_position(list_transform(heads, lambda h: abs(h - gap) <= {t.DAY}), true), 0) AS p FROM f JOIN g ON g.wallet = f.wallet AND g.i = f.i + 1))
        SELECT f.wallet, list_max(counts) / n AS regularity FROM f JOIN g ON g.wallet = f.wallet AND g.i = f.i AND g.i = g.n""",
    "seq_deduplicated": "WITH RECURSIVE "
    + t.SQL["trades"]
    + """, o AS (SELECT wallet, market, ts_ms, trade_id, row_number() OVER (PARTITION BY wallet, market ORDER BY ts_ms, trade_id) AS i FROM trades),
        f AS (SELECT *, ts_ms AS last, true AS goes_on FROM o WHERE i = 1
            UNION ALL SELECT o.*, CASE WHEN o.ts_ms - f.last > 3600000 THEN o.ts_ms ELSE f.last END, o.ts_ms - f.last > 3600000 FROM f JOIN o ON o.wallet = f.wallet AND o.market = f.market AND o.i = f.i + 1)
        SELECT wallet, market, ts_ms, trade_id FROM f WHERE goes_on""",
}
ORACLE_SQL["seq_average_cost"] = """WITH RECURSIVE """ + t.SQL["fills"] + """,
    o AS (SELECT *, row_number() OVER (PARTITION BY wallet, market ORDER BY ts_ms, order_id, line, counterparty, usd, pnl) AS i FROM fills),
    z AS (SELECT wallet, market, i, CASE WHEN side = 'BUY' THEN size ELSE -size END AS size, CASE WHEN side = 'BUY' THEN size * price ELSE 0.0 END AS cost, CASE WHEN side = 'BUY' THEN 0.0 ELSE size * price END AS realised FROM o WHERE i = 1
        UNION ALL SELECT o.wallet, o.market, o.i, CASE WHEN side = 'BUY' THEN z.size + o.size ELSE z.size - o.size END,
        CASE WHEN side = 'BUY' THEN z.cost + o.size * price ELSE z.cost - o.size * coalesce(z.cost / nullif(z.size, 0), 0) END,
        CASE WHEN side = 'BUY' THEN z.realised ELSE z.realised + o.size * (price - coalesce(z.cost / nullif(z.size, 0), 0)) END
        FROM z JOIN o ON o.wallet = z.wallet AND o.market = z.market AND o.i = z.i + 1)
    SELECT wallet, market, round(1e-7 + arg_max(size, i), 4) AS size, round(1e-7 + arg_max(cost, i), 2) AS cost, round(1e-7 + arg_max(realised, i), 2) AS realised FROM z GROUP BY wallet, market"""
