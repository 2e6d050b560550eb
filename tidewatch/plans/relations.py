"""Queries that join trades with what is known about markets and wallets, and wallets with each other."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import tables as t
from ..functions import stats
from ..operators import graph, nearby, sequences

r = stats.rounded
#: How close in time trades of two wallets are coordinated; sizes of a sybil cluster; a fill that makes a wallet suspect.
NEAR_MS, CLUSTER, SUSPECT_USD = 60_000, (2, 100), 104_000


def join_dimensions(spark, sf):
    """Fills with the market's title and the wallet's nation, aggregated."""
    f = t.fills(spark, sf).groupBy("market", "wallet").agg(F.sum("usd").alias("usd"), F.count("*").alias("n"))
    j = f.join(t.markets(spark, sf), "market", "left").join(t.wallets(spark, sf), "wallet", "left")
    return j.groupBy("category", "region").agg(F.sum("n").alias("n"), r(F.sum("usd"), 2).alias("usd"))


def join_hot_markets(spark, sf):
    """The 20 markets with most alerts (fills of 80,000 and more), their alert that came first and their title."""
    a = t.fills(spark, sf).filter("usd >= 80000")
    w = Window.partitionBy("market").orderBy("ts_ms", "order_id", "line", "usd", "wallet", "counterparty")
    first = a.withColumn("i", F.row_number().over(w)).groupBy("market").agg(F.count("*").alias("alerts"), F.max(F.when(F.col("i") == 1, F.col("wallet"))).alias("first_wallet"))
    return first.join(t.markets(spark, sf).select("market", "title", "category"), "market").orderBy(F.desc("alerts"), "market").limit(20)


def join_daily_profit(spark, sf):
    """Profit by day and its running sum: what sold a loser earns its value, what sold a winner pays it."""
    f = t.fills(spark, sf).join(t.markets(spark, sf).filter("category = 'PROMO'").select("market"), "market", "left_semi")
    gain = F.when(F.col("side") == "BUY", F.when(F.col("win"), F.col("usd") * 0.1).otherwise(-F.col("usd"))).otherwise(F.when(F.col("win"), -F.col("usd") * 0.1).otherwise(F.col("usd")))
    d = f.groupBy(stats.bucket_ms(F.col("ts_ms"), t.DAY).alias("day")).agg(F.sum(gain).alias("gain"))
    # one row a day
    return d.select("day", r("gain", 2).alias("gain"), r(F.sum("gain").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))


def join_active_wallets(spark, sf):
    """Wallets with a fill in the last year of the data: a semi-join."""
    f = t.fills(spark, sf)
    recent = f.crossJoin(F.broadcast(f.agg(F.max("ts_ms").alias("now")))).filter(F.col("ts_ms") > F.col("now") - 365 * t.DAY)  # one row
    return t.wallets(spark, sf).join(recent, "wallet", "left_semi").select("wallet", "label", "kind")


def join_new_wallets(spark, sf):
    """Wallets of the dimension that never traded: an anti-join."""
    return t.wallets(spark, sf).join(t.fills(spark, sf), "wallet", "left_anti").select("wallet", "label")


def join_between_wallets(spark, sf):
    """Fills between pairs of a wallet and a counterparty in either order."""
    f = t.fills(spark, sf)
    out = f.groupBy(F.least("wallet", "counterparty").alias("a"), F.greatest("wallet", "counterparty").alias("b")).agg(F.count("*").alias("n"), F.sum("usd").alias("usd"))
    return out.filter("n >= 3").withColumn("usd", r("usd", 2))


def join_as_of_volume(spark, sf):
    """Each trade of 'purchase' with the last 'view' of the same wallet at or before it: an as-of join by one sort."""
    e = t.trades(spark, sf)
    left = e.filter("market = 'purchase'").select("wallet", "ts_ms", "trade_id", "usd")
    right = e.filter("market = 'view'").select("wallet", "ts_ms", F.col("usd").alias("view_usd"), F.col("trade_id").alias("view_id"))
    out = sequences.as_of(left, right, ["wallet"], ["view_usd", "view_id"], "view_id")
    ratio = F.try_divide("usd", F.greatest("view_usd", F.lit(1.0)))
    return out.select("trade_id", "wallet", "view_id", r(ratio, 5).alias("ratio"), stats.ladder(ratio, [(5, "extreme"), (2, "high"), (1, "elevated")], "normal").alias("level"))


def join_pre_event_volume(spark, sf):
    """Volume of each market in windows before its errors, 1 to 24 hours: an interval join by hour buckets."""
    e = t.trades(spark, sf)
    events = e.filter("market = 'error' and usd >= 50").select(F.col("trade_id").alias("event_id"), F.col("ts_ms").alias("at"), "wallet")
    spread = events.withColumn("hour", F.explode(F.sequence(F.floor((F.col("at") - t.DAY) / t.HOUR), F.floor(F.col("at") / t.HOUR))))
    other = e.filter("market != 'error'").select("wallet", "ts_ms", "usd", F.floor(F.col("ts_ms") / t.HOUR).alias("hour"))
    j = spread.join(other, ["wallet", "hour"]).filter((F.col("ts_ms") < F.col("at")) & (F.col("ts_ms") >= F.col("at") - t.DAY))
    early = F.col("ts_ms") < F.col("at") - t.HOUR
    return j.groupBy("event_id").agg(F.count("*").alias("n"), r(F.sum(F.when(early, F.col("usd")).otherwise(0.0)), 4).alias("day_before"), r(F.sum(F.when(~early, F.col("usd")).otherwise(0.0)), 4).alias("hour_before"))


def pair_timing(spark, sf):
    """Share of a wallet's trades with one of the other within a minute in the same market, over the smaller count."""
    near = nearby.near_pairs(t.trades(spark, sf).select("wallet", "market", "ts_ms"), NEAR_MS)
    return near.select("a", "b", "hits", r(F.least(F.try_divide("hits", "n"), F.lit(1.0)), 6).alias("timing"))


def pair_direction(spark, sf):
    """Of two wallets' pairs of trades on one day in one market, the share on the same side, from counts of each side."""
    d = t.fills(spark, sf).groupBy("market", F.floor(F.col("ts_ms") / t.DAY).alias("day"), "wallet").agg(F.count_if(F.col("side") == "BUY").alias("buys"), F.count_if(F.col("side") != "BUY").alias("sells"))
    a, b = (d.select("market", "day", F.col("wallet").alias(x), F.col("buys").alias(f"buys_{x}"), F.col("sells").alias(f"sells_{x}")) for x in "ab")
    same = F.col("buys_a") * F.col("buys_b") + F.col("sells_a") * F.col("sells_b")
    total = (F.col("buys_a") + F.col("sells_a")) * (F.col("buys_b") + F.col("sells_b"))
    out = a.join(b, ["market", "day"]).filter("a < b").groupBy("a", "b").agg(F.sum(total).alias("n"), F.sum(same).alias("same"))
    return out.select("a", "b", "n", r(F.try_divide("same", "n"), 6).alias("same_side"))


def _held(spark, sf):
    """(wallet, market) of all fills, once each."""
    graph.shared_checkpoints(spark)
    return t.fills(spark, sf).select("wallet", "market").distinct().checkpoint()


def pair_market_overlap(spark, sf):
    """Jaccard index of the markets of wallets that share three or more, by counts, not by sets."""
    wm = _held(spark, sf)
    size = wm.groupBy("wallet").agg(F.count("*").alias("n"))
    p = graph.shared_pairs(wm, "wallet", "market", 3)
    j = p.join(size.select(F.col("wallet").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("wallet").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", "shared", r(F.try_divide("shared", F.col("na") + F.col("nb") - F.col("shared")) * 100, 5).alias("jaccard"))


def pair_coordination(spark, sf):
    """Weighted similarity of wallets that share three markets or more: markets, sizes, win rates and buy shares."""
    f = t.fills(spark, sf)
    w = f.groupBy("wallet").agg(F.count("*").alias("n"), F.avg("usd").alias("size"), F.avg(F.col("win").cast("double")).alias("wins"), F.avg((F.col("side") == "BUY").cast("double")).alias("buys"), F.countDistinct("market").alias("markets"))
    p = graph.shared_pairs(_held(spark, sf), "wallet", "market", 3)
    side = lambda x: w.select(*[F.col(c).alias(x if c == "wallet" else f"{c}_{x}") for c in w.columns])
    j = p.join(side("a"), "a").join(side("b"), "b")
    overlap = F.try_divide("shared", F.col("markets_a") + F.col("markets_b") - F.col("shared"))
    sizes = F.try_divide(F.least("size_a", "size_b"), F.greatest("size_a", "size_b"))
    wins = F.greatest(1 - 2 * F.abs(F.col("wins_a") - F.col("wins_b")), F.lit(0.0))
    score = r(100 * (0.4 * overlap + 0.25 * sizes + 0.2 * wins + 0.15 * (1 - F.abs(F.col("buys_a") - F.col("buys_b")))), 4)
    return j.select("a", "b", "shared", score.alias("score")).withColumn("coordinated", F.col("score") >= 60)


def pair_star_groups(spark, sf):
    """Groups around a source wallet, not transitive: its partners by shared markets, two or more."""
    p = graph.shared_pairs(_held(spark, sf), "wallet", "market", 4)
    both = p.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    return both.groupBy("a").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("b")).alias("m")).filter("n >= 2").select(F.col("a").alias("wallet"), "n", F.array_join("m", ",").alias("members"))


def pair_cross_market(spark, sf):
    """Markets traded by the same wallets on one day: wallets, pairs and Pearson's r of the paired sizes (0 without spread)."""
    e = t.trades(spark, sf).groupBy("wallet", "market", F.floor(F.col("ts_ms") / t.DAY).alias("day")).agg(F.sum("usd").alias("usd"))
    a, b = e.select("wallet", "day", F.col("market").alias("a"), F.col("usd").alias("x")), e.select("wallet", "day", F.col("market").alias("b"), F.col("usd").alias("y"))
    return a.join(b, ["wallet", "day"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.countDistinct("wallet").alias("wallets"), r(stats.pearson("x", "y"), 5).alias("r")).filter("n >= 3 and wallets >= 2")


def _title_classes(spark, sf):
    """(market, words): the words of over three letters of a title, as a sorted set; titles with two of them or more."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("title"), "[^a-z0-9]+"), lambda w: F.length(w) > 3)))
    return t.markets(spark, sf).select("market", words.alias("words")).filter(F.size("words") > 1)


def pair_title_classes(spark, sf):
    """The class of each market: markets whose titles have the same words, named by the smallest of them."""
    m = _title_classes(spark, sf)
    c = m.groupBy("words").agg(F.min("market").alias("class"), F.count("*").alias("n"))
    return m.join(c, "words").select("market", "class", "n")


def pair_related_titles(spark, sf):
    """Classes of markets (see pair_title_classes) whose titles share two words or more; a class of several with itself.

    Each row stands for all pairs of a market of one class with one of the other: `pairs` of them.
    """
    c = _title_classes(spark, sf).groupBy("words").agg(F.min("market").alias("class"), F.count("*").alias("n"))
    p = graph.shared_pairs(c.select("class", F.explode("words").alias("word")), "class", "word", 2)
    own = c.filter("n > 1").select(F.col("class").alias("a"), F.col("class").alias("b"), F.size("words").cast("long").alias("shared"), F.expr("n * (n - 1) div 2").alias("pairs"))
    n = lambda x: c.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"))
    return p.join(n("a"), "a").join(n("b"), "b").select("a", "b", "shared", (F.col("n_a") * F.col("n_b")).alias("pairs")).union(own)


def graph_funding_reach(spark, sf):
    """Funding up to three steps back from suspect wallets: who sold to them in large fills, who sold to those, and so on.

    A counterparty's id is that of the wallet which it trades with elsewhere.
    """
    graph.shared_checkpoints(spark)
    large = t.fills(spark, sf).filter("usd >= 60000").groupBy(F.col("counterparty").alias("source"), F.col("wallet").alias("target")).agg(F.max(F.col("usd") >= SUSPECT_USD).alias("suspect")).checkpoint()
    starts = large.filter("suspect").select(F.col("target").alias("start"))
    return graph.reach(large.select("source", "target"), starts, 3)


def graph_funding_sources(spark, sf):
    """Sources that funded two wallets or more, with how many and how much."""
    f = t.fills(spark, sf).groupBy("counterparty", "wallet").agg(F.sum("usd").alias("usd"))
    return f.groupBy(F.col("counterparty").alias("source")).agg(F.count("*").alias("wallets"), r(F.sum("usd"), 2).alias("usd")).filter("wallets >= 2")


def join_alerts_to_subscribers(spark, sf):
    """Alerts for each subscriber (any wallet) by severity floor and watched kind: alerts are summed by kind and rank first."""
    rank = F.when(F.col("usd") >= 90_000, 3).when(F.col("usd") >= 80_000, 2).otherwise(1)
    alerts = t.fills(spark, sf).filter("usd >= 70000").join(t.wallets(spark, sf).select("wallet", "kind"), "wallet").withColumn("rank", rank)
    sums = alerts.groupBy("kind", "rank").agg(F.count("*").alias("n"), F.sum("usd").alias("usd"))
    floors = sums.crossJoin(F.broadcast(spark.range(1, 4).withColumnRenamed("id", "floor"))).filter("rank >= floor")  # three rows
    floors = floors.groupBy("kind", "floor").agg(F.sum("n").alias("alerts"), F.sum("usd").alias("usd"))
    subs = t.wallets(spark, sf).select(F.col("wallet").alias("subscriber"), "kind", (F.col("wallet") % 3 + 1).alias("floor"))
    return subs.join(floors, ["kind", "floor"]).select("subscriber", "alerts", r("usd", 2).alias("usd"))


def top_markets(spark, sf):
    return t.fills(spark, sf).groupBy("market").agg(r(F.sum("usd"), 2).alias("usd")).orderBy(F.desc("usd"), "market").limit(25)


def top_first_trade(spark, sf):
    """Each wallet's earliest fill."""
    at = F.struct("ts_ms", "order_id", "line", "market", "counterparty", "usd", "pnl")
    return t.fills(spark, sf).groupBy("wallet").agg(F.min(at).alias("x")).select("wallet", "x.ts_ms", "x.order_id", "x.line", "x.usd")


def top_latest_snapshot(spark, sf):
    """The last day's totals of each market: one row a market."""
    d = t.fills(spark, sf).groupBy("market", stats.bucket_ms(F.col("ts_ms"), t.DAY).alias("day")).agg(F.count("*").alias("n"), r(F.sum("usd"), 2).alias("usd"))
    return d.groupBy("market").agg(F.max_by(F.struct("day", "n", "usd"), "day").alias("x")).select("market", "x.*")


def top_page(spark, sf):
    """The third page of ten of the largest fills, with the total."""
    f = t.fills(spark, sf)
    page = f.orderBy(F.desc("usd"), "order_id", "line", "market", "counterparty").offset(20).limit(10)
    return page.crossJoin(F.broadcast(f.agg(F.count("*").alias("total")))).select("order_id", "line", "usd", "total")  # one row


def set_filters(spark, sf):
    """Conjunctive predicates: side, range, category set, text."""
    m = t.markets(spark, sf).filter(F.col("category").isin("PROMO", "SMALL") & F.lower("title").contains("a"))
    return t.fills(spark, sf).filter("side = 'SELL' and usd between 20000 and 60000").join(m, "market", "left_semi").groupBy("market").agg(F.count("*").alias("n"))


def set_wallet_roles(spark, sf):
    """Ids that are only wallets, only counterparties or both: full outer join of two distinct sets."""
    f = t.fills(spark, sf)
    a, b = f.select(F.col("wallet").alias("id")).distinct().withColumn("w", F.lit(1)), f.select(F.col("counterparty").alias("id")).distinct().withColumn("c", F.lit(1))
    role = F.when(F.col("w").isNotNull() & F.col("c").isNotNull(), "both").when(F.col("w").isNotNull(), "wallet").otherwise("counterparty")
    return a.join(b, "id", "full").groupBy(role.alias("role")).agg(F.count("*").alias("n"))


def set_upserted(spark, sf):
    """One row an order and line: economic columns of the first arrival, the flag of the last, by order of arrival."""
    f = t.fills(spark, sf)
    at = F.struct("ts_ms", "market", "counterparty", "usd", "pnl")
    return f.groupBy("order_id", "line").agg(F.min_by("usd", at).alias("usd"), F.min_by("size", at).alias("size"), F.max_by("win", at).alias("win"), F.count("*").alias("arrivals"))


QUERIES = {f.__name__: f for f in (
    join_dimensions, join_hot_markets, join_daily_profit, join_active_wallets, join_new_wallets, join_between_wallets, join_as_of_volume, join_pre_event_volume, pair_timing, pair_direction, pair_market_overlap,
    pair_coordination, pair_star_groups, pair_cross_market, pair_title_classes, pair_related_titles, graph_funding_reach, graph_funding_sources, join_alerts_to_subscribers, top_markets, top_first_trade, top_latest_snapshot,
    top_page, set_filters, set_wallet_roles, set_upserted,
)}

_WM = "wm AS (SELECT DISTINCT wallet, market FROM fills), sp AS (SELECT x.wallet AS a, y.wallet AS b, count(*) AS shared FROM wm x JOIN wm y ON x.market = y.market AND x.wallet < y.wallet GROUP BY ALL)"
_TITLES = """,w AS (SELECT market, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: length(x) > 3))) AS words FROM markets),
c AS (SELECT words, min(market) AS class, count(*) AS n FROM w WHERE len(words) > 1 GROUP BY words)"""

ORACLE_SQL = {
    "join_dimensions": t.sql("fills markets wallets", "SELECT category, region, count(*) AS n, round(sum(usd), 2) AS usd FROM fills LEFT JOIN markets USING (market) LEFT JOIN wallets USING (wallet) GROUP BY ALL"),
    "join_hot_markets": t.sql("fills markets", "SELECT market, alerts, first_wallet, title, category FROM (SELECT market, count(*) AS alerts, arg_min(wallet, (ts_ms, order_id, line, usd, wallet, counterparty)) AS first_wallet FROM fills WHERE usd >= 80000 GROUP BY market) JOIN markets USING (market) ORDER BY alerts DESC, market LIMIT 20"),
    "join_daily_profit": t.sql("fills markets", "SELECT day, round(g, 2) AS gain, round(sum(g) OVER (ORDER BY day), 2) AS running FROM (SELECT ts_ms // 86400000 * 86400000 AS day, sum(CASE WHEN side = 'BUY' THEN CASE WHEN win THEN usd * 0.1 ELSE -usd END ELSE CASE WHEN win THEN -usd * 0.1 ELSE usd END END) AS g FROM fills WHERE market IN (SELECT market FROM markets WHERE category = 'PROMO') GROUP BY ALL)"),
    "join_active_wallets": t.sql("fills wallets", "SELECT wallet, label, kind FROM wallets WHERE wallet IN (SELECT wallet FROM fills, (SELECT max(ts_ms) AS now FROM fills) WHERE ts_ms > now - 31536000000)"),
    "join_new_wallets": t.sql("fills wallets", "SELECT wallet, label FROM wallets ANTI JOIN fills USING (wallet)"),
    "join_between_wallets": t.sql("fills", "SELECT least(wallet, counterparty) AS a, greatest(wallet, counterparty) AS b, count(*) AS n, round(sum(usd), 2) AS usd FROM fills GROUP BY ALL HAVING count(*) >= 3"),
    "join_as_of_volume": t.sql("trades", "SELECT trade_id, wallet, view_id, round(q, 5) AS ratio, CASE WHEN q >= 5 THEN 'extreme' WHEN q >= 2 THEN 'high' WHEN q >= 1 THEN 'elevated' ELSE 'normal' END AS level FROM (SELECT l.trade_id, l.wallet, v.trade_id AS view_id, CASE WHEN v.usd IS NULL THEN l.usd ELSE l.usd / greatest(v.usd, 1) END AS q FROM (SELECT * FROM trades WHERE market = 'purchase') l ASOF LEFT JOIN (SELECT * FROM trades WHERE market = 'view') v ON l.wallet = v.wallet AND l.ts_ms >= v.ts_ms)"),
    "join_pre_event_volume": t.sql("trades", "SELECT e.trade_id AS event_id, count(*) AS n, round(coalesce(sum(o.usd) FILTER (o.ts_ms < e.ts_ms - 3600000), 0), 4) AS day_before, round(coalesce(sum(o.usd) FILTER (o.ts_ms >= e.ts_ms - 3600000), 0), 4) AS hour_before FROM trades e JOIN trades o ON e.wallet = o.wallet AND o.market != 'error' AND o.ts_ms < e.ts_ms AND o.ts_ms >= e.ts_ms - 86400000 WHERE e.market = 'error' AND e.usd >= 50 GROUP BY 1"),
    "pair_timing": t.sql(
        "trades",
        """,s AS (SELECT wallet, count(*) AS total FROM trades GROUP BY wallet)
        SELECT a, b, hits, round(least(hits / least(x.total, y.total), 1), 6) AS timing
        FROM (SELECT p.wallet AS a, q.wallet AS b, count(DISTINCT p.trade_id) AS hits FROM trades p JOIN trades q
              ON p.market = q.market AND p.wallet != q.wallet AND q.ts_ms BETWEEN p.ts_ms - 60000 AND p.ts_ms + 60000 GROUP BY ALL)
        JOIN s x ON x.wallet = a JOIN s y ON y.wallet = b""",
    ),
    "pair_direction": t.sql("fills", "SELECT p.wallet AS a, q.wallet AS b, count(*) AS n, round(avg((p.side = q.side)::INT), 6) AS same_side FROM fills p JOIN fills q ON p.market = q.market AND p.ts_ms // 86400000 = q.ts_ms // 86400000 AND p.wallet < q.wallet GROUP BY ALL"),
    "pair_market_overlap": t.sql("fills", "," + _WM + ", z AS (SELECT wallet, count(*) AS n FROM wm GROUP BY wallet) SELECT a, b, shared, round(shared / (x.n + y.n - shared) * 100, 5) AS jaccard FROM sp JOIN z x ON x.wallet = a JOIN z y ON y.wallet = b WHERE shared >= 3"),
    "pair_coordination": t.sql("fills", "," + _WM + ", w AS (SELECT wallet, avg(usd) AS size, avg(win::INT) AS wins, avg((side = 'BUY')::INT) AS buys, count(DISTINCT market) AS markets FROM fills GROUP BY wallet) SELECT a, b, shared, s AS score, s >= 60 AS coordinated FROM (SELECT a, b, shared, round(100 * (0.4 * shared / (x.markets + y.markets - shared) + 0.25 * least(x.size, y.size) / greatest(x.size, y.size) + 0.2 * greatest(1 - 2 * abs(x.wins - y.wins), 0) + 0.15 * (1 - abs(x.buys - y.buys))), 4) AS s FROM sp JOIN w x ON x.wallet = a JOIN w y ON y.wallet = b WHERE shared >= 3)"),
    "pair_star_groups": t.sql("fills", "," + _WM + ", e AS (SELECT a, b FROM sp WHERE shared >= 4 UNION ALL SELECT b, a FROM sp WHERE shared >= 4) SELECT a AS wallet, count(*) AS n, string_agg(b, ',' ORDER BY b) AS members FROM e GROUP BY a HAVING count(*) >= 2"),
    "pair_cross_market": t.sql("trades", ",d AS (SELECT wallet, market, ts_ms // 86400000 AS day, sum(usd) AS usd FROM trades GROUP BY ALL) SELECT x.market AS a, y.market AS b, count(*) AS n, count(DISTINCT x.wallet) AS wallets, round(CASE WHEN var_pop(x.usd) > 0 AND var_pop(y.usd) > 0 THEN corr(x.usd, y.usd) ELSE 0 END, 5) AS r FROM d x JOIN d y ON x.wallet = y.wallet AND x.day = y.day AND x.market < y.market GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT x.wallet) >= 2"),
    "pair_related_titles": t.sql(
        "markets",
        _TITLES
        + """,u AS (SELECT class, n, unnest(words) AS word FROM c)
        SELECT x.class AS a, y.class AS b, count(*) AS shared, any_value(x.n * y.n) AS pairs FROM u x JOIN u y ON x.word = y.word AND x.class < y.class GROUP BY ALL HAVING count(*) >= 2
        UNION ALL SELECT class, class, len(words), n * (n - 1) // 2 FROM c WHERE n > 1""",
    ),
    "pair_title_classes": t.sql("markets", _TITLES + " SELECT market, class, n FROM w JOIN c USING (words)"),
    "graph_funding_reach": "WITH RECURSIVE "
    + t.SQL["fills"]
    + """, e AS (SELECT DISTINCT counterparty AS source, wallet AS target FROM fills WHERE usd >= 60000),
        g AS (SELECT wallet AS start, wallet AS node, 0 AS depth FROM fills WHERE usd >= 104000 UNION SELECT start, source, depth + 1 FROM g JOIN e ON node = target WHERE depth < 3)
        SELECT start, node, min(depth) AS depth FROM g GROUP BY start, node""",
    "graph_funding_sources": t.sql("fills", "SELECT counterparty AS source, count(DISTINCT wallet) AS wallets, round(sum(usd), 2) AS usd FROM fills GROUP BY 1 HAVING count(DISTINCT wallet) >= 2"),
    "join_alerts_to_subscribers": t.sql(
        "fills wallets",
        """,a AS (SELECT kind, CASE WHEN usd >= 90000 THEN 3 WHEN usd >= 80000 THEN 2 ELSE 1 END AS severity, count(*) AS n, sum(usd) AS usd FROM fills JOIN wallets USING (wallet) WHERE usd >= 70000 GROUP BY ALL)
        SELECT wallet AS subscriber, sum(n)::BIGINT AS alerts, round(sum(usd), 2) AS usd FROM wallets JOIN a ON a.kind = wallets.kind AND severity >= wallet % 3 + 1 GROUP BY 1""",
    ),
    "top_markets": t.sql("fills", "SELECT market, round(sum(usd), 2) AS usd FROM fills GROUP BY market ORDER BY usd DESC, market LIMIT 25"),
    "top_first_trade": t.sql("fills", "SELECT wallet, ts_ms, order_id, line, usd FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY ts_ms, order_id, line, market, counterparty, usd, pnl) AS i FROM fills) WHERE i = 1"),
    "top_latest_snapshot": t.sql("fills", "SELECT DISTINCT ON (market) market, day, n, usd FROM (SELECT market, ts_ms // 86400000 * 86400000 AS day, count(*) AS n, round(sum(usd), 2) AS usd FROM fills GROUP BY ALL) ORDER BY market, day DESC"),
    "top_page": t.sql("fills", "SELECT order_id, line, usd, count(*) OVER () AS total FROM fills ORDER BY usd DESC, order_id, line, market, counterparty LIMIT 10 OFFSET 20"),
    "set_filters": t.sql("fills markets", "SELECT market, count(*) AS n FROM fills WHERE side = 'SELL' AND usd BETWEEN 20000 AND 60000 AND market IN (SELECT market FROM markets WHERE category IN ('PROMO', 'SMALL') AND title ILIKE '%a%') GROUP BY market"),
    "set_wallet_roles": t.sql("fills", "SELECT CASE WHEN w AND c THEN 'both' WHEN w THEN 'wallet' ELSE 'counterparty' END AS role, count(*) AS n FROM (SELECT id, bool_or(k = 'w') AS w, bool_or(k = 'c') AS c FROM (SELECT wallet AS id, 'w' AS k FROM fills UNION SELECT counterparty, 'c' FROM fills) GROUP BY id) GROUP BY 1"),
    "set_upserted": t.sql("fills", "SELECT order_id, line, arg_min(usd, k) AS usd, arg_min(size, k) AS size, arg_max(win, k) AS win, count(*) AS arrivals FROM (SELECT *, (ts_ms, market, counterparty, usd, pnl) AS k FROM fills) GROUP BY ALL"),
}
