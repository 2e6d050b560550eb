"""Detectors, scores, order books, calibration and text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import tables as t
from ..functions import stats
from ..operators import book, scoring, sequences

r = stats.rounded

#: Topics and the weights of their words.
# Words that tell what language a document is about to be read in, by weight.
TOPICS = {
    "english": {"the": 20, "and": 10, "of": 10, "that": 10, "was": 10, "with": 8, "from": 8, "for": 8, "to": 5, "in": 2, "is": 5, "ing": 2},
    "french": {"le": 10, "la": 4, "les": 8, "des": 6, "et": 10, "dans": 15, "avec": 15, "pour": 10, "une": 10, "que": 4, "sur": 8, "aux": 5},
    "german": {"der": 15, "die": 10, "und": 15, "nicht": 15, "mit": 10, "von": 10, "zu": 8, "ein": 8, "auch": 10, "das": 8, "ist": 8, "den": 5},
    "spanish": {"el": 12, "los": 12, "las": 10, "que": 5, "por": 10, "una": 10, "del": 8, "como": 10, "para": 8, "con": 8, "su": 5, "est": 2},
}


def det_volume_clusters(spark, sf):
    """Windows of an hour with three wallets and four trades or more, scored by direction, wallets, trades, volume and timing."""
    a = sequences.anchored_totals(t.trades(spark, sf), ["market"], t.HOUR, 600_000).withColumnRenamed("wallets", "w").filter("n >= 4 and w >= 3")
    lean = F.abs(2 * F.col("buys") - F.col("n")) / F.col("n")
    score = 100 * (0.25 * lean + 0.25 * F.least((F.col("w") - 2) / 8, F.lit(1.0)) + 0.25 * F.least((F.col("n") - 3) / 17, F.lit(1.0)) + 0.25 * F.least(F.col("usd") / 1000, F.lit(1.0)))
    kind = F.when(lean < 0.3, "counter").when(lean >= 0.8, "directional").otherwise("mixed")
    return a.select("market", "window_start", "n", F.col("w").alias("wallets"), r(score, 4).alias("score"), kind.alias("kind")).withColumn("severity", stats.ladder(F.col("score"), [(85, "critical"), (70, "high"), (50, "medium")], "low"))


def det_whale_tiers(spark, sf):
    """Trades by tiers of a threshold blended from fixed steps and the market's own percentiles."""
    f = t.fills(spark, sf)
    p = f.groupBy("market").agg(F.percentile("usd", F.array(F.lit(0.9), F.lit(0.99))).alias("p"), F.avg("usd").alias("m"))
    j = f.select("order_id", "line", "market", "usd", "counterparty").join(p, "market")
    bound = stats.clamp(0.4 * F.col("p")[0] + 0.4 * F.col("p")[1] + 0.2 * F.lit(50_000.0), 1_000, 500_000)
    tier = stats.ladder(F.col("usd"), [(500_000, "leviathan"), (100_000, "mega"), (50_000, "whale"), (10_000, "large"), (1_000, "notable")], "small")
    return j.withColumn("bound", bound).filter(F.col("usd") >= F.col("bound") + 1e-6).groupBy("market", tier.alias("tier")).agg(F.count("*").alias("n"), r(F.max("bound"), 3).alias("bound"))


def det_trade_size_flags(spark, sf):
    """Trades that are large by percentile, by z-score or by absolute size, the strongest of the three deciding."""
    e = t.trades(spark, sf)
    # counted by value first: what a market's percentiles are taken from is as many rows as there are values
    v = e.groupBy("market", "usd").agg(F.count("*").alias("n"))
    p = v.groupBy("market").agg(F.percentile("usd", F.array(*[F.lit(x) for x in (0.75, 0.9, 0.99)]), F.col("n")).alias("p"))
    s = e.groupBy("market").agg(F.avg("usd").alias("m"), F.stddev_pop("usd").alias("s")).join(p, "market")
    j = e.join(s, "market").withColumn("z", r(stats.population_z(F.col("usd"), F.col("m"), F.col("s")), 5))
    by_p = F.when(F.col("usd") >= F.col("p")[2], 3).when(F.col("usd") >= F.col("p")[1], 2).when(F.col("usd") >= F.col("p")[0], 1).otherwise(0)
    by_z = F.when(F.col("z") >= 4, 4).when(F.col("z") >= 3, 3).when(F.col("z") >= 2, 2).otherwise(0)
    level = F.greatest(by_p, by_z, F.when(F.col("usd") >= 1000, 3).otherwise(0))
    return j.filter(level >= 2).select("trade_id", "market", "z", level.alias("level"))


def det_volume_percentile_rank(spark, sf):
    """Where each hour's volume of a market lies among its own, by piecewise-linear ranks."""
    v = t.trades(spark, sf).groupBy("market", stats.bucket_ms(F.col("ts_ms"), t.HOUR).alias("hour")).agg(F.sum("usd").alias("v"))
    p = v.groupBy("market").agg(F.percentile("v", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.95)])).alias("p"))
    rank = stats.percentile_rank(F.col("v"), [(x, F.col("p")[i]) for i, x in enumerate((25.0, 50.0, 75.0, 95.0))])
    return v.join(p, "market").select("market", "hour", r(rank, 4).alias("rank"))


def det_fresh_wallets(spark, sf):
    """Wallets by the number of their trades and their age at the end of the data."""
    f = t.fills(spark, sf)
    now = f.agg(F.max("ts_ms").alias("now"))
    a = t.wallets(spark, sf).select("wallet").join(f.groupBy("wallet").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first")), "wallet", "left").crossJoin(F.broadcast(now))  # one row
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "none").when(n == 1, "single").when(n <= 30, "minimal").otherwise("history")
    days = F.floor((F.col("now") - F.col("first")) / t.DAY)
    return a.select("wallet", n.cast("long").alias("n"), status.alias("status"), days.alias("age_days"), stats.ladder(-days, [(-1, "critical"), (-7, "high"), (-30, "medium"), (-90, "low")], "none").alias("freshness"))


def det_history_depth(spark, sf):
    """Weighted sum of capped linear factors of a wallet's history."""
    a = t.fills(spark, sf).groupBy("wallet").agg(F.count("*").alias("n"), F.countDistinct("market").alias("m"), F.sum("usd").alias("usd"), (F.max("ts_ms") - F.min("ts_ms")).alias("span"))
    cap = lambda c, most: F.least(F.col(c) / most, F.lit(1.0))
    return a.select("wallet", r(100 * (0.3 * cap("n", 500.0) + 0.25 * cap("m", 200.0) + 0.25 * cap("usd", 2e7) + 0.2 * cap("span", 2.5e11)), 4).alias("depth"))


def signals(spark, sf):
    """Long table of signals from 0 to 100 a wallet, null where they can't be told."""
    a = t.fills(spark, sf).groupBy("wallet").agg(F.count("*").alias("n"), F.avg(F.col("win").cast("double")).alias("wins"), F.max("usd").alias("most"), F.avg("usd").alias("mean"), F.countDistinct("market").alias("m"), F.avg((F.col("side") == "BUY").cast("double")).alias("buys"))
    values = {"win_rate": F.col("wins") * 100, "size": F.least(F.col("most") / 1000, F.lit(100.0)), "focus": 100 - F.least(F.try_divide("m", "n") * 50, F.lit(100.0)), "lean": F.abs(F.col("buys") - 0.5) * 200, "activity": F.when(F.col("n") >= 5, F.least(F.col("n") / 5, F.lit(100.0)))}
    return a.select("wallet", F.inline(F.array(*[F.struct(F.lit(k).alias("signal"), r(v, 6).alias("value")) for k, v in values.items()])))


WEIGHTS = {"win_rate": 0.3, "size": 0.2, "focus": 0.2, "lean": 0.1, "activity": 0.2}


def score_composite(spark, sf):
    out = scoring.composite(signals(spark, sf), "wallet", WEIGHTS, 3)
    return out.select("wallet", "signals", r("raw", 4).alias("raw"), "boosted", stats.ladder(F.col("boosted"), [(80, "critical"), (60, "high"), (40, "medium"), (20, "low")], "minimal").alias("level"))


def score_alert_priority(spark, sf):
    """Alerts ranked by size, win and age: a weighted mean, decayed after a day to no less than half."""
    e = t.trades(spark, sf).filter("usd >= 100")
    j = e.crossJoin(F.broadcast(t.trades(spark, sf).agg(F.max("ts_ms").alias("now"))))  # one row
    hours = (F.col("now") - F.col("ts_ms")) / t.HOUR
    base = 0.7 * F.least(F.col("usd") / 10, F.lit(100.0)) + 0.3 * F.least(F.col("size"), F.lit(100.0))
    s = j.select("trade_id", r(base * scoring.time_decay(hours), 4).alias("score"))
    return sequences.ranked(s, -F.floor(F.col("score") * 10), [F.desc("score"), "trade_id"]).withColumn("level", stats.ladder(F.col("score"), [(85, "urgent"), (70, "high"), (50, "medium"), (30, "low")], "info"))


def score_signal_effectiveness(spark, sf):
    """Accuracy, lift and a Wilson interval of each side as a signal of winning, and z against all others."""
    f = t.fills(spark, sf).join(t.markets(spark, sf).select("market", "category"), "market")
    a = f.groupBy("category", "side").agg(F.count("*").alias("n"), F.count_if("win").alias("hits"))
    w = Window.partitionBy("category")
    a = a.withColumns({"all_n": F.sum("n").over(w), "all_hits": F.sum("hits").over(w)})
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    z = stats.two_proportion_z(F.col("hits"), F.col("n"), F.col("all_hits") - F.col("hits"), F.col("all_n") - F.col("n"))
    return a.select("category", "side", "n", r(F.try_divide("hits", "n"), 6).alias("accuracy"), r(F.try_divide(F.try_divide("hits", "n"), F.try_divide("all_hits", "all_n")), 6).alias("lift"), r(low, 6).alias("low"), r(high, 6).alias("high"), r(z, 5).alias("z")).withColumn("significant", F.abs("z") >= 1.96)


def predicted(spark, sf):
    """A probability p of each fill from its size, and its outcome y."""
    f = t.fills(spark, sf)
    return f.select(F.least(F.greatest(r(F.col("usd") / 110_000, 2), F.lit(0.01)), F.lit(0.99)).alias("p"), F.col("win").cast("int").alias("y"), "ts_ms", "wallet", "order_id", "line")


def cal_scores(spark, sf):
    return scoring.calibration(predicted(spark, sf), "p", "y").select("n", r("brier", 6).alias("brier"), r("log_loss", 6).alias("log_loss"), r("rate", 6).alias("rate"))


def cal_reliability(spark, sf):
    return scoring.reliability(predicted(spark, sf), "p", "y").select("bin", "n", r("predicted", 6).alias("predicted"), r("observed", 6).alias("observed"))


def cal_auc(spark, sf):
    return scoring.auc(predicted(spark, sf), "p", "y").select(r("auc", 6).alias("auc"))


def cal_confusion(spark, sf):
    out = scoring.confusion(predicted(spark, sf), F.col("p") >= 0.5, "y")
    return out.select("tp", "fp", "fn", "tn", *[r(c, 6).alias(c) for c in ("precision", "recall", "f1", "f2", "mcc")])


def cal_thresholds(spark, sf):
    return scoring.best_threshold(predicted(spark, sf), "p", "y", [x / 100 for x in range(10, 95, 5)]).select("threshold", r("f1", 6).alias("f1"))


def cal_walk_forward(spark, sf):
    """Test folds of 180 days after 365 days of training, at most ten: accuracy of a fixed threshold in each."""
    p = predicted(spark, sf)
    first = p.agg(F.min("ts_ms").alias("first"))
    day = p.crossJoin(F.broadcast(first)).withColumn("fold", F.floor((F.col("ts_ms") - F.col("first") - 365 * t.DAY) / (180 * t.DAY)))  # one row
    return day.filter("fold between 0 and 9").groupBy("fold").agg(F.count("*").alias("n"), r(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")), 6).alias("accuracy"))


def book_stats(spark, sf):
    return book.book_stats(_levels(spark, sf)).select("book", "bid", "ask", r("bids", 3).alias("bids"), r("asks", 3).alias("asks"), r("spread", 6).alias("spread"), r("middle", 6).alias("middle"), r("ratio", 6).alias("ratio"))


def _levels(spark, sf):
    """Books from fills: sellers below each market's median price bid, the others ask; prices to whole numbers."""
    l = book.with_median(t.by_market(spark, sf, "price", "size"), "market", "price").filter(F.col("price") != F.col("m"))
    side = F.when(F.col("price") < F.col("m"), "bid").otherwise("ask")
    return l.groupBy(F.col("market").alias("book"), side.alias("side"), F.floor("price").cast("double").alias("price")).agg(F.sum("size").alias("size"))


def book_depth(spark, sf):
    out = book.with_depth(book.aggregated(_levels(spark, sf), 100.0))
    return out.select("book", "side", "price", "levels", "place", r("depth", 3).alias("depth"), r("value", 3).alias("value"))


def book_fill_price(spark, sf):
    return book.fill_price(_levels(spark, sf), "ask", 100.0).select("book", r("average", 5).alias("average"), "worst")


def book_within(spark, sf):
    return book.within(_levels(spark, sf), 0.05).withColumn("size", r("size", 3))


def det_market_impact(spark, sf):
    """Expected basis points of each large fill against its market's depth, by severity."""
    d = _levels(spark, sf).groupBy(F.col("book").alias("market")).agg(F.sum(F.col("price") * F.col("size")).alias("depth"))
    f = t.fills(spark, sf).filter("usd >= 60000").join(d, "market", "left")
    bps = r(book.expected_impact(F.col("usd"), F.col("depth")), 4)
    return f.groupBy("market", stats.ladder(bps, [(500, "severe"), (200, "high"), (100, "medium"), (50, "low")], "none").alias("severity")).agg(F.count("*").alias("n"), F.max(bps).alias("most"))


def txt_topics(spark, sf):
    """Documents by the topic whose words weigh most, 25 or more of at most 100; each word counts once a document.

    What is left of a text is a short array; it is chosen from inside the expression, as a filter over it would be
    worked out below the projection a second time.
    """
    known = sorted({w for ws in TOPICS.values() for w in ws})
    words = F.array_intersect(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), F.array(*[F.lit(w) for w in known]))

    def best(has):
        score = lambda ws: F.least(sum((F.when(F.array_contains(has, w), float(x)).otherwise(0.0) for w, x in ws.items()), F.lit(0.0)), F.lit(100.0))
        found = F.array_min(F.array(*[F.struct((-score(ws)).alias("minus"), F.lit(topic).alias("topic")) for topic, ws in TOPICS.items()]))
        return F.filter(F.array(found), lambda x: x["minus"] <= -25)

    d = t.table(spark, sf, "documents").select("doc_id", F.inline(stats.let(words, best)))
    return d.select("doc_id", "topic", (-F.col("minus")).alias("score"))


def txt_sentiment(spark, sf):
    """Net share of bright and dark words in each message of the conversations."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")
    count = lambda known: F.size(F.filter(words, lambda x: x.isin(*known)))
    c = t.table(spark, sf, "conversations").select("conv_id", "turn", count(("the", "and", "of")).alias("up"), count(("to", "in", "a")).alias("down"))
    return c.groupBy("conv_id").agg(F.sum("up").alias("up"), F.sum("down").alias("down"), r(F.coalesce(F.try_divide(F.sum("up") - F.sum("down"), F.sum("up") + F.sum("down")), F.lit(0.0)), 6).alias("score"))


def txt_keywords(spark, sf):
    """Words of over three letters in market titles, without stop words, by how many titles have them."""
    w = t.markets(spark, sf).select("market", F.explode(F.array_except(F.split(F.lower("title"), "[^a-z0-9]+"), F.array(*[F.lit(x) for x in ("the", "with", "from", "part")]))).alias("word"))
    return w.filter("length(word) > 3").groupBy("word").agg(F.countDistinct("market").alias("n"))


def txt_parsed_properties(spark, sf):
    """JSON properties typed by a schema; what doesn't parse is null."""
    e = t.table(spark, sf, "events").select("event_type", F.from_json("props", "k double").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("p.k").alias("parsed"), r(F.sum("p.k"), 4).alias("k"))


QUERIES = {f.__name__: f for f in (
    det_volume_clusters, det_whale_tiers, det_trade_size_flags, det_volume_percentile_rank, det_fresh_wallets, det_history_depth, score_composite, score_alert_priority, score_signal_effectiveness, cal_scores,
    cal_reliability, cal_auc, cal_confusion, cal_thresholds, cal_walk_forward, book_stats, book_depth, book_fill_price, book_within, det_market_impact, txt_topics, txt_sentiment, txt_keywords, txt_parsed_properties,
)}

_LEVELS = ",l AS (SELECT f.market AS book, CASE WHEN price < m THEN 'bid' ELSE 'ask' END AS side, floor(price) AS price, sum(size) AS size FROM fills f JOIN (SELECT market, median(price) AS m FROM fills GROUP BY market) USING (market) WHERE price != m GROUP BY ALL)"
PREDICTED = ",q AS (SELECT least(greatest(round(usd / 110000, 2), 0.01), 0.99) AS p, win::INT AS y, ts_ms, wallet, order_id, line FROM fills)"
_HOURLY = ",v AS (SELECT market, ts_ms // 3600000 * 3600000 AS hour, sum(usd) AS v FROM trades GROUP BY ALL)"
_BEST = "CASE WHEN side = 'bid' THEN -price ELSE price END"

ORACLE_SQL = {
    "det_volume_clusters": t.sql("trades", """SELECT market, s AS window_start, n, w AS wallets, score, CASE WHEN lean < 0.3 THEN 'counter' WHEN lean >= 0.8 THEN 'directional' ELSE 'mixed' END AS kind, CASE WHEN score >= 85 THEN 'critical' WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS severity
        FROM (SELECT *, round(100 * (0.25 * lean + 0.25 * least((w - 2) / 8, 1) + 0.25 * least((n - 3) / 17, 1) + 0.25 * least(usd / 1000, 1)), 4) AS score FROM (SELECT market, s, count(*) AS n, count(DISTINCT wallet) AS w, sum(usd) AS usd, abs(2 * count(*) FILTER (side = 'BUY') - count(*)) / count(*) AS lean
        FROM (SELECT x.*, unnest(range(greatest(0, ceil((ts_ms - f - 3600000) / 600000)::BIGINT), (ts_ms - f) // 600000 + 1)) * 600000 + f AS s FROM trades x JOIN (SELECT market, min(ts_ms) AS f FROM trades GROUP BY market) USING (market)) GROUP BY market, s HAVING count(*) >= 4 AND count(DISTINCT wallet) >= 3))"""),
    "det_whale_tiers": t.sql("fills", "SELECT market, CASE WHEN usd >= 500000 THEN 'leviathan' WHEN usd >= 100000 THEN 'mega' WHEN usd >= 50000 THEN 'whale' WHEN usd >= 10000 THEN 'large' WHEN usd >= 1000 THEN 'notable' ELSE 'small' END AS tier, count(*) AS n, round(max(b), 3) AS bound FROM fills JOIN (SELECT market, least(greatest(0.4 * quantile_cont(usd, 0.9) + 0.4 * quantile_cont(usd, 0.99) + 0.2 * 50000, 1000), 500000) AS b FROM fills GROUP BY market) USING (market) WHERE usd >= b + 1e-6 GROUP BY 1, 2"),
    "det_trade_size_flags": t.sql("trades", "SELECT trade_id, market, z, l AS level FROM (SELECT *, greatest(CASE WHEN usd >= p[3] THEN 3 WHEN usd >= p[2] THEN 2 WHEN usd >= p[1] THEN 1 ELSE 0 END, CASE WHEN z >= 4 THEN 4 WHEN z >= 3 THEN 3 WHEN z >= 2 THEN 2 ELSE 0 END, CASE WHEN usd >= 1000 THEN 3 ELSE 0 END) AS l FROM (SELECT *, round(CASE WHEN s > 0 THEN (usd - m) / s ELSE 0 END, 5) AS z FROM trades JOIN (SELECT market, avg(usd) AS m, stddev_pop(usd) AS s, quantile_cont(usd, [0.75, 0.9, 0.99]) AS p FROM trades GROUP BY market) USING (market))) WHERE l >= 2"),
    "det_volume_percentile_rank": t.sql("trades", _HOURLY + """ SELECT market, hour, round(least(CASE WHEN v <= a THEN coalesce(25 * v / nullif(a, 0), 0) WHEN v <= b THEN 25 + 25 * coalesce((v - a) / nullif(b - a, 0), 0) WHEN v <= c THEN 50 + 25 * coalesce((v - b) / nullif(c - b, 0), 0) WHEN v <= d THEN 75 + 20 * coalesce((v - c) / nullif(d - c, 0), 0) ELSE 95 + 5 * coalesce((v - d) / nullif(d, 0), 1) END, 100), 4) AS rank
        FROM v JOIN (SELECT market, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c, quantile_cont(v, 0.95) AS d FROM v GROUP BY market) USING (market)"""),
    "det_fresh_wallets": t.sql("fills wallets", "SELECT wallet, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN n = 1 THEN 'single' WHEN n <= 30 THEN 'minimal' ELSE 'history' END AS status, d AS age_days, CASE WHEN d <= 1 THEN 'critical' WHEN d <= 7 THEN 'high' WHEN d <= 30 THEN 'medium' WHEN d <= 90 THEN 'low' ELSE 'none' END AS freshness FROM (SELECT wallet, n, (now - first) // 86400000 AS d FROM wallets LEFT JOIN (SELECT wallet, count(*) AS n, min(ts_ms) AS first FROM fills GROUP BY wallet) USING (wallet), (SELECT max(ts_ms) AS now FROM fills))"),
    "det_history_depth": t.sql("fills", "SELECT wallet, round(100 * (0.3 * least(count(*) / 500.0, 1) + 0.25 * least(count(DISTINCT market) / 200.0, 1) + 0.25 * least(sum(usd) / 2e7, 1) + 0.2 * least((max(ts_ms) - min(ts_ms)) / 2.5e11, 1)), 4) AS depth FROM fills GROUP BY wallet"),
    "score_composite": t.sql("fills", """,a AS (SELECT wallet, count(*) AS n, avg(win::INT) AS wins, max(usd) AS most, count(DISTINCT market) AS m, avg((side = 'BUY')::INT) AS buys FROM fills GROUP BY wallet),
        s AS (SELECT wallet, unnest([{'w': 0.3::DOUBLE, 'v': round(wins * 100, 6)}, {'w': 0.2, 'v': round(least(most / 1000, 100), 6)}, {'w': 0.2, 'v': round(100 - least(m / n * 50, 100), 6)}, {'w': 0.1, 'v': round(abs(buys - 0.5) * 200, 6)}, {'w': 0.2, 'v': CASE WHEN n >= 5 THEN round(least(n / 5, 100), 6) END}]) AS x FROM a),
        c AS (SELECT wallet, count(*) AS signals, sum(x.v * x.w) / sum(x.w) AS raw, count(*) FILTER (x.v >= 60) AS h FROM s WHERE x.v IS NOT NULL GROUP BY wallet HAVING count(*) >= 3),
        b AS (SELECT *, least(greatest(floor(raw * CASE WHEN h >= 3 THEN least(1 + 0.05::DOUBLE * (h - 2), 1.25) ELSE 1 END + 1e-9 + 0.5), 0), 100)::BIGINT AS boosted FROM c)
        SELECT wallet, signals, round(raw, 4) AS raw, boosted, CASE WHEN boosted >= 80 THEN 'critical' WHEN boosted >= 60 THEN 'high' WHEN boosted >= 40 THEN 'medium' WHEN boosted >= 20 THEN 'low' ELSE 'minimal' END AS level FROM b"""),
    "score_alert_priority": t.sql("trades", ",s AS (SELECT trade_id, round((0.7 * least(usd / 10, 100) + 0.3 * least(size, 100)) * CASE WHEN h <= 24 THEN 1 ELSE greatest(1 - 0.005 * (h - 24), 0.5) END, 4) AS score FROM (SELECT *, (now - ts_ms) / 3600000 AS h FROM trades, (SELECT max(ts_ms) AS now FROM trades) WHERE usd >= 100)) SELECT trade_id, score, row_number() OVER (ORDER BY score DESC, trade_id) AS rank, CASE WHEN score >= 85 THEN 'urgent' WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'medium' WHEN score >= 30 THEN 'low' ELSE 'info' END AS level FROM s"),
    "score_signal_effectiveness": t.sql("fills markets", """,a AS (SELECT category, side, count(*)::DOUBLE AS n, count(*) FILTER (win)::DOUBLE AS h FROM fills JOIN markets USING (market) GROUP BY ALL), b AS (SELECT *, sum(n) OVER (PARTITION BY category) AS an, sum(h) OVER (PARTITION BY category) AS ah, h / n AS p FROM a),
        c AS (SELECT *, (h / n - (ah - h) / (an - n)) / sqrt(ah / an * (1 - ah / an) * (1 / n + 1 / (an - n))) AS z, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) AS half, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS mid FROM b)
        SELECT category, side, n::BIGINT AS n, round(p, 6) AS accuracy, round(p / (ah / an), 6) AS lift, round(greatest(mid - half, 0), 6) AS low, round(least(mid + half, 1), 6) AS high, coalesce(round(z, 5), 0) AS z, abs(coalesce(round(z, 5), 0)) >= 1.96 AS significant FROM c"""),
    "cal_scores": t.sql("fills", PREDICTED + " SELECT count(*) AS n, round(avg((p - y) ^ 2), 6) AS brier, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss, round(avg(y), 6) AS rate FROM q"),
    "cal_reliability": t.sql("fills", PREDICTED + " SELECT b AS bin, count(p) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM (SELECT unnest(range(10)) AS b) LEFT JOIN q ON least(floor(p * 10), 9) = b GROUP BY b"),
    "cal_auc": t.sql("fills", PREDICTED + " SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM q GROUP BY p))"),
    "cal_confusion": t.sql("fills", PREDICTED + ",c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM q) SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(5 * tp / (5 * tp + 4 * fn + fp), 6) AS f2, round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c"),
    "cal_thresholds": t.sql("fills", PREDICTED + " SELECT threshold, round(coalesce(2 * count(*) FILTER (p >= threshold AND y = 1) / (2 * count(*) FILTER (p >= threshold AND y = 1) + count(*) FILTER (p >= threshold AND y = 0) + count(*) FILTER (p < threshold AND y = 1)), 0), 6) AS f1 FROM q, (SELECT unnest(range(10, 95, 5)) / 100 AS threshold) GROUP BY threshold"),
    "cal_walk_forward": t.sql("fills", PREDICTED + " SELECT fold, count(*) AS n, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy FROM (SELECT *, floor((ts_ms - f - 365 * 86400000::BIGINT) / (180 * 86400000::BIGINT))::BIGINT AS fold FROM q, (SELECT min(ts_ms) AS f FROM q)) WHERE fold BETWEEN 0 AND 9 GROUP BY fold"),
    "book_stats": t.sql("fills", _LEVELS + f" SELECT book, max(price) FILTER (side = 'bid') AS bid, min(price) FILTER (side = 'ask') AS ask, round(coalesce(sum(size) FILTER (side = 'bid' AND i <= 5), 0), 3) AS bids, round(coalesce(sum(size) FILTER (side = 'ask' AND i <= 5), 0), 3) AS asks, round(min(price) FILTER (side = 'ask') - max(price) FILTER (side = 'bid'), 6) AS spread, round((min(price) FILTER (side = 'ask') + max(price) FILTER (side = 'bid')) / 2, 6) AS middle, round(coalesce(sum(size) FILTER (side = 'bid' AND i <= 5), 0) / nullif(coalesce(sum(size) FILTER (side = 'ask' AND i <= 5), 0), 0), 6) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY book, side ORDER BY {_BEST}) AS i FROM l) GROUP BY book"),
    "book_depth": t.sql("fills", _LEVELS + f",g AS (SELECT book, side, CASE WHEN side = 'bid' THEN floor(price / 100) ELSE ceil(price / 100) END * 100.0::DOUBLE AS price, sum(size) AS size, count(*) AS levels FROM l GROUP BY ALL) SELECT book, side, price, levels, row_number() OVER w AS place, round(sum(size) OVER w, 3) AS depth, round(sum(price * size) OVER w, 3) AS value FROM g WINDOW w AS (PARTITION BY book, side ORDER BY {_BEST})"),
    "book_fill_price": t.sql("fills", _LEVELS + " SELECT book, round(sum(k * price) / sum(k), 5) AS average, max(price) AS worst FROM (SELECT *, greatest(least(size, 100 - (sum(size) OVER (PARTITION BY book ORDER BY price) - size)), 0) AS k FROM l WHERE side = 'ask') WHERE k > 0 GROUP BY book HAVING sum(k) >= 100 - 1e-9"),
    "book_within": t.sql("fills", _LEVELS + " SELECT book, side, round(sum(size), 3) AS size FROM l JOIN (SELECT book, (min(price) FILTER (side = 'ask') + max(price) FILTER (side = 'bid')) / 2 AS m FROM l GROUP BY book) USING (book) WHERE abs(price - m) <= m * 0.05 GROUP BY book, side"),
    "det_market_impact": t.sql("fills", _LEVELS + ",x AS (SELECT f.market, round(CASE WHEN d > 0 THEN usd / d * 100 * 10 ELSE usd / 1e5 * 0.01 * 1e4 END, 4) AS bps FROM fills f LEFT JOIN (SELECT book, sum(price * size) AS d FROM l GROUP BY book) ON book = market WHERE usd >= 60000) SELECT market, CASE WHEN bps >= 500 THEN 'severe' WHEN bps >= 200 THEN 'high' WHEN bps >= 100 THEN 'medium' WHEN bps >= 50 THEN 'low' ELSE 'none' END AS severity, count(*) AS n, max(bps) AS most FROM x GROUP BY 1, 2"),
    "txt_topics": "WITH k(topic, word, weight) AS (VALUES " + ", ".join(f"('{a}', '{w}', {x}.0::DOUBLE)" for a, ws in TOPICS.items() for w, x in ws.items()) + "), d AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+')) AS word FROM documents), s AS (SELECT doc_id, topic, least(sum(weight), 100) AS score FROM d JOIN k USING (word) GROUP BY ALL) SELECT doc_id, topic, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic) AS i FROM s) WHERE i = 1 AND score >= 25",
    "txt_sentiment": "SELECT conv_id, sum(up)::BIGINT AS up, sum(down)::BIGINT AS down, round(1e-7 + coalesce((sum(up) - sum(down)) / nullif(sum(up) + sum(down), 0), 0), 6) AS score FROM (SELECT conv_id, len(list_filter(w, lambda x: x IN ('the', 'and', 'of'))) AS up, len(list_filter(w, lambda x: x IN ('to', 'in', 'a'))) AS down FROM (SELECT conv_id, regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+') AS w FROM conversations)) GROUP BY conv_id",
    "txt_keywords": t.sql("markets", "SELECT word, count(DISTINCT market) AS n FROM (SELECT market, unnest(regexp_split_to_array(lower(title), '[^a-z0-9]+')) AS word FROM markets) WHERE length(word) > 3 AND word NOT IN ('the', 'with', 'from', 'part') GROUP BY word"),
    "txt_parsed_properties": t.sql("trades", "SELECT market AS event_type, count(*) AS n, count(size) AS parsed, round(sum(size), 4) AS k FROM trades GROUP BY market"),
}
