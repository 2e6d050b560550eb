"""What wallets and markets are like: features, behaviour patterns, liquidity, funding, sybil pairs and alert rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import tables as t
from ..functions import stats
from ..operators import book, graph
from .detectors import signals
from .relations import CLUSTER

r = stats.rounded

#: Patterns as (name, least score of a strong match, requirements (feature, least, most, weight)).
PATTERNS = (
    ("scalper", 60, (("frequency", 5, None, 0.3), ("holding", None, 2, 0.35), ("sizes", 0.5, None, 0.15), ("reversals", 0.3, None, 0.2))),
    ("day_trader", 55, (("frequency", 1, 10, 0.25), ("holding", 2, 24, 0.35), ("on_hours", 0.5, None, 0.2), ("reversals", 0.2, None, 0.2))),
    ("swing_trader", 55, (("holding", 24, 336, 0.4), ("frequency", None, 2, 0.2), ("sizes", 0.4, None, 0.2), ("focus", None, 0.8, 0.2))),
    ("position_trader", 60, (("holding", 336, None, 0.4), ("frequency", None, 0.5, 0.2), ("size_rank", 0.6, None, 0.25), ("sizes", 0.3, None, 0.15))),
    ("market_maker", 65, (("makers", 0.6, None, 0.35), ("buys", 0.4, 0.6, 0.25), ("frequency", 3, None, 0.2), ("sizes", 0.6, None, 0.2))),
    ("arbitrageur", 65, (("timing", 0.7, None, 0.3), ("clustering", 0.5, None, 0.25), ("wins", 0.6, None, 0.25), ("sizes", 0.7, None, 0.2))),
    ("event_trader", 60, (("category", 0.6, None, 0.3), ("pre_event", 0.3, None, 0.3), ("focus", 0.5, None, 0.2), ("holding", None, 168, 0.2))),
    ("momentum_trader", 55, (("buys", 0.6, None, 0.3), ("clustering", 0.4, None, 0.25), ("reversals", None, 0.3, 0.25), ("wins", 0.45, None, 0.2))),
    ("contrarian", 55, (("buys", None, 0.4, 0.3), ("reversals", 0.4, None, 0.25), ("wins", 0.5, None, 0.25), ("focus", None, 0.7, 0.2))),
    ("potential_insider", 70, (("wins", 0.8, None, 0.35), ("pre_event", 0.4, None, 0.3), ("profit", 3, None, 0.2), ("category", 0.5, None, 0.15))),
    ("accumulator", 60, (("buys", 0.7, None, 0.35), ("sizes", 0.5, None, 0.25), ("focus", 0.6, None, 0.2), ("reversals", None, 0.2, 0.2))),
    ("whale", 65, (("size_rank", 0.9, None, 0.45), ("frequency", None, 5, 0.2), ("sizes", 0.3, None, 0.15), ("profit", 1, None, 0.2))),
    ("bot", 70, (("timing", 0.8, None, 0.35), ("sizes", 0.8, None, 0.3), ("frequency", 5, None, 0.2), ("on_hours", None, 0.3, 0.15))),
    ("retail", 45, (("frequency", None, 3, 0.2), ("sizes", None, 0.6, 0.2), ("wins", None, 0.6, 0.2), ("size_rank", None, 0.7, 0.2), ("focus", None, 0.7, 0.2))),
)
FEATURES = ("frequency", "holding", "sizes", "wins", "on_hours", "focus", "buys", "makers", "timing", "pre_event", "clustering", "category", "profit", "size_rank", "reversals")
LEAST_TRADES, LEAST_SECONDARY = 5, 40
_ORDER = ("ts_ms", "trade_id")


def _herfindahl(rows, key: str):
    """(wallet, hhi) of a wallet's trades over the values of a column, from 0 (even) to 1 (one value)."""
    share = rows.groupBy("wallet", key).agg(F.count("*").alias("n"))
    sums = share.groupBy("wallet").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("k"))
    even = 1 / F.col("k")
    hhi = F.when(F.col("k") <= 1, 1.0).otherwise((F.col("squares") / (F.col("n") * F.col("n")) - even) / (1 - even))
    return sums.select("wallet", hhi.alias(f"hhi_{key}"))


def _profile_rows(spark, sf):
    """Trades with what features need: profit by size, maker, category, hour, and whether the market's last day has begun."""
    e = t.trades(spark, sf)
    last = e.groupBy("market").agg(F.max("ts_ms").alias("last"))
    w = Window.partitionBy("wallet").orderBy(*_ORDER)
    rows = e.join(last, "market").withColumns({"pnl": F.col("usd") * (F.col("size") - 50) / 100, "maker": F.col("trade_id") % 3 == 0, "hour": F.floor(F.col("ts_ms") / t.HOUR) % 24, "late": F.col("ts_ms") > F.col("last") - t.DAY})
    rows = rows.withColumn("category", F.when(F.col("market").isin("purchase", "error"), "outcome").otherwise("activity"))
    return rows.withColumns({"hours": (F.col("ts_ms") - F.lag("ts_ms").over(w)) / t.HOUR, "turned": F.col("side") != F.lag("side").over(w)})


def class_features(spark, sf):
    """Twenty features of each wallet's trades, those of five trades or more."""
    rows = _profile_rows(spark, sf)
    count = lambda c: F.count_if(c) / F.count("*")
    a = rows.groupBy("wallet").agg(
        F.count("*").alias("n"),
        F.greatest((F.max("ts_ms") - F.min("ts_ms")) / t.DAY, F.lit(1.0)).alias("days"),
        F.avg("hours").alias("gap"),
        F.stddev_pop("hours").alias("gap_spread"),
        F.avg("usd").alias("mean_size"),
        F.max("usd").alias("largest"),
        F.stddev_pop("usd").alias("size_spread"),
        F.sum("usd").alias("volume"),
        F.countDistinct("market").alias("markets"),
        count(F.col("pnl") > 0).alias("wins"),
        count(F.col("hour").between(14, 21)).alias("on_hours"),
        count(F.col("side") == "BUY").alias("buys"),
        count(F.col("maker")).alias("makers"),
        count(F.col("late")).alias("pre_event"),
        F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)).alias("gained"),
        F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0)).alias("lost"),
        F.percentile("usd", 0.5).alias("median"),
        F.count_if(F.col("turned")).alias("turns"),
    ).filter(F.col("n") >= LEAST_TRADES)
    for key in ("market", "category", "hour"):
        a = a.join(_herfindahl(rows, key), "wallet")
    holding = 2 * F.col("gap")
    values = {
        "frequency": F.col("n") / F.col("days"), "holding": holding, "sizes": F.when(F.col("mean_size") > 0, 1 - F.least(F.try_divide("size_spread", "mean_size"), F.lit(1.0))).otherwise(0.0), "wins": F.col("wins"), "on_hours": F.col("on_hours"),
        "focus": F.col("hhi_market"), "buys": F.col("buys"), "makers": F.col("makers"), "timing": F.col("hhi_hour"), "pre_event": F.col("pre_event"),
        "clustering": 1 - F.least(F.col("gap_spread") / F.when(holding > 0, holding).otherwise(1.0), F.lit(1.0)), "category": F.col("hhi_category"),
        "profit": F.when(F.col("lost") > 0, F.try_divide("gained", "lost")).when(F.col("gained") > 0, 10.0).otherwise(0.0), "size_rank": F.least(F.col("median") / 5000, F.lit(1.0)), "reversals": F.col("turns") / (F.col("n") - 1),
        "mean_size": F.col("mean_size"), "largest": F.col("largest"), "volume": F.col("volume"), "days": F.col("days"),
    }
    return a.select("wallet", "n", "markets", *[r(v, 5).alias(k) for k, v in values.items()])


def fits(value: Column, least: float | None, most: float | None) -> Column:
    """From 0 to 1, how well a value keeps to a range: best in its middle, or the further beyond a single bound."""
    if least is not None and most is not None:
        half = (most - least) / 2
        return F.when((value < least) | (value > most), 0.0).otherwise(1 - F.abs(value - (least + half)) / half * 0.5)
    if least is not None:
        return F.when(value < least, F.greatest(value / least, F.lit(0.0))).otherwise(F.least(0.5 + (value - least) / (least * 2) * 0.5, F.lit(1.0)))
    return F.when(value > most, F.greatest(1 - (value - most) / most, F.lit(0.0))).otherwise(F.least(0.5 + (most - value) / most * 0.5, F.lit(1.0)))


def class_patterns(spark, sf):
    """The behaviour pattern that fits a wallet best, if well enough, and up to three others that come next."""
    found = []
    for i, (name, strong, needs) in enumerate(PATTERNS):
        score = sum((fits(F.col(f), a, b) * w for f, a, b, w in needs), F.lit(0.0)) / sum(w for *_, w in needs)
        found.append(F.struct((-F.floor(score * 100 + 0.5 + 1e-7)).cast("long").alias("minus"), F.lit(i).alias("i"), F.lit(name).alias("name"), F.lit(strong).alias("strong")))
    best = class_features(spark, sf).select("wallet", "n", F.array_sort(F.array(*found)).alias("p"))
    first = F.col("p")[0]
    others = F.filter(F.slice("p", 2, 3), lambda x: -x["minus"] >= LEAST_SECONDARY)
    confidence = stats.ladder(F.col("n"), [(100, "very_high"), (50, "high"), (20, "medium"), (10, "low")], "very_low")
    return best.select("wallet", F.when(-first["minus"] >= first["strong"], first["name"]).otherwise("unknown").alias("pattern"), (-first["minus"]).alias("score"), F.array_join(F.transform(others, lambda x: x["name"]), ",").alias("secondary"), confidence.alias("confidence"))


#: Alert rules: id, priority, scores between, least data quality and signals, signals needed, action, reduction.
RULES = (
    ("sparse", 1, 0, 60, 0, 0, (), "suppress", 0),
    ("isolated", 2, 30, 70, 0, 1, ("size",), "reduce", 10),
    ("volume", 2, 40, 100, 60, 3, ("size", "activity"), "reduce", 15),
    ("maker", 3, 20, 80, 80, 4, ("lean",), "mark", 0),
    ("established", 3, 50, 100, 80, 5, ("activity",), "defer", 0),
)
RULE_COLUMNS = "id string, priority int, least int, most int, quality int, signals int, needed array<string>, action string, reduction int"
#: Confidence from these bounds up, with what it is worth; an action needs the third.
CONFIDENCE = ((90, "very_high", 95), (80, "high", 80), (60, "medium", 60), (40, "low", 40), (float("-inf"), "very_low", 20))
SUPPRESS_BELOW, SUPPRESS_MATCHES, DEFAULT_REDUCTION = 60, 2, 15


def rule_actions(spark, sf):
    """What alert rules do with each wallet's composite score: suppress, defer, mark, reduce or pass.

    Rules are rows that are joined once by a broadcast (a handful); of the rules that match, the one with the best match
    score decides, the sum of reductions is taken off the score, and a low rest with several matches is suppressed.
    """
    s = signals(spark, sf).groupBy("wallet").agg(F.count("value").alias("available"), F.count("*").alias("total"), F.avg("value").alias("score"), F.collect_set(F.when(F.col("value").isNotNull(), F.col("signal"))).alias("has"))
    s = s.filter("available > 0").select("*", (F.col("available") / F.col("total") * 100).alias("data_quality")).withColumn("score", r("score", 4))
    rules = spark.createDataFrame([(*x[:6], list(x[6]), *x[7:]) for x in RULES], RULE_COLUMNS)
    fits_rule = F.col("score").between(F.col("least"), F.col("most")) & (F.col("data_quality") >= F.col("quality")) & (F.col("available") >= F.col("signals")) & (F.size(F.array_except("needed", "has")) == 0)
    m = s.join(F.broadcast(rules), fits_rule, "left")
    middle, half = (F.col("least") + F.col("most")) / 2, (F.col("most") - F.col("least")) / 2
    sure = F.col("data_quality") * F.col("available") / F.col("total") * (1 - F.abs(F.col("score") - middle) / half * 0.3)
    level = stats.ladder(r(sure, 6), [(b, n) for b, n, _ in CONFIDENCE[:-1]], CONFIDENCE[-1][1])
    worth = stats.ladder(r(sure, 6), [(b, v) for b, _, v in CONFIDENCE[:-1]], CONFIDENCE[-1][2])
    match = stats.clamp(r(worth + (3 - F.col("priority")) * 10 + F.least("reduction", F.lit(20)) + F.col("data_quality") * 0.2, 6), 0, 100)
    m = m.withColumns({"confidence": level, "match": match})
    top = F.max_by(F.struct("id", "action", "confidence"), F.struct("match", -F.col("priority"), "id"))
    a = m.groupBy("wallet", "score").agg(F.count("id").alias("matches"), F.sum(F.when(F.col("action") == "reduce", F.when(F.col("reduction") > 0, F.col("reduction")).otherwise(DEFAULT_REDUCTION)).otherwise(0)).alias("off"), top.alias("top"))
    acts = (F.col("matches") > 0) & ~F.col("top.confidence").isin("low", "very_low")
    adjusted = F.when(acts, F.greatest(F.col("score") - F.col("off"), F.lit(0.0))).otherwise(F.col("score"))
    suppressed = (F.col("top.action") == "suppress") | ((adjusted <= SUPPRESS_BELOW) & (F.col("matches") >= SUPPRESS_MATCHES))
    action = F.when(~acts, "pass").when(suppressed, "suppress").otherwise(F.col("top.action"))
    return a.select("wallet", "score", "matches", F.when(acts, F.col("top.id")).alias("rule"), r(adjusted, 4).alias("adjusted"), action.alias("action"))


def _sided(fills):
    """fills(market, price, size, ...) with m and side: below the market's median price they bid, above it they ask, else null."""
    rows = book.with_median(fills, "market", "price")
    return rows.withColumn("side", F.when(F.col("price") < F.col("m"), "bid").when(F.col("price") > F.col("m"), "ask"))


def _levels(sided, *carried):
    """(market, side, price, size) of sides to whole prices, and what is the same in all rows of a market."""
    return sided.groupBy("market", "side", F.floor("price").cast("double").alias("price")).agg(F.sum("size").alias("size"), *[F.max(c).alias(c) for c in carried])


def _of(side, c):
    return F.when(F.col("side") == side, c)


def _sides(spark, sf):
    """(market, side, price, size) of books from fills, with the middle and the worth of the whole book."""
    rows = _levels(_sided(t.by_market(spark, sf, "price", "size")).filter("side is not null"))
    w, usd = Window.partitionBy("market"), F.col("price") * F.col("size")
    worth = lambda side: F.coalesce(F.sum(_of(side, usd)).over(w), F.lit(0.0))
    middle = (F.max(_of("bid", F.col("price"))).over(w) + F.min(_of("ask", F.col("price"))).over(w)) / 2
    return rows.withColumns({"middle": middle, "total": worth("bid") + worth("ask")})


def _books_and_trading(spark, sf, now):
    """A row a market: its book, trading of the last year before now and its last fill. Fills travel once, by market."""
    f = _sided(t.by_market(spark, sf, "price", "size", "usd", "ts_ms"))
    w, recent = Window.partitionBy("market"), F.col("ts_ms") > F.lit(now) - 365 * t.DAY
    usd = F.when(recent, F.col("usd"))
    trading = {"usd": F.sum(usd), "n": F.count_if(recent), "mean": F.avg(usd), "dev": F.stddev_pop(usd), "last": F.max("ts_ms")}
    f = f.select("market", "side", "price", "size", *[c.over(w).alias(k) for k, c in trading.items()])
    worth = lambda side: F.coalesce(F.sum(_of(side, F.col("price") * F.col("size"))), F.lit(0.0))
    best = F.max(_of("bid", F.col("price"))).alias("bid"), F.min(_of("ask", F.col("price"))).alias("ask")
    a = _levels(f, *trading).groupBy("market").agg(worth("bid").alias("bids"), worth("ask").alias("asks"), F.count("side").alias("levels"), *best, *[F.max(c).alias(c) for c in trading])
    return a.withColumn("spread", (F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2) * 100).checkpoint()


def score_liquidity(spark, sf):
    """Liquidity of each market from 0 to 100: depth .35, trading of the last year .30, spread .20, participation .15.

    The year ends with the last line item; only if that is no fill are the books made again, with the last fill's.
    """
    graph.shared_checkpoints(spark)
    now = t.line_ends(spark, sf)[1] or 0
    j = _books_and_trading(spark, sf, now)
    last = j.agg(F.max("last")).first()[0]
    if last is not None and last != now:
        j = _books_and_trading(spark, sf, last)
    j = j.filter("levels > 0")
    cut = lambda c: stats.clamp(c, 0.0, 100.0)
    total, levels, n = F.col("bids") + F.col("asks"), F.col("levels"), F.coalesce("n", F.lit(0))
    by_level = F.least(F.when(levels > 10, 50 + (levels - 10) * 2.5).otherwise(levels * 5.0), F.lit(100.0))
    depth = 0.5 * cut(F.log10(total) * 20 - 10) + 0.3 * by_level + 0.2 * cut(100 - F.abs(F.col("bids") / total - 0.5) * 200)
    trading = F.when(n > 0, 0.5 * cut(F.log10("usd") * 25 - 25) + 0.35 * F.least(F.log10(n + 1) * 50, F.lit(100.0)) + 0.15 * F.greatest(100 - F.col("dev") / F.col("mean") * 50, F.lit(0.0))).otherwise(0.0)
    s = F.col("spread")
    spread = F.when(s.isNull(), 50.0).when(s <= 0, 100.0).when(s <= 1, 100 - s * 20).when(s <= 5, 80 - (s - 1) * 7.5).when(s <= 10, 50 - (s - 5) * 6).when(s <= 20, 20 - (s - 10) * 2).otherwise(0.0)
    size = F.when(F.col("mean") < 10, F.col("mean") * 10).when(F.col("mean") <= 1000, 100.0).otherwise(F.greatest(100 - (F.col("mean") - 1000) / 100, F.lit(0.0)))
    by_levels = F.least(levels * 3.0, F.lit(100.0))
    participation = F.when(n > 0, (by_levels + F.least(n * 0.5, F.lit(100.0)) + size) / 3).otherwise(by_levels)
    score = r(0.35 * depth + 0.30 * trading + 0.20 * spread + 0.15 * participation, 3)
    out = j.select("market", r(depth, 3).alias("depth"), r(trading, 3).alias("trading"), r(spread, 3).alias("spread"), r(participation, 3).alias("participation"), score.alias("score"))
    category = stats.ladder(F.col("score"), [(90, "very_deep"), (75, "deep"), (60, "above_average"), (45, "average"), (30, "below_average"), (15, "thin")], "extremely_thin")
    severity = F.when(F.col("score") <= 10, "critical").when(F.col("score") <= 20, "high").when(F.col("score") <= 30, "medium").when(F.col("score") <= 35, "low").when(F.col("score") <= 45, "info")
    return out.select("*", category.alias("category"), severity.alias("severity"))


def det_relevant_liquidity(spark, sf):
    """What a trade of either direction meets: the whole book, the other side within 2 %, and depths of 1, 2 and 5 % by .5, .3, .2."""
    j = _sides(spark, sf).filter("middle is not null")
    away, usd = F.abs(F.col("price") - F.col("middle")) / F.col("middle"), F.col("price") * F.col("size")
    within = {p: F.sum(F.when(away <= p / 100, usd).otherwise(0.0)).alias(f"d{p}") for p in (1, 2, 5)}
    a = j.groupBy("market", "side", "total").agg(F.sum(usd).alias("usd"), *within.values())
    near = F.when(F.col("d2") > 0, F.col("d2")).otherwise(F.col("usd"))
    direction = F.when(F.col("side") == "ask", "BUY").otherwise("SELL")
    return a.select("market", direction.alias("direction"), r("total", 2).alias("total"), r("usd", 2).alias("side_usd"), r(near, 2).alias("in_range"), r(0.5 * F.col("d1") + 0.3 * F.col("d2") + 0.2 * F.col("d5"), 2).alias("weighted"))


#: Price impact in percent that makes a tier, and the share of all liquidity where there is no depth.
IMPACTS = {"notable": (0.1, 0.001), "large": (0.5, 0.005), "very_large": (1.0, 0.01), "whale": (2.0, 0.02), "mega_whale": (5.0, 0.05)}


def det_impact_thresholds(spark, sf):
    """Trade sizes that move a market by 0.1 to 5 percent, between its depths at 1 and 5 percent; shares of all without them."""
    j = _sides(spark, sf).filter("middle is not null")
    away, usd = F.abs(F.col("price") - F.col("middle")) / F.col("middle"), F.col("price") * F.col("size")
    side = lambda s, p: F.sum(F.when((F.col("side") == s) & (away <= p / 100), usd).otherwise(0.0))
    a = j.groupBy("market", "total").agg(F.least(side("bid", 1), side("ask", 1)).alias("v1"), F.least(side("bid", 5), side("ask", 5)).alias("v5"))
    v1, v5 = F.col("v1"), F.col("v5")
    at = lambda x: v1 * x if x <= 1 else v5 if x >= 5 else v1 + (v5 - v1) * (x - 1) / 4
    return a.select("market", *[r(F.when((v1 == 0) & (v5 == 0), F.col("total") * share).otherwise(at(x)), 3).alias(name) for name, (x, share) in IMPACTS.items()])


#: Large fills are deposits of their counterparty; days that make funding flash, very fast or fast; what each adds.
DEPOSIT_USD, LARGE_USD, QUICK_DAYS = 60_000, 90_000, 30


def score_funding_suspicion(spark, sf):
    """Suspicion of how a wallet was funded before it first traded: timing, listed sources, a large and several quick deposits."""
    f = t.fills(spark, sf).select("wallet", "ts_ms", "order_id", "line", "market", "usd", F.col("counterparty").alias("source"))
    first = f.filter(F.col("usd") < DEPOSIT_USD).groupBy("wallet").agg(F.min("ts_ms").alias("first"))
    d = f.filter(F.col("usd") >= DEPOSIT_USD).join(first, "wallet").filter("ts_ms <= first")
    w = Window.partitionBy("wallet").orderBy("ts_ms", "order_id", "line", "market", "source", "usd")
    d = d.withColumn("quick", F.col("ts_ms") - F.lag("ts_ms").over(w) < QUICK_DAYS * t.DAY)
    a = d.groupBy("wallet", "first").agg(F.count("*").alias("deposits"), F.max("ts_ms").alias("last"), F.max("usd").alias("most"), F.count_if("quick").alias("quick"), F.max((F.col("source") % 97 == 0).cast("int")).alias("sanctioned"), F.max((F.col("source") % 13 == 0).cast("int")).alias("mixer"), F.avg((F.col("source") % 2).cast("double")).alias("unknown"))
    days = (F.col("first") - F.col("last")) / t.DAY
    timing = F.when(days < 1, "flash").when(days < 7, "very_fast").when(days < 30, "fast").when(days < 90, "moderate").otherwise("slow")
    points = F.when(days < 1, 40).when(days < 7, 25).when(days < 30, 10).otherwise(0) + 50 * F.col("sanctioned") + 30 * F.col("mixer")
    points += F.when(F.col("most") >= LARGE_USD, 15).otherwise(0) + F.when(F.col("quick") >= 2, 20).otherwise(0) + F.when(F.col("unknown") >= 0.8, 15).otherwise(0)
    return a.select("wallet", "deposits", timing.alias("timing"), F.least(points, F.lit(100)).alias("score"))


def alike(a: Column, b: Column, most: float) -> Column:
    """1 for equal values, falling to 0 where they differ by this share of their mean; 0 if only one of them is 0."""
    apart = F.try_divide(F.abs(a - b), (a + b) / 2)
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(F.greatest(1 - apart / most, F.lit(0.0)))


#: Days between first trades beyond which two wallets weren't made together.
CREATED_DAYS = 30


def _sybil_pairs(spark, sf):
    graph.shared_checkpoints(spark)
    p = graph.shared_pairs(t.fills(spark, sf).select("wallet", "market"), "wallet", "market", 4).checkpoint()
    f = t.fills(spark, sf, p.select(F.explode(F.array("a", "b")).alias("wallet")).distinct())
    days = F.array(*[F.count_if(F.floor(F.col("ts_ms") / t.DAY) % 7 == k) for k in range(7)])
    w = f.groupBy("wallet").agg(
        F.count("*").alias("n"), F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"), F.avg("usd").alias("size"), F.avg("price").alias("price"), F.avg(F.col("win").cast("double")).alias("wins"),
        F.countDistinct("market").alias("markets"), days.alias("days"), F.collect_set(F.when(F.col("usd") >= DEPOSIT_USD, F.col("counterparty"))).alias("sources"),
    )
    side = lambda x: w.select(*[F.col(c).alias(x if c == "wallet" else f"{c}_{x}") for c in w.columns])
    j = p.join(side("a"), "a").join(side("b"), "b")
    both = lambda c, most: alike(F.col(f"{c}_a"), F.col(f"{c}_b"), most)
    funders = F.coalesce(F.try_divide(F.size(F.array_intersect("sources_a", "sources_b")), F.least(F.size("sources_a"), F.size("sources_b"))), F.lit(0.0))
    created = F.greatest(1 - F.abs(F.col("first_a") - F.col("first_b")) / (CREATED_DAYS * t.DAY), F.lit(0.0))
    overlap = F.col("shared") / (F.col("markets_a") + F.col("markets_b") - F.col("shared"))
    j = j.withColumns({"funders": r(funders, 6), "created": r(created, 6), "overlap": r(overlap, 6), "sizing": r(both("size", 0.3), 6), "prices": r(both("price", 0.2), 6), "timing": r(stats.cosine(F.col("days_a"), F.col("days_b")), 6), "winning": r(both("wins", 0.2), 6)})
    j = j.withColumns({"behaviour": (F.col("timing") + F.col("overlap") + F.col("sizing") + F.col("winning")) / 4, "trading": (F.col("overlap") + F.col("sizing")) / 2})
    raised = {"same_funder": F.col("funders") >= 0.8, "created_together": F.col("created") >= 0.8, "same_markets": F.col("overlap") >= 0.6, "same_sizes": F.col("sizing") >= 0.8, "same_prices": F.col("prices") >= 0.8, "same_hours": F.col("timing") >= 0.7, "active_together": F.abs(F.col("last_a") - F.col("last_b")) < t.HOUR, "both_fresh": (F.col("n_a") <= 30) & (F.col("n_b") <= 30)}
    flags = sum((c.cast("int") for c in raised.values()), F.lit(0))
    mean = 0.25 * F.col("funders") + 0.15 * F.col("created") + 0.2 * F.col("behaviour") + 0.15 * F.col("trading") + 0.1 * F.col("prices") + 0.15 * F.col("timing")
    score = F.least(F.floor(mean * 100 + 0.5 + 1e-7) + F.least(flags * 5, F.lit(20)), F.lit(100)).cast("long")
    return j.select("a", "b", "funders", "created", r("behaviour", 5).alias("behaviour"), r("trading", 5).alias("trading"), "prices", "timing", "overlap", "sizing", flags.alias("flags"), score.alias("score")).withColumn("likely", F.col("score") >= 60)


def pair_sybil_similarity(spark, sf):
    """Pairs of wallets that share four markets or more, by eight similarities and the flags that they raise."""
    return _sybil_pairs(spark, sf)


def pair_sybil_clusters(spark, sf):
    """Transitive clusters of likely sybil pairs: size and smallest member."""
    likely = _sybil_pairs(spark, sf).filter("likely").select("a", "b").checkpoint()  # components read them several times
    return graph.components(likely).groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n").between(*CLUSTER))


QUERIES = {f.__name__: f for f in (class_features, class_patterns, rule_actions, score_liquidity, det_relevant_liquidity, det_impact_thresholds, score_funding_suspicion, pair_sybil_similarity, pair_sybil_clusters)}


def _fits_sql(v: str, least: float | None, most: float | None) -> str:
    if least is not None and most is not None:
        half = (most - least) / 2
        return f"CASE WHEN {v} < {least} OR {v} > {most} THEN 0 ELSE 1 - abs({v} - {least + half}) / {half} * 0.5 END"
    if least is not None:
        return f"CASE WHEN {v} < {least} THEN greatest({v} / {least}, 0) ELSE least(0.5 + ({v} - {least}) / {least * 2} * 0.5, 1) END"
    return f"CASE WHEN {v} > {most} THEN greatest(1 - ({v} - {most}) / {most}, 0) ELSE least(0.5 + ({most} - {v}) / {most} * 0.5, 1) END"


_HHI = "CASE WHEN count(*) <= 1 THEN 1 ELSE (sum(n * n) / pow(sum(n), 2) - 1.0 / count(*)) / (1 - 1.0 / count(*)) END"
_FEATURES = f""",p AS (SELECT *, usd * (size - 50) / 100 AS pnl, trade_id % 3 = 0 AS maker, ts_ms // 3600000 % 24 AS hour, ts_ms > max(ts_ms) OVER (PARTITION BY market) - 86400000 AS late,
    CASE WHEN market IN ('purchase', 'error') THEN 'outcome' ELSE 'activity' END AS category, (ts_ms - lag(ts_ms) OVER o) / 3600000.0 AS hours, side != lag(side) OVER o AS turned FROM trades WINDOW o AS (PARTITION BY wallet ORDER BY ts_ms, trade_id)),
a AS (SELECT wallet, count(*) AS n, count(DISTINCT market) AS markets, greatest((max(ts_ms) - min(ts_ms)) / 86400000.0, 1) AS days, avg(hours) AS gap, stddev_pop(hours) AS gap_spread, avg(usd) AS mean_size, max(usd) AS largest,
    stddev_pop(usd) AS size_spread, sum(usd) AS volume, count(*) FILTER (pnl > 0) / count(*) AS wins, count(*) FILTER (hour BETWEEN 14 AND 21) / count(*) AS on_hours, count(*) FILTER (side = 'BUY') / count(*) AS buys,
    count(*) FILTER (maker) / count(*) AS makers, count(*) FILTER (late) / count(*) AS pre_event, sum(greatest(pnl, 0)) AS gained, -sum(least(pnl, 0)) AS lost, median(usd) AS middle, count(*) FILTER (turned) AS turns FROM p GROUP BY wallet HAVING count(*) >= {LEAST_TRADES}),
hm AS (SELECT wallet, {_HHI} AS h FROM (SELECT wallet, count(*) AS n FROM p GROUP BY wallet, market) GROUP BY wallet),
hc AS (SELECT wallet, {_HHI} AS h FROM (SELECT wallet, count(*) AS n FROM p GROUP BY wallet, category) GROUP BY wallet),
hh AS (SELECT wallet, {_HHI} AS h FROM (SELECT wallet, count(*) AS n FROM p GROUP BY wallet, hour) GROUP BY wallet),
features AS (SELECT a.wallet, n, markets, round(n / days, 5) AS frequency, round(2 * gap, 5) AS holding, round(CASE WHEN mean_size > 0 THEN 1 - least(size_spread / mean_size, 1) ELSE 0 END, 5) AS sizes, round(wins, 5) AS wins, round(on_hours, 5) AS on_hours,
    round(hm.h, 5) AS focus, round(buys, 5) AS buys, round(makers, 5) AS makers, round(hh.h, 5) AS timing, round(pre_event, 5) AS pre_event, round(1 - least(gap_spread / CASE WHEN gap > 0 THEN 2 * gap ELSE 1 END, 1), 5) AS clustering,
    round(hc.h, 5) AS category, round(CASE WHEN lost > 0 THEN gained / lost WHEN gained > 0 THEN 10 ELSE 0 END, 5) AS profit, round(least(middle / 5000, 1), 5) AS size_rank, round(turns / (n - 1), 5) AS reversals,
    round(mean_size, 5) AS mean_size, round(largest, 5) AS largest, round(volume, 5) AS volume, round(days, 5) AS days FROM a JOIN hm ON hm.wallet = a.wallet JOIN hc ON hc.wallet = a.wallet JOIN hh ON hh.wallet = a.wallet)"""
_SCORES = " UNION ALL ".join(
    f"SELECT wallet, n, {i} AS i, '{name}' AS name, {strong} AS strong, floor((" + " + ".join(f"({_fits_sql(f, a, b)}) * {w}" for f, a, b, w in needs) + f") / {sum(w for *_, w in needs)} * 100 + 0.5 + 1e-7)::BIGINT AS score FROM features"
    for i, (name, strong, needs) in enumerate(PATTERNS)
)
_SIGNALS = """,b AS (SELECT wallet, count(*) AS n, avg(win::INT) AS wins, max(usd) AS most, count(DISTINCT market) AS m, avg((side = 'BUY')::INT) AS buys FROM fills GROUP BY wallet),
g AS (SELECT wallet, 'win_rate' AS signal, round(wins * 100, 6) AS value FROM b UNION ALL SELECT wallet, 'size', round(least(most / 1000, 100), 6) FROM b UNION ALL SELECT wallet, 'focus', round(100 - least(m / n * 50, 100), 6) FROM b
    UNION ALL SELECT wallet, 'lean', round(abs(buys - 0.5) * 200, 6) FROM b UNION ALL SELECT wallet, 'activity', CASE WHEN n >= 5 THEN round(least(n / 5, 100), 6) END FROM b)"""
_RULES = ", ".join(f"('{i}', {p}, {a}, {b}, {q}, {s}, [{', '.join(repr(x) for x in need)}]::VARCHAR[], '{act}', {off})" for i, p, a, b, q, s, need, act, off in RULES)
_SIDES = """,md AS (SELECT market, median(price) AS m FROM fills GROUP BY market),
l AS (SELECT f.market, CASE WHEN price < m THEN 'bid' ELSE 'ask' END AS side, floor(price)::DOUBLE AS price, sum(size) AS size FROM fills f JOIN md ON md.market = f.market WHERE price != m GROUP BY ALL),
bk AS (SELECT market, coalesce(sum(price * size) FILTER (side = 'bid'), 0) AS bids, coalesce(sum(price * size) FILTER (side = 'ask'), 0) AS asks, count(*) AS levels, max(price) FILTER (side = 'bid') AS bid, min(price) FILTER (side = 'ask') AS ask FROM l GROUP BY market)"""
_NEAR = ",nr AS (SELECT l.market, side, bids + asks AS total, price * size AS usd, abs(price - (bid + ask) / 2) / ((bid + ask) / 2) AS away FROM l JOIN bk ON bk.market = l.market WHERE bid + ask IS NOT NULL)"
_ALIKE = lambda c, most: f"round(CASE WHEN x.{c} = 0 AND y.{c} = 0 THEN 1 WHEN x.{c} = 0 OR y.{c} = 0 THEN 0 ELSE greatest(1 - abs(x.{c} - y.{c}) / ((x.{c} + y.{c}) / 2) / {most}, 0) END, 6)"
_SYBIL = f"""wm AS (SELECT DISTINCT wallet, market FROM fills), sp AS (SELECT x.wallet AS a, y.wallet AS b, count(*) AS shared FROM wm x JOIN wm y ON x.market = y.market AND x.wallet < y.wallet GROUP BY ALL HAVING count(*) >= 4),
w AS (SELECT wallet, count(*) AS n, min(ts_ms) AS first, max(ts_ms) AS last, avg(usd) AS size, avg(price) AS price, avg(win::INT) AS wins, count(DISTINCT market) AS markets, coalesce(list(DISTINCT counterparty) FILTER (usd >= {DEPOSIT_USD}), []) AS sources,
    [{", ".join(f"count(*) FILTER (ts_ms // 86400000 % 7 = {k})" for k in range(7))}]::DOUBLE[] AS days FROM fills GROUP BY wallet),
s1 AS (SELECT a, b, round(CASE WHEN len(x.sources) > 0 AND len(y.sources) > 0 THEN len(list_intersect(x.sources, y.sources)) / least(len(x.sources), len(y.sources)) ELSE 0 END, 6) AS funders,
    round(greatest(1 - abs(x.first - y.first) / {CREATED_DAYS * t.DAY}, 0), 6) AS created, round(shared / (x.markets + y.markets - shared), 6) AS overlap, {_ALIKE("size", 0.3)} AS sizing, {_ALIKE("price", 0.2)} AS prices,
    round(list_cosine_similarity(x.days, y.days), 6) AS timing, {_ALIKE("wins", 0.2)} AS winning, abs(x.last - y.last) < 3600000 AS together, x.n <= 30 AND y.n <= 30 AS fresh FROM sp JOIN w x ON x.wallet = a JOIN w y ON y.wallet = b),
s2 AS (SELECT *, (timing + overlap + sizing + winning) / 4 AS behaviour, (overlap + sizing) / 2 AS trading, (funders >= 0.8)::INT + (created >= 0.8)::INT + (overlap >= 0.6)::INT + (sizing >= 0.8)::INT + (prices >= 0.8)::INT + (timing >= 0.7)::INT + together::INT + fresh::INT AS flags FROM s1),
sy AS (SELECT a, b, funders, created, round(behaviour, 5) AS behaviour, round(trading, 5) AS trading, prices, timing, overlap, sizing, flags,
    least(floor((0.25 * funders + 0.15 * created + 0.2 * behaviour + 0.15 * trading + 0.1 * prices + 0.15 * timing) * 100 + 0.5 + 1e-7) + least(flags * 5, 20), 100)::BIGINT AS score FROM s2)"""

ORACLE_SQL = {
    "class_features": t.sql("trades", _FEATURES + " SELECT * FROM features"),
    "class_patterns": t.sql(
        "trades",
        _FEATURES
        + f""",s AS ({_SCORES}), k AS (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY score DESC, i) AS nth FROM s)
        SELECT wallet, max(CASE WHEN nth = 1 THEN CASE WHEN score >= strong THEN name ELSE 'unknown' END END) AS pattern, max(score) FILTER (nth = 1) AS score,
            coalesce(string_agg(name, ',' ORDER BY nth) FILTER (nth BETWEEN 2 AND 4 AND score >= {LEAST_SECONDARY}), '') AS secondary,
            CASE WHEN max(n) >= 100 THEN 'very_high' WHEN max(n) >= 50 THEN 'high' WHEN max(n) >= 20 THEN 'medium' WHEN max(n) >= 10 THEN 'low' ELSE 'very_low' END AS confidence FROM k GROUP BY wallet""",
    ),
    "rule_actions": t.sql(
        "fills",
        _SIGNALS
        + f""",s AS (SELECT wallet, count(value) AS available, count(*) AS total, round(avg(value), 4) AS score, list(signal) FILTER (value IS NOT NULL) AS has, count(value) / count(*) * 100 AS q FROM g GROUP BY wallet HAVING count(value) > 0),
        r(id, priority, lo, hi, quality, signals, needed, action, off) AS (VALUES {_RULES}),
        m AS (SELECT s.*, r.*, round(q * available / total * (1 - abs(score - (lo + hi) / 2) / ((hi - lo) / 2) * 0.3), 6) AS sure FROM s LEFT JOIN r ON score BETWEEN lo AND hi AND q >= quality AND available >= signals AND list_has_all(has, needed)),
        c AS (SELECT *, least(greatest(round(CASE WHEN sure >= 90 THEN 95 WHEN sure >= 80 THEN 80 WHEN sure >= 60 THEN 60 WHEN sure >= 40 THEN 40 ELSE 20 END + (3 - priority) * 10 + least(off, 20) + q * 0.2, 6), 0), 100) AS match FROM m),
        o AS (SELECT wallet, score, count(id) AS matches, sum(CASE WHEN action = 'reduce' THEN CASE WHEN off > 0 THEN off ELSE {DEFAULT_REDUCTION} END ELSE 0 END) AS off, arg_max(id, (match, -priority, id)) AS id, arg_max(action, (match, -priority, id)) AS action, arg_max(sure, (match, -priority, id)) AS sure FROM c GROUP BY wallet, score),
        p AS (SELECT *, matches > 0 AND sure >= 60 AS acts, CASE WHEN matches > 0 AND sure >= 60 THEN greatest(score - off, 0) ELSE score END AS adjusted FROM o)
        SELECT wallet, score, matches, CASE WHEN acts THEN id END AS rule, round(adjusted, 4) AS adjusted, CASE WHEN NOT acts THEN 'pass' WHEN action = 'suppress' OR (adjusted <= {SUPPRESS_BELOW} AND matches >= {SUPPRESS_MATCHES}) THEN 'suppress' ELSE action END AS action FROM p""",
    ),
    "score_liquidity": t.sql(
        "fills",
        _SIDES
        + """,v AS (SELECT market, sum(usd) AS usd, count(*) AS n, avg(usd) AS mean, stddev_pop(usd) AS dev FROM fills WHERE ts_ms > (SELECT max(ts_ms) FROM fills) - 31536000000 GROUP BY market),
        j AS (SELECT bk.market, bids, asks, bids + asks AS total, levels, (ask - bid) / ((ask + bid) / 2) * 100 AS sp, usd, coalesce(n, 0) AS n, mean, dev FROM bk LEFT JOIN v ON v.market = bk.market),
        x AS (SELECT market, 0.5 * least(greatest(log10(total) * 20 - 10, 0), 100) + 0.3 * least(CASE WHEN levels > 10 THEN 50 + (levels - 10) * 2.5 ELSE levels * 5.0 END, 100) + 0.2 * least(greatest(100 - abs(bids / total - 0.5) * 200, 0), 100) AS depth,
            CASE WHEN n > 0 THEN 0.5 * least(greatest(log10(usd) * 25 - 25, 0), 100) + 0.35 * least(log10(n + 1) * 50, 100) + 0.15 * greatest(100 - dev / mean * 50, 0) ELSE 0 END AS trading,
            CASE WHEN sp IS NULL THEN 50 WHEN sp <= 0 THEN 100 WHEN sp <= 1 THEN 100 - sp * 20 WHEN sp <= 5 THEN 80 - (sp - 1) * 7.5 WHEN sp <= 10 THEN 50 - (sp - 5) * 6 WHEN sp <= 20 THEN 20 - (sp - 10) * 2 ELSE 0 END AS spread,
            CASE WHEN n > 0 THEN (least(levels * 3.0, 100) + least(n * 0.5, 100) + CASE WHEN mean < 10 THEN mean * 10 WHEN mean <= 1000 THEN 100 ELSE greatest(100 - (mean - 1000) / 100, 0) END) / 3 ELSE least(levels * 3.0, 100) END AS participation FROM j),
        y AS (SELECT market, round(depth, 3) AS depth, round(trading, 3) AS trading, round(spread, 3) AS spread, round(participation, 3) AS participation, round(0.35 * depth + 0.30 * trading + 0.20 * spread + 0.15 * participation, 3) AS score FROM x)
        SELECT *, CASE WHEN score >= 90 THEN 'very_deep' WHEN score >= 75 THEN 'deep' WHEN score >= 60 THEN 'above_average' WHEN score >= 45 THEN 'average' WHEN score >= 30 THEN 'below_average' WHEN score >= 15 THEN 'thin' ELSE 'extremely_thin' END AS category,
            CASE WHEN score <= 10 THEN 'critical' WHEN score <= 20 THEN 'high' WHEN score <= 30 THEN 'medium' WHEN score <= 35 THEN 'low' WHEN score <= 45 THEN 'info' END AS severity FROM y""",
    ),
    "det_relevant_liquidity": t.sql(
        "fills",
        _SIDES
        + _NEAR
        + """,d AS (SELECT market, side, total, sum(usd) AS usd, sum(CASE WHEN away <= 0.01 THEN usd ELSE 0 END) AS d1, sum(CASE WHEN away <= 0.02 THEN usd ELSE 0 END) AS d2, sum(CASE WHEN away <= 0.05 THEN usd ELSE 0 END) AS d5 FROM nr GROUP BY ALL)
        SELECT market, CASE WHEN side = 'ask' THEN 'BUY' ELSE 'SELL' END AS direction, round(total, 2) AS total, round(usd, 2) AS side_usd, round(CASE WHEN d2 > 0 THEN d2 ELSE usd END, 2) AS in_range, round(0.5 * d1 + 0.3 * d2 + 0.2 * d5, 2) AS weighted FROM d""",
    ),
    "det_impact_thresholds": t.sql(
        "fills",
        _SIDES
        + _NEAR
        + """,d AS (SELECT market, total, least(sum(CASE WHEN side = 'bid' AND away <= 0.01 THEN usd ELSE 0 END), sum(CASE WHEN side = 'ask' AND away <= 0.01 THEN usd ELSE 0 END)) AS v1,
            least(sum(CASE WHEN side = 'bid' AND away <= 0.05 THEN usd ELSE 0 END), sum(CASE WHEN side = 'ask' AND away <= 0.05 THEN usd ELSE 0 END)) AS v5 FROM nr GROUP BY ALL)
        SELECT market, """
        + ", ".join(f"round(CASE WHEN v1 = 0 AND v5 = 0 THEN total * {s} ELSE {f'v1 * {x}' if x <= 1 else 'v5' if x >= 5 else f'v1 + (v5 - v1) * {x - 1} / 4'} END, 3) AS {n}" for n, (x, s) in IMPACTS.items())
        + " FROM d",
    ),
    "score_funding_suspicion": t.sql(
        "fills",
        f""",z AS (SELECT wallet, min(ts_ms) AS first FROM fills WHERE usd < {DEPOSIT_USD} GROUP BY wallet),
        d AS (SELECT f.wallet, first, ts_ms, usd, counterparty AS source, ts_ms - lag(ts_ms) OVER (PARTITION BY f.wallet ORDER BY ts_ms, order_id, line, market, counterparty, usd) < {QUICK_DAYS * t.DAY} AS quick FROM fills f JOIN z ON z.wallet = f.wallet WHERE usd >= {DEPOSIT_USD} AND ts_ms <= first),
        a AS (SELECT wallet, count(*) AS deposits, (first - max(ts_ms)) / 86400000 AS days, max(usd) AS most, count(*) FILTER (quick) AS quick, max((source % 97 = 0)::INT) AS sanctioned, max((source % 13 = 0)::INT) AS mixer, avg(source % 2) AS unknown FROM d GROUP BY wallet, first)
        SELECT wallet, deposits, CASE WHEN days < 1 THEN 'flash' WHEN days < 7 THEN 'very_fast' WHEN days < 30 THEN 'fast' WHEN days < 90 THEN 'moderate' ELSE 'slow' END AS timing,
            least(CASE WHEN days < 1 THEN 40 WHEN days < 7 THEN 25 WHEN days < 30 THEN 10 ELSE 0 END + 50 * sanctioned + 30 * mixer + CASE WHEN most >= {LARGE_USD} THEN 15 ELSE 0 END + CASE WHEN quick >= 2 THEN 20 ELSE 0 END + CASE WHEN unknown >= 0.8 THEN 15 ELSE 0 END, 100) AS score FROM a""",
    ),
    "pair_sybil_similarity": t.sql("fills", "," + _SYBIL + " SELECT *, score >= 60 AS likely FROM sy"),
    "pair_sybil_clusters": "WITH RECURSIVE "
    + t.SQL["fills"]
    + ", "
    + _SYBIL.replace("round(", "round(1e-7 + ")
    + f""", e AS (SELECT a, b FROM sy WHERE score >= 60 UNION SELECT b, a FROM sy WHERE score >= 60), c AS (SELECT DISTINCT a AS node, a AS root FROM e UNION SELECT e.b, least(c.root, e.b) FROM c JOIN e ON e.a = c.node)
        SELECT root, count(*) AS n FROM (SELECT node, min(root) AS root FROM c GROUP BY node) GROUP BY root HAVING count(*) BETWEEN {CLUSTER[0]} AND {CLUSTER[1]}""",
}
