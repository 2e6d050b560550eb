"""Smaller measures of markets, wallets, alerts and signals: ladders, intervals, shares, tags and the parts of rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import tables as t
from ..functions import stats
from ..operators import sequences
from .detectors import WEIGHTS, signals

r = stats.rounded


def det_market_maturity(spark, sf):
    """Markets by their age at the end of the data: under a day, 7, 30 and 90 days, and mature."""
    f = t.fills(spark, sf)
    now = f.agg(F.max("ts_ms").alias("now"))
    a = f.groupBy("market").agg(F.min("ts_ms").alias("first")).crossJoin(F.broadcast(now))  # one row
    days = (F.col("now") - F.col("first")) / t.DAY
    return a.select("market", r(days, 3).alias("days"), stats.ladder(-days, [(-1 + 1e-9, "very_new"), (-7 + 1e-9, "new"), (-30 + 1e-9, "young"), (-90 + 1e-9, "established")], "mature").alias("maturity"))


def agg_time_periods(spark, sf):
    """Trades and volume by period of the UTC day: peak 14 to 21, off-hours 4 to 8, low 0 to 6 otherwise, standard."""
    hour = F.floor(F.col("ts_ms") / t.HOUR) % 24
    period = F.when(hour.between(14, 21), "peak").when(hour.between(4, 8), "off_hours").when(hour.between(0, 6), "low").otherwise("standard")
    return t.trades(spark, sf).groupBy("market", period.alias("period")).agg(F.count("*").alias("n"), r(F.sum("usd"), 3).alias("usd"))


#: Hours of a spike until it is sustained, and how soon after the check before it is sudden.
SUSTAINED, SUDDEN_MS = 3, 2 * t.HOUR


def det_spike_types(spark, sf):
    """Hours of a market far from its mean, by ratio and by how they came about: sustained, sudden, gradual or momentary.

    A spike is a run of such hours with no other hour of the market in between.
    """
    v = t.trades(spark, sf).groupBy("market", stats.bucket_ms(F.col("ts_ms"), t.HOUR).alias("hour")).agg(F.sum("usd").alias("v"))
    w = Window.partitionBy("market").orderBy("hour")
    ratio = F.col("v") / F.avg("v").over(Window.partitionBy("market"))
    level = F.when(ratio >= 5, "critical").when(ratio >= 3, "high").when(ratio >= 2, "medium").when(ratio >= 1.5, "low")
    low = F.when(ratio <= 1 / 5, "critical").when(ratio <= 1 / 3, "high").when(ratio <= 1 / 2, "medium").when(ratio <= 1 / 1.5, "low")
    x = v.withColumns({"ratio": r(ratio, 5), "severity": F.when(ratio > 0, F.coalesce(level, low)), "since": F.col("hour") - F.lag("hour").over(w)})
    calm = F.sum(F.col("severity").isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("run", calm).filter("severity is not null")
    run = Window.partitionBy("market", "run").orderBy("hour")
    x = x.withColumns({"nth": F.row_number().over(run), "lasted": F.col("hour") - F.first("hour").over(run)})
    kind = F.when((F.col("nth") >= SUSTAINED) & (F.col("lasted") >= (SUSTAINED - 1) * t.HOUR), "sustained").when((F.col("nth") <= 2) & (F.col("since") < SUDDEN_MS), "sudden").when((F.col("nth") > 2) & (F.col("nth") < SUSTAINED), "gradual").otherwise("momentary")
    return x.select("market", "hour", "ratio", "severity", kind.alias("kind"))


def pair_correlation_types(spark, sf):
    """How trades of one wallet in two markets within a day go together: at once, in turn, by volume, with or against.

    A pair of markets gets the trades of both, not their product: what all pairs of trades add up to follows from how
    many trades of the other market come before one by time, or are smaller, and from their sums.
    """
    day = F.floor(F.col("ts_ms") / t.DAY)
    e = t.trades(spark, sf).select("trade_id", "wallet", "market", day.alias("day"), (F.col("ts_ms") - day * t.DAY).alias("at"), "usd", "side")
    held = e.groupBy("wallet", "day").agg(F.collect_set("market").alias("markets")).filter(F.size("markets") > 1)
    each = e.join(held, ["wallet", "day"]).withColumn("other", F.explode(F.array_remove("markets", F.col("market")))).drop("markets")
    each = each.select("*", F.least("market", "other").alias("a"), F.greatest("market", "other").alias("b"), (F.col("market") < F.col("other")).alias("first"))
    of = ["wallet", "day", "a", "b"]

    def other_before(value, order):
        """How many of the other market's trades come before, and the sum of a value of them."""
        w = Window.partitionBy(*of).orderBy(order, "trade_id").rowsBetween(Window.unboundedPreceding, -1)
        count = lambda mine: F.coalesce(F.sum((F.col("first") == mine).cast("long")).over(w), F.lit(0))
        total = lambda mine: F.coalesce(F.sum(F.when(F.col("first") == mine, F.col(value))).over(w), F.lit(0))
        return F.when(F.col("first"), count(False)).otherwise(count(True)), F.when(F.col("first"), total(False)).otherwise(total(True))

    earlier, earlier_sum = other_before("at", "at")
    _, smaller_sum = other_before("usd", "usd")
    each = each.select(*of, "first", "side", (F.col("at") * earlier - earlier_sum).alias("apart"), F.when(F.col("usd") > 0, smaller_sum / F.col("usd")).otherwise(0.0).alias("volumes"))
    count = lambda first, buys: F.count_if((F.col("first") == first) & ((F.col("side") == "BUY") == buys))
    g = each.groupBy(*of).agg(count(True, True).alias("ab"), count(True, False).alias("as"), count(False, True).alias("bb"), count(False, False).alias("bs"), F.sum("apart").alias("apart"), F.sum("volumes").alias("volumes"))
    n = (F.col("ab") + F.col("as")) * (F.col("bb") + F.col("bs"))
    g = g.groupBy("a", "b").agg(F.sum(n).alias("n"), F.sum(F.col("ab") * F.col("bb") + F.col("as") * F.col("bs")).alias("same"), F.sum("apart").alias("apart"), F.sum("volumes").alias("volumes"))
    g = g.select("a", "b", "n", *[(F.col(c) / F.col("n")).alias(c) for c in ("same", "apart", "volumes")])
    kind = F.when(F.col("apart") < 150_000, "simultaneous").when(F.col("apart") < 1_800_000, "sequential").when(r("volumes", 6) > 0.3, "volume").when(r("same", 6) > 0.7, "positive").when(r("same", 6) < 0.3, "negative").otherwise("mixed")
    return g.select("a", "b", "n", r("same", 5).alias("same"), r(F.col("apart") / t.HOUR, 4).alias("hours"), r("volumes", 5).alias("volumes"), kind.alias("kind"))


def agg_timing_concentration(spark, sf):
    """One minus the normalised entropy of each wallet's trades over the hours of the day: 1 for a single hour."""
    h = t.trades(spark, sf).groupBy("wallet", (F.floor(F.col("ts_ms") / t.HOUR) % 24).alias("hour")).agg(F.count("*").alias("n"))
    a = h.groupBy("wallet").agg(F.sum("n").alias("n"), F.count("*").alias("hours"), F.sum(F.col("n") * F.ln("n")).alias("nlogn"))
    entropy = F.ln("n") - F.col("nlogn") / F.col("n")
    return a.select("wallet", "n", "hours", r(F.when(F.col("hours") > 1, 1 - entropy / F.ln("hours")).otherwise(1.0), 6).alias("concentration"))


def agg_size_outcome(spark, sf):
    """Correlation of size and win of each wallet's fills, 0 below five or without spread."""
    f = t.fills(spark, sf).select("wallet", (F.col("usd") / 1000).alias("x"), F.col("win").cast("double").alias("y"))
    return f.groupBy("wallet").agg(F.count("*").alias("n"), stats.pearson("x", "y").alias("c")).select("wallet", "n", r(F.when(F.col("n") >= 5, F.col("c")).otherwise(0.0), 5).alias("r"))


def cal_intervals(spark, sf):
    """Win rates of categories with normal and Wilson intervals, and whether they differ from the rest's by a two-share z."""
    f = t.fills(spark, sf).join(t.markets(spark, sf).select("market", "category"), "market")
    a = f.groupBy("category").agg(F.count("*").alias("n"), F.count_if("win").alias("hits"))
    j = a.crossJoin(F.broadcast(a.agg(F.sum("n").alias("all_n"), F.sum("hits").alias("all_hits"))))  # one row
    p = F.col("hits") / F.col("n")
    margin = 1.96 * F.sqrt(p * (1 - p) / F.col("n"))
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    z = stats.two_proportion_z(F.col("hits"), F.col("n"), F.col("all_hits") - F.col("hits"), F.col("all_n") - F.col("n"))
    out = j.select("category", "n", r(p, 6).alias("rate"), r(F.greatest(p - margin, F.lit(0.0)), 6).alias("low"), r(F.least(p + margin, F.lit(1.0)), 6).alias("high"), r(low, 6).alias("wilson_low"), r(high, 6).alias("wilson_high"), r(z, 5).alias("z"))
    return out.withColumn("significant", F.abs("z") > 1.96)


def ts_chunks(spark, sf):
    """The aligned days that the data covers, the last cut at its end, with the trades of each; empty days count 0."""
    e = t.trades(spark, sf)
    span = e.agg(F.min("ts_ms").alias("low"), F.max("ts_ms").alias("high"))
    starts = span.select("high", F.explode(F.sequence(F.floor(F.col("low") / t.DAY), F.floor((F.col("high") - 1) / t.DAY))).alias("day"))
    n = e.groupBy(F.floor(F.col("ts_ms") / t.DAY).alias("day")).agg(F.count("*").alias("n"))
    return starts.join(n, "day", "left").select((F.col("day") * t.DAY).alias("start_ms"), F.least((F.col("day") + 1) * t.DAY, "high").alias("end_ms"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


FEE_BPS = 25


def agg_fees(spark, sf):
    """Gross value, fee and net value of each wallet's fills at 25 basis points."""
    a = t.fills(spark, sf).groupBy("wallet").agg(F.sum(F.col("price") * F.col("size")).alias("gross"))
    fee = F.col("gross") * FEE_BPS / 10_000
    return a.select("wallet", r("gross", 2).alias("gross"), r(fee, 2).alias("fee"), r(F.col("gross") - fee, 2).alias("net"))


def top_needing_sync(spark, sf):
    """Markets to be synced next: those without a fill first, then by their last one, for ever older than 30 days."""
    f = t.fills(spark, sf)
    now = f.agg(F.max("ts_ms").alias("now"))
    j = t.markets(spark, sf).select("market").join(f.groupBy("market").agg(F.max("ts_ms").alias("synced")), "market", "left").crossJoin(F.broadcast(now))  # one row
    return j.filter(F.col("synced").isNull() | (F.col("synced") < F.col("now") - 30 * t.DAY)).select("market", "synced").orderBy(F.col("synced").asc_nulls_first(), "market").limit(50)


_SEVERITY = [(90_000, "critical"), (70_000, "high"), (50_000, "medium")]


def top_alerts_by_severity(spark, sf):
    """The 50 alerts that come first by severity, then the newest; severities compare by rank, not by name."""
    f = t.fills(spark, sf).filter("usd >= 40000")
    level = stats.ladder(F.col("usd"), _SEVERITY, "low")
    rank = stats.ladder(F.col("usd"), [(b, i) for i, (b, _) in zip((0, 1, 2), _SEVERITY, strict=True)], 3)
    return f.withColumns({"severity": level, "rank": rank}).orderBy("rank", F.desc("ts_ms"), "order_id", "line", "market", "usd").limit(50).select("order_id", "line", "market", "severity", "ts_ms")


def set_searched_alerts(spark, sf):
    """Alerts whose title, wallet's label or kind has a text, whatever its case, over all of them."""
    f = t.fills(spark, sf).filter("usd >= 70000")
    j = f.join(t.markets(spark, sf).select("market", "title"), "market", "left").join(t.wallets(spark, sf).select("wallet", "label", "kind"), "wallet", "left")
    has = lambda c, text: F.coalesce(F.contains(F.lower(c), F.lit(text)), F.lit(False))
    return j.filter(has("title", "red") | has("label", "#00000001") | has("kind", "machin")).groupBy("kind").agg(F.count("*").alias("n"), r(F.sum("usd"), 2).alias("usd"))


def set_dedup_keys(spark, sf):
    """Alerts folded by a key of wallet, market, severity and day: the hash, the first one's time and how many it stands for."""
    f = t.fills(spark, sf).filter("usd >= 40000")
    day = F.floor(F.col("ts_ms") / t.DAY)
    key = F.sha2(F.concat_ws("|", F.col("wallet").cast("string"), F.col("market").cast("string"), stats.ladder(F.col("usd"), _SEVERITY, "low"), day.cast("string")), 256)
    return f.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("ts_ms").alias("first"), r(F.sum("usd"), 2).alias("usd"))


def set_snapshots(spark, sf):
    """Daily snapshots of markets and of wallets in one table, of those days with a volume of 50,000 and more."""
    f = t.fills(spark, sf).withColumn("day", stats.bucket_ms(F.col("ts_ms"), t.DAY))
    of = lambda c: f.groupBy("day", c).agg(F.count("*").alias("n"), F.sum("usd").alias("usd")).select(F.lit(c).alias("of"), "day", F.col(c).alias("id"), "n", "usd")
    return of("market").union(of("wallet")).filter("usd >= 50000").withColumn("usd", r("usd", 2))


#: Weights of five groups of signals of a new wallet.
FRESH_WEIGHTS = {"age": 0.20, "trading": 0.20, "funding": 0.25, "coordination": 0.20, "activity": 0.15}


def score_fresh_confidence(spark, sf):
    """Confidence that a wallet is a suspicious new one: five groups of signals, each its mean, by .20, .20, .25, .20, .15."""
    f = t.fills(spark, sf)
    now = f.agg(F.max("ts_ms").alias("now"))
    a = f.groupBy("wallet").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"), F.avg("usd").alias("size"), F.max("usd").alias("most"), F.avg(F.col("win").cast("double")).alias("wins"), F.countDistinct("counterparty").alias("sources"), F.countDistinct("market").alias("markets"))
    a = a.crossJoin(F.broadcast(now))  # one row
    cap = lambda c: stats.clamp(c, 0.0, 100.0)
    age, idle = (F.col("now") - F.col("first")) / t.DAY, (F.col("now") - F.col("last")) / t.DAY
    groups = {
        "age": cap(100 - age / 25),
        "trading": (cap(F.col("wins") * 100) + cap(F.col("most") / 1000)) / 2,
        "funding": cap(100 - F.try_divide(F.col("sources") * 100, F.col("n"))),
        "coordination": cap(100 - F.try_divide(F.col("markets") * 100, F.col("n"))),
        "activity": cap(100 - idle / 10),
    }
    score = r(sum((groups[k] * w for k, w in FRESH_WEIGHTS.items()), F.lit(0.0)), 4)
    return a.select("wallet", score.alias("score")).withColumn("level", stats.ladder(F.col("score"), [(80, "very_high"), (60, "high"), (40, "medium"), (20, "low")], "very_low"))


#: Weights that a user set; what a user leaves out keeps the default, and all are scaled to a sum of one.
USER_WEIGHTS = {"win_rate": 0.5, "lean": 0.3}


def score_weight_impact(spark, sf):
    """What the weights that a user set change: each wallet's score by default and by the user's, and how many levels it moves."""
    mine = WEIGHTS | USER_WEIGHTS
    mine = {k: w / sum(mine.values()) for k, w in mine.items()}
    s = signals(spark, sf).filter("value is not null")
    pick = lambda ws: F.element_at(F.create_map(*[x for k, w in ws.items() for x in (F.lit(k), F.lit(float(w)))]), F.col("signal"))
    mean = lambda ws: r(F.sum(F.col("value") * pick(ws)) / F.sum(pick(ws)), 4)
    a = s.groupBy("wallet").agg(mean(WEIGHTS).alias("before"), mean(mine).alias("after"))
    level = lambda c: stats.ladder(F.col(c), [(80, 4), (60, 3), (40, 2), (20, 1)], 0)
    return a.select("wallet", "before", "after", r(F.col("after") - F.col("before"), 4).alias("change"), (level("after") - level("before")).alias("levels"))


def txt_deadlines(spark, sf):
    """Deadlines that texts name: ISO dates, quarters and years after "by", "before", "until" or "due"; impossible dates are null."""
    found = lambda pattern, kind: F.transform(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("said")))
    every = F.concat(found(r"\b(\d{4}-\d{2}-\d{2})\b", "date"), found(r"\b(q[1-4] \d{4})\b", "quarter"), found(r"\b(?:by|before|until|due) (\d{4})\b", "year"))
    base = t.table(spark, sf, "documents").select("doc_id", "text")
    d = base.select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.kind", "x.said").distinct()
    return d.select("doc_id", "kind", "said", F.when(F.col("kind") == "date", F.unix_date(F.expr("try_to_date(said, 'yyyy-MM-dd')"))).alias("day"))


#: Tags of titles: words with weights, words of which one must be there too, words that rule the tag out.
TAGS = {
    "finish": ({"metallic": 60, "burnished": 50, "steel": 40, "dim": 15}, ("blue", "green", "red", "steel"), ("floral",)),
    "colour": ({"blue": 40, "green": 40, "red": 40, "dark": 20, "pale": 20}, (), ("plain",)),
    "taste": ({"lemon": 50, "honeydew": 50, "chocolate": 60, "peach": 50}, (), ()),
}


def txt_tags(spark, sf):
    """Tags of market titles by weighted keywords with required context and exclusions, 30 points or more of 100, by confidence."""
    words = F.array_distinct(F.split(F.lower("title"), "[^a-z0-9]+"))
    m = t.markets(spark, sf).select("market", words.alias("w"))
    each = []
    for tag, (weights, context, never) in TAGS.items():
        score = F.least(sum((F.when(F.array_contains("w", k), float(x)).otherwise(0.0) for k, x in weights.items()), F.lit(0.0)), F.lit(100.0))
        any_of = lambda ws: F.arrays_overlap("w", F.array(*[F.lit(x) for x in ws]))
        allowed = (any_of(context) if context else F.lit(True)) & (~any_of(never) if never else F.lit(True))
        each.append(F.struct(F.lit(tag).alias("tag"), F.when(allowed, score).otherwise(0.0).alias("score")))
    out = m.select("market", F.inline(F.array(*each))).filter("score >= 30")
    return out.withColumn("confidence", stats.ladder(F.col("score"), [(80, "high"), (50, "medium")], "low"))


def seq_clusters_once(spark, sf):
    """Days on which three wallets or more began trading, each wallet in its first day only: clusters that share no wallet."""
    first = t.trades(spark, sf).groupBy("wallet").agg(F.min_by("ts_ms", F.struct("ts_ms", "trade_id")).alias("ts_ms"))
    c = first.groupBy(F.floor(F.col("ts_ms") / t.DAY).alias("day")).agg(F.count("*").alias("wallets"), F.min("ts_ms").alias("start"), F.max("ts_ms").alias("end")).filter("wallets >= 3")
    hours = (F.col("end") - F.col("start")) / t.HOUR
    density = F.least(F.when(hours > 0, F.col("wallets") / hours * 10).otherwise(100.0), F.lit(100.0))
    return c.select("day", "wallets", "start", "end", r(density, 4).alias("density"))


def pair_equal_groups(spark, sf):
    """Wallets that trade exactly the same set of markets, as groups: smallest wallet, size and the set's size."""
    e = t.trades(spark, sf).groupBy("wallet").agg(F.array_sort(F.collect_set("market")).alias("markets"))
    return e.groupBy("markets").agg(F.min("wallet").alias("first"), F.count("*").alias("n")).filter("n > 1").select("first", "n", F.size("markets").alias("markets"))


def book_from_deltas(spark, sf):
    """Books after all updates: each fill sets the size of its price, the last one of a price counts, a size of 1 removes it."""
    f = t.fills(spark, sf)
    at = F.struct("ts_ms", "order_id", "line", "counterparty", "usd", "wallet")
    level = f.groupBy("market", "side", F.floor("price").cast("long").alias("price")).agg(F.max_by("size", at).alias("size")).filter("size > 1")
    return level.groupBy("market", "side").agg(F.count("*").alias("levels"), F.max("price").alias("high"), F.min("price").alias("low"), r(F.sum("size"), 3).alias("size"))


def seq_top_ranked(spark, sf):
    """Wallets ranked by profit over all of them: place and share of wallets below."""
    a = t.fills(spark, sf).groupBy("wallet").agg(r(F.sum("pnl"), 2).alias("pnl"))
    return sequences.ranked(a, -F.floor(F.col("pnl") / 100), [F.desc("pnl"), "wallet"]).select("wallet", "pnl", "rank")


QUERIES = {f.__name__: f for f in (
    det_market_maturity, agg_time_periods, det_spike_types, pair_correlation_types, agg_timing_concentration, agg_size_outcome, cal_intervals, ts_chunks, agg_fees, top_needing_sync, top_alerts_by_severity,
    set_searched_alerts, set_dedup_keys, set_snapshots, score_fresh_confidence, score_weight_impact, txt_deadlines, txt_tags, seq_clusters_once, pair_equal_groups, book_from_deltas, seq_top_ranked,
)}

_LEVEL = "CASE WHEN usd >= 90000 THEN 'critical' WHEN usd >= 70000 THEN 'high' WHEN usd >= 50000 THEN 'medium' ELSE 'low' END"
_MINE = {k: w / sum((WEIGHTS | USER_WEIGHTS).values()) for k, w in (WEIGHTS | USER_WEIGHTS).items()}
_PICK = lambda ws: "CASE signal " + " ".join(f"WHEN '{k}' THEN {w!r}" for k, w in ws.items()) + " END"
_STEPS = lambda c: f"CASE WHEN {c} >= 80 THEN 4 WHEN {c} >= 60 THEN 3 WHEN {c} >= 40 THEN 2 WHEN {c} >= 20 THEN 1 ELSE 0 END"


def _tag_sql(tag: str) -> str:
    weights, context, never = TAGS[tag]
    some = lambda ws: "list_has_any(w, [" + ", ".join(f"'{x}'" for x in ws) + "])"
    score = " + ".join(f"CASE WHEN list_contains(w, '{k}') THEN {x} ELSE 0 END" for k, x in weights.items())
    rule = " AND ".join([*([some(context)] if context else []), *([f"NOT {some(never)}"] if never else [])]) or "true"
    return f"SELECT market, '{tag}' AS tag, CASE WHEN {rule} THEN least({score}, 100) ELSE 0 END::DOUBLE AS score FROM m"


ORACLE_SQL = {
    "det_market_maturity": t.sql(
        "fills",
        "SELECT market, round(d, 3) AS days, CASE WHEN d < 1 THEN 'very_new' WHEN d < 7 THEN 'new' WHEN d < 30 THEN 'young' WHEN d < 90 THEN 'established' ELSE 'mature' END AS maturity FROM (SELECT market, ((SELECT max(ts_ms) FROM fills) - min(ts_ms)) / 86400000 AS d FROM fills GROUP BY market)",
    ),
    "agg_time_periods": t.sql(
        "trades",
        "SELECT market, CASE WHEN h BETWEEN 14 AND 21 THEN 'peak' WHEN h BETWEEN 4 AND 8 THEN 'off_hours' WHEN h BETWEEN 0 AND 6 THEN 'low' ELSE 'standard' END AS period, count(*) AS n, round(sum(usd), 3) AS usd FROM (SELECT *, ts_ms // 3600000 % 24 AS h FROM trades) GROUP BY ALL",
    ),
    "det_spike_types": t.sql(
        "trades",
        """,v AS (SELECT market, ts_ms // 3600000 * 3600000 AS hour, sum(usd) AS v FROM trades GROUP BY ALL),
        x AS (SELECT market, hour, v / avg(v) OVER (PARTITION BY market) AS q, hour - lag(hour) OVER (PARTITION BY market ORDER BY hour) AS since FROM v),
        y AS (SELECT *, CASE WHEN q >= 5 THEN 'critical' WHEN q >= 3 THEN 'high' WHEN q >= 2 THEN 'medium' WHEN q >= 1.5 THEN 'low' WHEN q <= 0 THEN NULL WHEN q <= 1.0 / 5 THEN 'critical' WHEN q <= 1.0 / 3 THEN 'high' WHEN q <= 1.0 / 2 THEN 'medium' WHEN q <= 1 / 1.5 THEN 'low' END AS severity FROM x),
        z AS (SELECT *, sum((severity IS NULL)::INT) OVER (PARTITION BY market ORDER BY hour) AS run FROM y),
        n AS (SELECT *, row_number() OVER o AS nth, hour - first_value(hour) OVER o AS lasted FROM z WHERE severity IS NOT NULL WINDOW o AS (PARTITION BY market, run ORDER BY hour))
        SELECT market, hour, round(q, 5) AS ratio, severity, CASE WHEN nth >= 3 AND lasted >= 7200000 THEN 'sustained' WHEN nth <= 2 AND since < 7200000 THEN 'sudden' WHEN nth > 2 AND nth < 3 THEN 'gradual' ELSE 'momentary' END AS kind FROM n""",
    ),
    "pair_correlation_types": t.sql(
        "trades",
        """,g AS (SELECT x.market AS a, y.market AS b, count(*) AS n, avg((x.side = y.side)::INT) AS same, avg(abs(x.ts_ms - y.ts_ms)) AS apart, avg(CASE WHEN greatest(x.usd, y.usd) = 0 THEN 0 ELSE least(x.usd, y.usd) / greatest(x.usd, y.usd) END) AS volumes
            FROM trades x JOIN trades y ON x.wallet = y.wallet AND x.ts_ms // 86400000 = y.ts_ms // 86400000 AND x.market < y.market GROUP BY ALL)
        SELECT a, b, n, round(same, 5) AS same, round(apart / 3600000, 4) AS hours, round(volumes, 5) AS volumes,
            CASE WHEN apart < 150000 THEN 'simultaneous' WHEN apart < 1800000 THEN 'sequential' WHEN round(volumes, 6) > 0.3 THEN 'volume' WHEN round(same, 6) > 0.7 THEN 'positive' WHEN round(same, 6) < 0.3 THEN 'negative' ELSE 'mixed' END AS kind FROM g""",
    ),
    "agg_timing_concentration": t.sql(
        "trades",
        ",h AS (SELECT wallet, ts_ms // 3600000 % 24 AS hour, count(*) AS n FROM trades GROUP BY ALL) SELECT wallet, sum(n)::BIGINT AS n, count(*) AS hours, round(CASE WHEN count(*) > 1 THEN 1 - (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) ELSE 1 END, 6) AS concentration FROM h GROUP BY wallet",
    ),
    "agg_size_outcome": t.sql(
        "fills",
        "SELECT wallet, count(*) AS n, round(CASE WHEN count(*) >= 5 AND var_pop(usd) > 0 AND var_pop(win::INT) > 0 THEN corr(usd, win::INT) ELSE 0 END, 5) AS r FROM fills GROUP BY wallet",
    ),
    "cal_intervals": t.sql(
        "fills markets",
        """,a AS (SELECT category, count(*) AS n, count(*) FILTER (win) AS k FROM fills JOIN markets USING (market) GROUP BY category),
        b AS (SELECT *, k / n AS p, sum(n) OVER () - n AS n2, sum(k) OVER () - k AS k2 FROM a),
        c AS (SELECT *, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS mid, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) AS half, (k + k2) / (n + n2) AS pool FROM b)
        SELECT category, n, round(p, 6) AS rate, round(greatest(p - 1.96 * sqrt(p * (1 - p) / n), 0), 6) AS low, round(least(p + 1.96 * sqrt(p * (1 - p) / n), 1), 6) AS high, round(greatest(mid - half, 0), 6) AS wilson_low, round(least(mid + half, 1), 6) AS wilson_high,
            round((p - k2 / n2) / sqrt(pool * (1 - pool) * (1 / n + 1 / n2)), 5) AS z, abs(round((p - k2 / n2) / sqrt(pool * (1 - pool) * (1 / n + 1 / n2)), 5)) > 1.96 AS significant FROM c""",
    ),
    "ts_chunks": t.sql(
        "trades",
        """,s AS (SELECT max(ts_ms) AS high, unnest(range(min(ts_ms) // 86400000, (max(ts_ms) - 1) // 86400000 + 1)) AS day FROM trades), n AS (SELECT ts_ms // 86400000 AS day, count(*) AS n FROM trades GROUP BY 1)
        SELECT day * 86400000 AS start_ms, least((day + 1) * 86400000, high) AS end_ms, coalesce(n, 0) AS n FROM s LEFT JOIN n USING (day)""",
    ),
    "agg_fees": t.sql("fills", f"SELECT wallet, round(g, 2) AS gross, round(g * {FEE_BPS} / 10000, 2) AS fee, round(g - g * {FEE_BPS} / 10000, 2) AS net FROM (SELECT wallet, sum(price * size) AS g FROM fills GROUP BY wallet)"),
    "top_needing_sync": t.sql("fills markets", "SELECT market, synced FROM markets LEFT JOIN (SELECT market, max(ts_ms) AS synced FROM fills GROUP BY market) USING (market) WHERE synced IS NULL OR synced < (SELECT max(ts_ms) FROM fills) - 2592000000 ORDER BY synced NULLS FIRST, market LIMIT 50"),
    "top_alerts_by_severity": t.sql(
        "fills",
        f"SELECT order_id, line, market, {_LEVEL} AS severity, ts_ms FROM fills WHERE usd >= 40000 ORDER BY CASE WHEN usd >= 90000 THEN 0 WHEN usd >= 70000 THEN 1 WHEN usd >= 50000 THEN 2 ELSE 3 END, ts_ms DESC, order_id, line, market, usd LIMIT 50",
    ),
    "set_searched_alerts": t.sql(
        "fills markets wallets",
        "SELECT kind, count(*) AS n, round(sum(usd), 2) AS usd FROM fills LEFT JOIN markets USING (market) LEFT JOIN wallets USING (wallet) WHERE usd >= 70000 AND (contains(lower(title), 'red') OR contains(lower(label), '#00000001') OR contains(lower(kind), 'machin')) GROUP BY kind",
    ),
    "set_dedup_keys": t.sql("fills", f"SELECT sha256(concat_ws('|', wallet, market, {_LEVEL}, ts_ms // 86400000)) AS key, count(*) AS n, min(ts_ms) AS first, round(sum(usd), 2) AS usd FROM fills WHERE usd >= 40000 GROUP BY 1"),
    "set_snapshots": t.sql(
        "fills",
        ",d AS (SELECT *, ts_ms // 86400000 * 86400000 AS day FROM fills), s AS (SELECT 'market' AS of, day, market AS id, count(*) AS n, sum(usd) AS u FROM d GROUP BY ALL UNION ALL SELECT 'wallet', day, wallet, count(*), sum(usd) FROM d GROUP BY ALL) SELECT of, day, id, n, round(u, 2) AS usd FROM s WHERE u >= 50000",
    ),
    "score_fresh_confidence": t.sql(
        "fills",
        """,a AS (SELECT wallet, count(*) AS n, ((SELECT max(ts_ms) FROM fills) - min(ts_ms)) / 86400000 AS age, ((SELECT max(ts_ms) FROM fills) - max(ts_ms)) / 86400000 AS idle, max(usd) AS most, avg(win::INT) AS wins, count(DISTINCT counterparty) AS sources, count(DISTINCT market) AS markets FROM fills GROUP BY wallet),
        s AS (SELECT wallet, round(0.20 * least(greatest(100 - age / 25, 0), 100) + 0.20 * (least(greatest(wins * 100, 0), 100) + least(greatest(most / 1000, 0), 100)) / 2 + 0.25 * least(greatest(100 - sources * 100 / n, 0), 100) + 0.20 * least(greatest(100 - markets * 100 / n, 0), 100) + 0.15 * least(greatest(100 - idle / 10, 0), 100), 4) AS score FROM a)
        SELECT wallet, score, CASE WHEN score >= 80 THEN 'very_high' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' WHEN score >= 20 THEN 'low' ELSE 'very_low' END AS level FROM s""",
    ),
    "score_weight_impact": t.sql(
        "fills",
        f""",b AS (SELECT wallet, count(*) AS n, avg(win::INT) AS wins, max(usd) AS most, count(DISTINCT market) AS m, avg((side = 'BUY')::INT) AS buys FROM fills GROUP BY wallet),
        g AS (SELECT wallet, 'win_rate' AS signal, round(wins * 100, 6) AS value FROM b UNION ALL SELECT wallet, 'size', round(least(most / 1000, 100), 6) FROM b UNION ALL SELECT wallet, 'focus', round(100 - least(m / n * 50, 100), 6) FROM b
            UNION ALL SELECT wallet, 'lean', round(abs(buys - 0.5) * 200, 6) FROM b UNION ALL SELECT wallet, 'activity', CASE WHEN n >= 5 THEN round(least(n / 5, 100), 6) END FROM b),
        s AS (SELECT wallet, round(sum(value * {_PICK(WEIGHTS)}) / sum({_PICK(WEIGHTS)}), 4) AS before, round(sum(value * {_PICK(_MINE)}) / sum({_PICK(_MINE)}), 4) AS after FROM g WHERE value IS NOT NULL GROUP BY wallet)
        SELECT wallet, before, after, round(after - before, 4) AS change, {_STEPS("after")} - {_STEPS("before")} AS levels FROM s""",
    ),
    "txt_deadlines": r"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS s FROM documents),
        f AS (SELECT doc_id, 'date' AS kind, unnest(regexp_extract_all(s, '\b(\d{4}-\d{2}-\d{2})\b', 1)) AS said FROM d UNION SELECT doc_id, 'quarter', unnest(regexp_extract_all(s, '\b(q[1-4] \d{4})\b', 1)) FROM d
            UNION SELECT doc_id, 'year', unnest(regexp_extract_all(s, '\b(?:by|before|until|due) (\d{4})\b', 1)) FROM d)
        SELECT doc_id, kind, said, CASE WHEN kind = 'date' THEN TRY_CAST(said AS DATE) - DATE '1970-01-01' END AS day FROM f""",
    "txt_tags": t.sql(
        "markets",
        ",m AS (SELECT market, list_distinct(regexp_split_to_array(lower(title), '[^a-z0-9]+')) AS w FROM markets), s AS (" + " UNION ALL ".join(map(_tag_sql, TAGS)) + ") SELECT market, tag, score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS confidence FROM s WHERE score >= 30",
    ),
    "seq_clusters_once": t.sql(
        "trades",
        """,f AS (SELECT wallet, min(ts_ms) AS ts FROM trades GROUP BY wallet), c AS (SELECT ts // 86400000 AS day, count(*) AS wallets, min(ts) AS start, max(ts) AS "end" FROM f GROUP BY 1 HAVING count(*) >= 3)
        SELECT day, wallets, start, "end", round(least(CASE WHEN "end" > start THEN wallets / (("end" - start) / 3600000) * 10 ELSE 100 END, 100), 4) AS density FROM c""",
    ),
    "pair_equal_groups": t.sql("trades", ",s AS (SELECT wallet, list_sort(list(DISTINCT market)) AS ms FROM trades GROUP BY wallet) SELECT min(wallet) AS first, count(*) AS n, len(ms) AS markets FROM s GROUP BY ms HAVING count(*) > 1"),
    "book_from_deltas": t.sql(
        "fills",
        ",l AS (SELECT market, side, floor(price)::BIGINT AS price, arg_max(size, (ts_ms, order_id, line, counterparty, usd, wallet)) AS size FROM fills GROUP BY ALL) SELECT market, side, count(*) AS levels, max(price) AS high, min(price) AS low, round(sum(size), 3) AS size FROM l WHERE size > 1 GROUP BY ALL",
    ),
    "seq_top_ranked": t.sql("fills", "SELECT wallet, pnl, row_number() OVER (ORDER BY pnl DESC, wallet) AS rank FROM (SELECT wallet, round(sum(pnl), 2) AS pnl FROM fills GROUP BY wallet)"),
}
