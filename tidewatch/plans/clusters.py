"""Clusters of wallets: by linkage of their features, by when they began, by how they trade and by several of these at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as t
from ..functions import stats
from ..operators import graph, greedy, learning, linkage
from ..operators import sequences as seq

r = stats.rounded
#: Linkage: steps a standard deviation, steps from the mean that count, clusters.
STEPS, FARTHEST, CLUSTERS = 2, 4, 4
#: Windows in which wallets begin, the score that a window needs, wallets that a cluster needs.
WINDOW_MS, LEAST_SCORE, LEAST_WALLETS = t.DAY, 30, 2
#: From so many wallets an hour on a window has the full score, however regular it is.
FULL_RATE = 10
#: Trading patterns: steps of log10 of sizes and gaps, and of the share of buys; the similarity of a link.
LOG_STEPS, BUY_STEPS, SIMILAR = 4, 10, 0.9
#: Weights of markets, buys, sizes, gaps and parts of the day in a similarity.
PATTERN = {"markets": 0.3, "buys": 0.15, "size": 0.2, "gap": 0.15, "hours": 0.2}


def ml_average_linkage(spark, sf):
    """Wallets in four clusters by average linkage of count, mean and wins on a grid of half deviations, with silhouettes."""
    f = t.fills(spark, sf).groupBy("wallet").agg(F.count("*").cast("double").alias("n"), F.avg("usd").alias("mean"), F.avg(F.col("win").cast("double")).alias("wins"))
    scaled = learning.scaled(f, ["n", "mean", "wins"], "standard")
    levels = F.array(*[stats.clamp(stats.half_up(F.col(c) * STEPS), -FARTHEST, FARTHEST).cast("int") for c in ("n", "mean", "wins")])
    return linkage.linked_clusters(scaled, "wallet", levels, CLUSTERS).select("wallet", "cluster", r("silhouette", 6).alias("silhouette"))


def _starts(spark, sf):
    """(wallet, ts_ms, place): first trades, numbered in their order."""
    first = t.trades(spark, sf).groupBy("wallet").agg(F.min("ts_ms").alias("ts_ms"))
    placed = seq.ranked(first, F.floor(F.col("ts_ms") / WINDOW_MS), ["ts_ms", "wallet"]).select("wallet", "ts_ms", F.col("rank").alias("place"))
    graph.shared_checkpoints(spark)
    return placed.checkpoint()


def _temporal_windows(starts):
    """Windows that end with a wallet's start and hold those of the day before it, scored by density and regularity.

    Deviations of gaps are worked out for windows only that aren't dense enough for the full score without them, which
    hold FULL_RATE wallets an hour at most.
    """
    at = seq.rolling(starts, [], "place", "place", {"w": WINDOW_MS})
    w = at.select(F.col("first_w").cast("long").alias("lo"), F.col("place").alias("hi"), F.col("first_ms_w").alias("start"), F.col("ts_ms").alias("end"))
    w = w.withColumns({"n": F.col("hi") - F.col("lo") + 1, "hours": (F.col("end") - F.col("start")) / t.HOUR}).filter(F.col("n") >= LEAST_WALLETS)
    sparse = w.filter(F.col("n") < F.col("hours") * FULL_RATE)
    each = sparse.select(F.col("hi").alias("of"), F.explode(F.sequence("lo", "hi")).alias("place")).join(starts.select("place", "ts_ms"), "place")
    times = each.groupBy("of").agg(F.array_sort(F.collect_list("ts_ms")).alias("x"))
    gap = (F.element_at("x", -1) - F.element_at("x", 1)) / (F.size("x") - 1)
    gaps = F.transform(F.sequence(F.lit(1), F.size("x") - 1), lambda i: F.abs(F.get("x", i) - F.get("x", i - 1) - gap))
    off = times.select("of", (F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size(gaps)).alias("off"))
    both = w.join(off, F.col("hi") == F.col("of"), "left")
    score = F.when(F.col("off").isNull(), 100.0).otherwise(F.least(F.col("n") / F.col("hours") * 10 + F.greatest(50 - F.col("off") / 60_000, F.lit(0.0)), F.lit(100.0)))
    return both.select("lo", "hi", "start", "end", "n", score.alias("score")).filter(F.col("score") >= LEAST_SCORE)


def _temporal(starts):
    return greedy.disjoint_intervals(_temporal_windows(starts), LEAST_WALLETS, WINDOW_MS)


def seq_temporal_clusters(spark, sf):
    """Wallets that began within a day of each other: windows scored, then taken from the largest on, each without the
    wallets that larger ones have; `wallets` of a window's n are left to it."""
    out = _temporal(_starts(spark, sf))
    gap = (F.col("end") - F.col("start")) / (F.col("n") - 1) / 1000
    return out.select("start", "end", "n", (F.col("right") - F.col("left") + 1).alias("wallets"), r(gap, 3).alias("gap_seconds"), r("score", 4).alias("score"))


def _memberships(spark, sf):
    """(wallet, cluster): clusters by start, by the first market and by the set of markets; each has two wallets or more."""
    trades, starts = t.trades(spark, sf), _starts(spark, sf)
    by_start = _temporal(starts).select(F.concat(F.lit("start-"), "hi").alias("cluster"), F.explode(F.sequence("left", "right")).alias("place")).join(starts, "place").select("wallet", "cluster")
    by = trades.groupBy("wallet").agg(F.min_by("market", F.struct("ts_ms", "trade_id")).alias("first"), F.array_join(F.array_sort(F.collect_set("market")), "+").alias("set"))
    rows = by_start.union(by.select("wallet", F.concat(F.lit("first-"), "first"))).union(by.select("wallet", F.concat(F.lit("set-"), "set")))
    several = rows.groupBy("cluster").agg(F.count("*").alias("n")).filter("n >= 2").select("cluster")
    return rows.join(several, "cluster").select("wallet", "cluster").checkpoint()


def graph_multi_factor_groups(spark, sf):
    """Groups of wallets that share two clusters or more with the first of them, taken in the order of wallets.

    Wallets of the same clusters are one class. Classes are linked through the pairs of clusters that they share, never as
    pairs of classes, so that a crowded cluster makes as many rows as it has classes.
    """
    m = _memberships(spark, sf)
    classes = m.groupBy("wallet").agg(F.array_sort(F.collect_list("cluster")).alias("clusters")).filter(F.size("clusters") > 1)
    classes = classes.groupBy("clusters").agg(F.min("wallet").alias("class"), F.count("*").alias("n")).checkpoint()
    each = classes.select("class", "n", F.explode("clusters").alias("cluster"))
    # two share two clusters if they share a pair of clusters: a wallet has three clusters at most, so three pairs
    pairs = F.flatten(F.transform("clusters", lambda x: F.transform(F.filter("clusters", lambda y: y > x), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    seeds = greedy.first_seeds_by_key(classes.select(F.col("class").alias("node"), F.explode(pairs).alias("key"))).checkpoint()
    held = each.join(seeds, F.col("class") == F.col("node")).groupBy("seed", "cluster").agg(F.sum("n").alias("k"))
    shared = held.groupBy("seed").agg(F.count_if(F.col("k") >= 2).alias("clusters"))
    sizes = classes.join(seeds, F.col("class") == F.col("node")).groupBy("seed").agg(F.sum("n").alias("wallets"))
    return sizes.filter(F.col("wallets") >= LEAST_WALLETS).join(shared, "seed").select(F.col("seed").alias("wallet"), "wallets", "clusters")


def _pattern_points(spark, sf):
    """Wallets with two trades or more, folded to points: log10 of size and gap, share of buys, parts of the day, markets."""
    e = t.trades(spark, sf).filter("usd > 0")
    part = F.floor(F.col("ts_ms") / (6 * t.HOUR)) % 4
    a = e.groupBy("wallet").agg(F.count("*").alias("n"), F.avg("usd").alias("size"), ((F.max("ts_ms") - F.min("ts_ms")) / 1000).alias("span"), F.avg((F.col("side") == "BUY").cast("double")).alias("buys"), F.array_sort(F.collect_set("market")).alias("markets"), *[F.avg((part == i).cast("double")).alias(f"h{i}") for i in range(4)])
    a = a.filter("n > 1 and span > 0")
    log = lambda x: stats.half_up(F.log10(x) * LOG_STEPS + 1e-9).cast("int")
    hours = F.array(*[stats.half_up(F.col(f"h{i}") * 4 + 1e-9).cast("int") for i in range(4)])
    return a.groupBy("markets", log(F.col("size")).alias("size"), log(F.col("span") / (F.col("n") - 1)).alias("gap"), stats.half_up(F.col("buys") * BUY_STEPS + 1e-9).cast("int").alias("buys"), hours.alias("hours")).agg(F.min("wallet").alias("id"), F.count("*").alias("wallets"), F.sum("n").alias("trades"))


def pair_trading_patterns(spark, sf):
    """Clusters of wallets that trade alike: points linked by a similarity of 0.9 or more, and what is linked to them.

    A similarity of s leaves 1 - s for what all parts lack, so no part may lack more than that over its weight: points
    that can be linked share one of the rarest markets of each, and lie in neighbouring cells of size and of gap.
    """
    graph.shared_checkpoints(spark)
    p = _pattern_points(spark, sf).checkpoint()
    lack = 1 - SIMILAR
    least_jaccard = 1 - lack / PATTERN["markets"]
    cell = {c: max(1, int(2 * LOG_STEPS * lack / PATTERN[c] + 1e-9)) for c in ("size", "gap")}
    often = p.select("id", F.explode("markets").alias("market")).groupBy("market").agg(F.count("*").alias("points"))
    ordered = p.select("id", F.explode("markets").alias("market")).join(often, "market").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("points", "market"))), lambda x: x["market"]).alias("rarest"))
    prefix = F.slice("rarest", F.lit(1), F.size("rarest") - F.ceil(F.size("rarest") * least_jaccard - 1e-9).cast("int") + 1)
    at = p.join(ordered, "id").select("id", F.explode(prefix).alias("market"), F.floor(F.col("size") / cell["size"]).alias("i"), F.floor(F.col("gap") / cell["gap"]).alias("j"))
    around = F.inline(F.array(*[F.struct((F.col("i") + x).alias("i"), (F.col("j") + y).alias("j")) for x in (-1, 0, 1) for y in (-1, 0, 1)]))
    met = at.select(F.col("id").alias("a"), "market", around).join(at.select(F.col("id").alias("b"), "market", "i", "j"), ["market", "i", "j"]).filter("a < b").select("a", "b").distinct()
    side = lambda x: p.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("markets", "size", "gap", "buys", "hours")])
    jaccard = F.size(F.array_intersect("markets_a", "markets_b")) / F.size(F.array_union("markets_a", "markets_b"))
    near = lambda c: F.greatest(1 - F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) / (2 * LOG_STEPS), F.lit(0.0))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0), lambda s, z: s + z)
    cosine = dot("hours_a", "hours_b") / F.sqrt(dot("hours_a", "hours_a") * dot("hours_b", "hours_b"))
    parts = {"markets": jaccard, "buys": 1 - F.abs(F.col("buys_a") - F.col("buys_b")) / BUY_STEPS, "size": near("size"), "gap": near("gap"), "hours": cosine}
    similarity = r(sum(w * parts[c] for c, w in PATTERN.items()), 6)
    links = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", similarity.alias("similarity")).filter(F.col("similarity") >= SIMILAR).checkpoint()
    roots = graph.components(links)
    of = p.join(roots, F.col("id") == F.col("node"), "left").withColumn("cluster", F.coalesce("root", "id"))
    linked = links.join(roots, F.col("a") == F.col("node")).groupBy(F.col("root").alias("_root")).agg(F.count("*").alias("links"), F.avg("similarity").alias("similarity"))
    out = of.groupBy("cluster").agg(F.sum("wallets").alias("wallets"), F.count("*").alias("points"), F.sum("trades").alias("trades")).filter(F.col("wallets") >= LEAST_WALLETS)
    return out.join(linked, F.col("cluster") == F.col("_root"), "left").select("cluster", "wallets", "points", "trades", F.coalesce("links", F.lit(0)).cast("long").alias("links"), r("similarity", 5).alias("similarity"))


QUERIES = {f.__name__: f for f in (ml_average_linkage, seq_temporal_clusters, graph_multi_factor_groups, pair_trading_patterns)}

_TEMPORAL = f"""f AS (SELECT wallet, min(ts_ms) AS ts FROM trades GROUP BY wallet), p AS (SELECT *, row_number() OVER (ORDER BY ts, wallet) AS place FROM f),
w AS (SELECT a.place AS hi, min(b.place) AS lo, a.ts AS "end", min(b.ts) AS start FROM p a JOIN p b ON b.ts >= a.ts - {WINDOW_MS} AND b.place <= a.place GROUP BY ALL HAVING count(*) >= {LEAST_WALLETS}),
g AS (SELECT place, ts - lag(ts) OVER (ORDER BY place) AS gap FROM p),
d AS (SELECT hi, lo, start, "end", hi - lo + 1 AS n, avg(abs(gap - ("end" - start) / (hi - lo))) AS off FROM w JOIN g ON g.place > lo AND g.place <= hi GROUP BY ALL),
s AS (SELECT *, CASE WHEN n >= {FULL_RATE} * ("end" - start) / 3600000 THEN 100 ELSE least(100, n / (("end" - start) / 3600000) * 10 + greatest(0, 50 - off / 60000)) END AS score FROM d),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, hi) AS i FROM s WHERE score >= {LEAST_SCORE}),
c AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS used, []::BIGINT[] AS fresh
    UNION ALL SELECT i, CASE WHEN len(fresh) >= {LEAST_WALLETS} THEN list_concat(used, fresh) ELSE used END, fresh
    FROM (SELECT o.i, c.used, list_filter(range(o.lo, o.hi + 1), lambda x: NOT list_contains(c.used, x)) AS fresh FROM c JOIN o ON o.i = c.i + 1)),
kept AS (SELECT o.*, fresh FROM o JOIN c USING (i) WHERE len(fresh) >= {LEAST_WALLETS})"""
_RECURSIVE = "WITH RECURSIVE " + t.SQL["trades"] + ",\n"
_LOG = lambda x: f"floor(log10({x}) * {LOG_STEPS} + 1e-9 + 0.5)::INT"
_DOT = lambda x, y: f"list_dot_product({x}::DOUBLE[], {y}::DOUBLE[])"

ORACLE_SQL = {
    "seq_temporal_clusters": _RECURSIVE + _TEMPORAL + """ SELECT start, "end", n, len(fresh) AS wallets, round(1e-7 + ("end" - start) / (n - 1) / 1000, 3) AS gap_seconds, round(1e-7 + score, 4) AS score FROM kept""",
    "graph_multi_factor_groups": _RECURSIVE
    + _TEMPORAL
    + f""",
b AS (SELECT wallet, arg_min(market, (ts_ms, trade_id)) AS first, array_to_string(list_sort(list(DISTINCT market)), '+') AS kinds FROM trades GROUP BY wallet),
rows AS (SELECT wallet, 'start-' || hi AS cluster FROM (SELECT hi, unnest(fresh) AS place FROM kept) JOIN p USING (place) UNION ALL SELECT wallet, 'first-' || first FROM b UNION ALL SELECT wallet, 'set-' || kinds FROM b),
m AS (SELECT * FROM rows WHERE cluster IN (SELECT cluster FROM rows GROUP BY cluster HAVING count(*) >= 2)),
z AS (SELECT wallet, row_number() OVER (ORDER BY wallet) AS i FROM m GROUP BY wallet HAVING count(*) >= 2),
near AS (SELECT a, list(b) AS near FROM (SELECT x.wallet AS a, y.wallet AS b FROM m x JOIN m y ON x.cluster = y.cluster AND x.wallet != y.wallet GROUP BY ALL HAVING count(*) >= 2) GROUP BY a),
zn AS (SELECT z.wallet, z.i, coalesce(near, []::BIGINT[]) AS near FROM z LEFT JOIN near ON a = wallet),
q AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS done, 0::BIGINT AS wallet, []::BIGINT[] AS members
    UNION ALL SELECT i, list_concat(done, members), wallet, members
    FROM (SELECT zn.i, zn.wallet, q.done, CASE WHEN list_contains(q.done, zn.wallet) THEN []::BIGINT[] ELSE list_concat([zn.wallet], list_filter(zn.near, lambda x: NOT list_contains(q.done, x))) END AS members FROM q JOIN zn ON zn.i = q.i + 1)),
groups AS (SELECT wallet, members FROM q WHERE len(members) >= {LEAST_WALLETS}),
shared AS (SELECT g.wallet, m.cluster FROM (SELECT wallet, unnest(members) AS member FROM groups) g JOIN m ON m.wallet = g.member GROUP BY ALL HAVING count(*) >= 2)
SELECT wallet, len(members)::BIGINT AS wallets, (SELECT count(*) FROM shared s WHERE s.wallet = groups.wallet) AS clusters FROM groups""",
    "pair_trading_patterns": _RECURSIVE
    + f"""a AS (SELECT wallet, count(*) AS n, avg(usd) AS size, (max(ts_ms) - min(ts_ms)) / 1000 AS span, avg((side = 'BUY')::INT) AS buys, list_sort(list(DISTINCT market)) AS markets, """
    + ", ".join(f"avg((ts_ms // 21600000 % 4 = {i})::INT) AS h{i}" for i in range(4))
    + f""" FROM trades WHERE usd > 0 GROUP BY wallet HAVING count(*) > 1 AND max(ts_ms) > min(ts_ms)),
p AS (SELECT markets, {_LOG("size")} AS size, {_LOG("span / (n - 1)")} AS gap, floor(buys * {BUY_STEPS} + 1e-9 + 0.5)::INT AS buys, [{", ".join(f"floor(h{i} * 4 + 1e-9 + 0.5)::INT" for i in range(4))}] AS hours,
    min(wallet) AS id, count(*) AS wallets, sum(n)::BIGINT AS trades FROM a GROUP BY ALL),
s AS (SELECT x.id AS a, y.id AS b, round(1e-7 + 0.3 * len(list_intersect(x.markets, y.markets)) / len(list_distinct(list_concat(x.markets, y.markets))) + 0.15 * (1 - abs(x.buys - y.buys) / {BUY_STEPS}.0)
    + 0.2 * greatest(0, 1 - abs(x.size - y.size) / {2 * LOG_STEPS}.0) + 0.15 * greatest(0, 1 - abs(x.gap - y.gap) / {2 * LOG_STEPS}.0)
    + 0.2 * {_DOT("x.hours", "y.hours")} / sqrt({_DOT("x.hours", "x.hours")} * {_DOT("y.hours", "y.hours")}), 6) AS similarity FROM p x JOIN p y ON x.id < y.id),
l AS (SELECT * FROM s WHERE similarity >= {SIMILAR}),
ends AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT id AS node, id AS root FROM p UNION SELECT ends.b, c.root FROM c JOIN ends ON ends.a = c.node WHERE c.root < ends.b),
roots AS (SELECT node, min(root) AS cluster FROM c GROUP BY node),
k AS (SELECT cluster, count(*) AS links, avg(similarity) AS similarity FROM l JOIN roots ON node = a GROUP BY cluster)
SELECT cluster, sum(wallets)::BIGINT AS wallets, count(*) AS points, sum(trades)::BIGINT AS trades, coalesce(any_value(links), 0) AS links, round(1e-7 + any_value(similarity), 5) AS similarity
FROM p JOIN roots ON node = id LEFT JOIN k USING (cluster) GROUP BY cluster HAVING sum(wallets) >= {LEAST_WALLETS}""",
}
