"""Back-tests that train, thresholds that learn, cycles over what is new and profiles that merge."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import tables as t
from ..functions import stats
from ..operators import feedback, incremental, profiles
from ..operators.graph import shared_checkpoints

r = stats.rounded
#: Walk-forward: days of a window, folds at most (as many as the reports have), steps of usd, thresholds, prior rows.
WINDOW_DAYS, FOLDS, STEP_USD, PRIOR = 120, 10, 15_000, 4
THRESHOLDS = [round(0.3 + 0.05 * i, 2) for i in range(9)]
#: Adaptive thresholds: the first value, days that a z-score looks back on, days that it needs.
FIRST, BACK, NEEDED = 60.0, 7, 3
RULES = [
    feedback.Rule("surge", "z_volume", 1.5, 10.0, -30.0, 50.0, 2),
    feedback.Rule("quiet", "z_volume", -1.0, -8.0, -30.0, 50.0, 1),
    feedback.Rule("crowd", "z_trades", 1.5, 5.0, -30.0, 50.0, 3),
]
#: Cycles: how late rows may come, and every how manyth does, by how much.
LATE_MS, LATE_EVERY, LATE_BY = 3 * t.HOUR, 50, 2 * t.HOUR


def cal_walk_forward_trained(spark, sf):
    """Folds of two windows: win rates by category, size and side and the threshold of the best F1 are learned on the
    first and judged on the second; overfitting is the mean difference of accuracy, precision, recall and F1.

    All rows are counted once, by window and cell; everything else is done on those counts. Windows are counted from the
    first line item; only if the first of the markets' own fills is another are they counted again, from that one.
    """
    shared_checkpoints(spark)
    f = t.fills(spark, sf).select("market", "side", "usd", "win", "ts_ms").join(t.markets(spark, sf).select("market", "category"), "market")

    def counted(low):
        k = F.floor((F.col("ts_ms") - F.lit(low)) / (WINDOW_DAYS * t.DAY))
        return f.groupBy(k.alias("k"), "category", "side", F.floor(F.col("usd") / STEP_USD).alias("step")).agg(F.count("*").alias("n"), F.count_if("win").alias("wins"), F.min("ts_ms").alias("low"), F.max("ts_ms").alias("high")).checkpoint()

    first = t.line_ends(spark, sf)[0] or 0
    cells = counted(first)
    low, high = cells.agg(F.min("low"), F.max("high")).first()
    if low is not None and low != first:
        cells = counted(low)
    folds = min((high - low) // t.DAY // WINDOW_DAYS - 1, FOLDS) if low is not None else 0
    parts = F.array(F.struct(F.col("k").alias("fold"), F.lit("train").alias("part")), F.struct((F.col("k") - 1).alias("fold"), F.lit("test").alias("part")))
    cells = cells.select("category", "side", "step", "n", "wins", F.inline(parts)).filter((F.col("fold") >= 0) & (F.col("fold") < folds))
    train = cells.filter("part = 'train'")
    base = train.groupBy("fold").agg((F.sum("wins") / F.sum("n")).alias("base"))
    known = train.select("fold", "category", "side", "step", F.col("n").alias("kn"), F.col("wins").alias("kw"))
    scored = cells.join(F.broadcast(base), "fold").join(known, ["fold", "category", "side", "step"], "left")
    p = r((F.coalesce("kw", F.lit(0)) + PRIOR * F.col("base")) / (F.coalesce("kn", F.lit(0)) + PRIOR), 6)
    each = scored.select("fold", "part", "n", "wins", p.alias("p"), F.explode(F.array(*[F.lit(x) for x in THRESHOLDS])).alias("threshold"))
    said = F.col("p") >= F.col("threshold")
    sums = each.groupBy("fold", "threshold", "part").agg(F.sum("n").alias("n"), F.sum(F.when(said, F.col("wins")).otherwise(0)).alias("tp"), F.sum(F.when(said, F.col("n") - F.col("wins")).otherwise(0)).alias("fp"), F.sum(F.when(~said, F.col("wins")).otherwise(0)).alias("fn"))
    safe = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    m = sums.withColumns({"accuracy": (F.col("n") - fp - fn) / F.col("n"), "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "f1": r(safe(2 * tp, 2 * tp + fp + fn), 6)})
    best = m.filter("part = 'train'").groupBy("fold").agg(F.min(F.struct((-F.col("f1")).alias("minus"), "threshold"))["threshold"].alias("threshold"))
    names = ("accuracy", "precision", "recall", "f1")
    side = lambda part: m.filter(F.col("part") == part).join(best, ["fold", "threshold"]).select(F.col("fold").alias(f"fold_{part}"), *[F.col(c).alias(f"{part}_{c}") for c in ("n", *names)])
    both = best.join(side("train"), F.col("fold") == F.col("fold_train")).join(side("test"), F.col("fold") == F.col("fold_test"))
    gap = sum(F.abs(F.col(f"train_{c}") - F.col(f"test_{c}")) for c in names) / 4
    return both.select("fold", "threshold", "train_n", "test_n", *[r(f"{part}_{c}", 5).alias(f"{part}_{c}") for part in ("train", "test") for c in names], r(gap, 5).alias("overfitting"))


def _days(spark, sf):
    d = t.trades(spark, sf).groupBy("market", F.floor(F.col("ts_ms") / t.DAY).alias("day")).agg(F.sum("usd").alias("volume"), F.count("*").cast("double").alias("trades"))
    w = Window.partitionBy("market").orderBy("day").rowsBetween(-BACK, -1)
    z = lambda c: F.when(F.count(c).over(w) >= NEEDED, r(stats.population_z(F.col(c), F.avg(c).over(w), F.stddev_pop(c).over(w)), 6))
    return d.select("market", "day", z("volume").alias("z_volume"), z("trades").alias("z_trades"))


def det_adaptive_thresholds(spark, sf):
    """The moves of each market's threshold by its days' volumes and counts against the week before."""
    out = feedback.moves(_days(spark, sf), "market", FIRST, RULES)
    return out.select("market", "day", "rule", r("before", 5).alias("before"), r("after", 5).alias("after"))


def _folder(spark, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="cycles-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def hourly(rows):
    """Sums of trades by market and hour, from which any longer stretch follows."""
    by = rows.groupBy("market", stats.bucket_ms(F.col("ts_ms"), t.HOUR).alias("bucket"))
    return by.agg(F.count("*").alias("n"), F.sum("usd").alias("usd"), F.max("usd").alias("most"))


def ts_incremental_volume(spark, sf):
    """Hourly sums that three cycles have made, each over a third of the time, with some rows two hours late."""
    e, at = t.trades(spark, sf), _folder(spark, "cycles")
    low, high = e.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    comes = F.col("ts_ms") + F.when(F.col("trade_id") % LATE_EVERY == 0, LATE_BY).otherwise(0)
    for upto in (low + (high - low) // 3, low + (high - low) * 2 // 3, high + LATE_MS):
        incremental.cycle(e.filter(comes <= upto), at, upto, LATE_MS, hourly)
    return incremental.state(spark, at).select("market", F.col("bucket").alias("hour"), "n", r("usd", 3).alias("usd"), "most")


def class_profiles(spark, sf):
    """Profiles of wallets from states of each of their days, merged: size, spread, quantiles, markets, days and style."""
    rows = t.trades(spark, sf).withColumn("day", F.floor(F.col("ts_ms") / t.DAY))
    days = profiles.states(rows, ["wallet", "day"], "usd", "market")
    p = profiles.merged(days.drop("day"), ["wallet"]).join(days.groupBy("wallet").agg(F.count("*").alias("days")), "wallet")
    pace = F.col("n") / F.greatest((F.col("last_ms") - F.col("first_ms")) / t.DAY, F.lit(1.0))
    style = F.concat_ws("-", stats.ladder(pace, [(4, "busy"), (1.5, "steady")], "rare"), stats.ladder(F.col("p90"), [(120, "large"), (60, "medium")], "small"))
    p = p.select("wallet", "n", "days", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("deviation"), "low", "high", profiles.quantile(0.5).alias("median"), profiles.quantile(0.9).alias("p90"), F.hll_sketch_estimate("seen").alias("markets"), pace.alias("pace"), "last_ms", "first_ms")
    return p.select("wallet", "n", "days", r("mean", 4).alias("mean"), r("deviation", 4).alias("deviation"), "low", "high", r("median", 4).alias("median"), r("p90", 4).alias("p90"), "markets", style.alias("style"))


QUERIES = {f.__name__: f for f in (cal_walk_forward_trained, det_adaptive_thresholds, ts_incremental_volume, class_profiles)}

_NAMES = ("accuracy", "precision", "recall", "f1")


def _moved_sql(rule: feedback.Rule, value: str, last: str) -> str:
    """The value after a rule, from SQL for the value before and for the day of the rule's last move."""
    fires = f"{rule.metric} {'>=' if rule.trigger >= 0 else '<='} {rule.trigger} AND ({last} IS NULL OR day - {last} >= {rule.rest})"
    after = f"least(greatest({value} * (1 + {rule.percent} / 100), {FIRST * (1 + rule.low / 100)}), {FIRST * (1 + rule.high / 100)})"
    return f"CASE WHEN {fires} THEN {after} ELSE {value} END"


_Z = lambda c: f"CASE WHEN count({c}) OVER w >= {NEEDED} THEN round(CASE WHEN stddev_pop({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w ELSE 0 END, 6) END"
_STEP = lambda i, value: _moved_sql(RULES[i - 1], value, f"l{i}")
_MOVED = lambda i, a, b: f"CASE WHEN {a} != {b} THEN day ELSE l{i} END AS l{i}"

ORACLE_SQL = {
    "cal_walk_forward_trained": t.sql(
        "fills markets",
        f""",f AS (SELECT fills.*, category, (SELECT min(ts_ms) FROM fills JOIN markets USING (market)) AS lo, (SELECT max(ts_ms) FROM fills JOIN markets USING (market)) AS hi FROM fills JOIN markets USING (market)),
        k AS (SELECT category, side, floor(usd / {STEP_USD}) AS step, win, (ts_ms - lo) // {WINDOW_DAYS * t.DAY} AS k, least((hi - lo) // {t.DAY} // {WINDOW_DAYS} - 1, {FOLDS}) AS folds FROM f),
        e AS (SELECT *, k AS fold, 'train' AS part FROM k UNION ALL SELECT *, k - 1, 'test' FROM k),
        c AS (SELECT fold, part, category, side, step, count(*) AS n, count(*) FILTER (win) AS wins FROM e WHERE fold >= 0 AND fold < folds GROUP BY ALL),
        b AS (SELECT fold, sum(wins) / sum(n) AS base FROM c WHERE part = 'train' GROUP BY fold),
        s AS (SELECT c.*, round((coalesce(y.wins, 0) + {PRIOR} * base) / (coalesce(y.n, 0) + {PRIOR}), 6) AS p FROM c JOIN b USING (fold) LEFT JOIN (SELECT * FROM c WHERE part = 'train') y ON c.fold = y.fold AND c.category = y.category AND c.side = y.side AND c.step = y.step),
        h AS (SELECT fold, threshold, part, sum(n) AS n, sum(CASE WHEN p >= threshold THEN wins ELSE 0 END) AS tp, sum(CASE WHEN p >= threshold THEN n - wins ELSE 0 END) AS fp, sum(CASE WHEN p < threshold THEN wins ELSE 0 END) AS fn
            FROM s, (SELECT unnest([{", ".join(map(str, THRESHOLDS))}]::DOUBLE[]) AS threshold) GROUP BY ALL),
        m AS (SELECT *, (n - fp - fn) / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM h),
        best AS (SELECT fold, threshold FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, threshold) AS i FROM m WHERE part = 'train') WHERE i = 1)
        SELECT fold, threshold, a.n::BIGINT AS train_n, z.n::BIGINT AS test_n, {", ".join(f"round({x}.{c}, 5) AS {part}_{c}" for x, part in (("a", "train"), ("z", "test")) for c in _NAMES)},
            round(({" + ".join(f"abs(a.{c} - z.{c})" for c in _NAMES)}) / 4, 5) AS overfitting
        FROM best JOIN (SELECT * FROM m WHERE part = 'train') a USING (fold, threshold) JOIN (SELECT * FROM m WHERE part = 'test') z USING (fold, threshold)""",
    ),
    "det_adaptive_thresholds": "WITH RECURSIVE "
    + t.SQL["trades"]
    + f""", v AS (SELECT market, ts_ms // {t.DAY} AS day, sum(usd) AS volume, count(*)::DOUBLE AS trades FROM trades GROUP BY ALL),
    d AS (SELECT market, day, {_Z("volume")} AS z_volume, {_Z("trades")} AS z_trades, row_number() OVER (PARTITION BY market ORDER BY day) AS i FROM v WINDOW w AS (PARTITION BY market ORDER BY day ROWS BETWEEN {BACK} PRECEDING AND 1 PRECEDING)),
    s AS (SELECT DISTINCT market, 0::BIGINT AS i, 0::BIGINT AS day, {FIRST}::DOUBLE AS v0, {FIRST}::DOUBLE AS v1, {FIRST}::DOUBLE AS v2, {FIRST}::DOUBLE AS v3, NULL::BIGINT AS l1, NULL::BIGINT AS l2, NULL::BIGINT AS l3 FROM d
        UNION ALL SELECT market, i, day, v0, v1, v2, v3, {_MOVED(1, "v0", "v1")}, {_MOVED(2, "v1", "v2")}, {_MOVED(3, "v2", "v3")} FROM
        (SELECT *, {_STEP(3, "v2")} AS v3 FROM (SELECT *, {_STEP(2, "v1")} AS v2 FROM (SELECT *, {_STEP(1, "v0")} AS v1 FROM
            (SELECT d.market, d.i, d.day, d.z_volume, d.z_trades, s.v3 AS v0, s.l1, s.l2, s.l3 FROM s JOIN d ON d.market = s.market AND d.i = s.i + 1))))),
    moves AS (SELECT market, day, 'surge' AS rule, v0 AS before, v1 AS after FROM s WHERE v0 != v1 UNION ALL SELECT market, day, 'quiet', v1, v2 FROM s WHERE v1 != v2 UNION ALL SELECT market, day, 'crowd', v2, v3 FROM s WHERE v2 != v3)
    SELECT market, day, rule, round(before, 5) AS before, round(after, 5) AS after FROM moves""".replace("round(", "round(1e-7 + "),
    "ts_incremental_volume": t.sql("trades", f"SELECT market, ts_ms // {t.HOUR} * {t.HOUR} AS hour, count(*) AS n, round(sum(usd), 3) AS usd, max(usd) AS most FROM trades GROUP BY ALL"),
    "class_profiles": t.sql(
        "trades",
        f""",b AS (SELECT *, CASE WHEN usd > 0 THEN floor(ln(usd) / ln({profiles.GROWTH}) + 1e-9)::INT ELSE -10000 END AS bin FROM trades),
        k AS (SELECT wallet, bin, count(*) AS k FROM b GROUP BY ALL), c AS (SELECT wallet, bin, sum(k) OVER (PARTITION BY wallet ORDER BY bin) AS upto, sum(k) OVER (PARTITION BY wallet) AS total FROM k),
        q AS (SELECT wallet, min(bin) FILTER (upto >= total * 0.5) AS b50, min(bin) FILTER (upto >= total * 0.9) AS b90 FROM c GROUP BY wallet),
        a AS (SELECT wallet, count(*) AS n, count(DISTINCT ts_ms // {t.DAY}) AS days, avg(usd) AS mean, stddev_pop(usd) AS deviation, min(usd) AS low, max(usd) AS high, count(DISTINCT market) AS markets, count(*) / greatest((max(ts_ms) - min(ts_ms)) / {t.DAY}, 1.0) AS pace FROM trades GROUP BY wallet),
        v AS (SELECT *, CASE WHEN b50 = -10000 THEN 0 ELSE pow({profiles.GROWTH}, b50 + 0.5) END AS median, CASE WHEN b90 = -10000 THEN 0 ELSE pow({profiles.GROWTH}, b90 + 0.5) END AS p90 FROM a JOIN q USING (wallet))
        SELECT wallet, n, days, round(mean, 4) AS mean, round(deviation, 4) AS deviation, low, high, round(median, 4) AS median, round(p90, 4) AS p90, markets,
            CASE WHEN pace >= 4 THEN 'busy' WHEN pace >= 1.5 THEN 'steady' ELSE 'rare' END || '-' || CASE WHEN p90 >= 120 THEN 'large' WHEN p90 >= 60 THEN 'medium' ELSE 'small' END AS style FROM v""",
    ),
}
