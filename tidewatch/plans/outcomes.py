"""What predictions and signals came to: mapped probabilities, folds, decaying signals, signal pairs, regimes and trends."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import tables as t
from ..functions import stats
from ..operators import scoring
from .detectors import PREDICTED, predicted, signals

r = stats.rounded

#: Weight of a signal by its kind, hours in which a signal loses half its weight, hours that count at all.
KIND_WEIGHTS = {"whale_trade": 0.8, "volume_spike": 0.6}
HALF_LIFE, LOOK_BACK = 24, 168
#: Points of a calibration curve, from 0 to 1.
CURVE = ((0.0, 0.0), (0.3, 0.1), (0.7, 0.8), (1.0, 1.0))
#: Pairs of signals that matter together: least value of both, and weight.
PAIRS = (("win_rate", "size", 30.0, 1.0), ("focus", "lean", 20.0, 0.8), ("win_rate", "activity", 30.0, 0.9))
#: Z-scores at which a regime begins.
EXTREME, EXTREME_COUNT, VOLATILE, CALM, ACTIVE, QUIET, LEANING = 3.0, 2, 2.0, -1.5, 1.5, -1.5, 1.5


def cal_mapped(spark, sf):
    """Each predicted probability under four ways of calibration; equal predictions are mapped once."""
    p = predicted(spark, sf).groupBy("p").agg(F.count("*").alias("n"))
    m = scoring.mapped(F.col("p"), CURVE)
    return p.select("p", "n", *[r(c, 6).alias(k) for k, c in m.items()])


def cal_k_fold(spark, sf):
    """Accuracy of a fixed threshold in five contiguous folds of equal length in the order of time; the rest is dropped."""
    p = predicted(spark, sf).withColumn("day", F.floor(F.col("ts_ms") / t.DAY))
    folds = scoring.contiguous_folds(p, "day", ["ts_ms", "wallet", "order_id", "line", "p", "y"], 5)
    right = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")
    return folds.groupBy("fold").agg(F.count("*").alias("n"), r(F.avg(right), 6).alias("accuracy"), F.min("ts_ms").alias("first_ms"))


def cal_accuracy_trend(spark, sf):
    """Accuracy of a category against the mean of the first half of its 30-day points."""
    f = t.fills(spark, sf).join(t.markets(spark, sf).select("market", "category"), "market")
    right = F.count_if((F.col("usd") >= 55_000) == F.col("win"))
    points = f.groupBy("category", F.floor(F.col("ts_ms") / (30 * t.DAY)).alias("at")).agg(F.count("*").alias("n"), right.alias("hits"))
    by = Window.partitionBy("category")
    halved = points.withColumns({"nth": F.row_number().over(by.orderBy("at")), "points": F.count("*").over(by)})
    early = F.when(F.col("nth") <= F.floor(F.col("points") / 2), F.try_divide("hits", "n"))
    a = halved.groupBy("category").agg(F.count("*").alias("points"), F.try_divide(F.sum("hits"), F.sum("n")).alias("now"), F.coalesce(F.avg(early), F.lit(0.0)).alias("before"))
    change = r(F.col("now") - F.col("before"), 6)
    percent = F.when(F.col("before") > 0, (F.col("now") - F.col("before")) / F.col("before") * 100).otherwise(0.0)
    return a.select("category", "points", r("now", 6).alias("now"), r("before", 6).alias("before"), change.alias("change"), r(percent, 4).alias("percent"), F.when(change > 0.02, "up").when(change < -0.02, "down").otherwise("stable").alias("trend"))


def score_signal_decay(spark, sf):
    """Signals of a market's last week by direction; the score weighs strength, confidence and kind by age."""
    e = t.trades(spark, sf)
    e = e.crossJoin(F.broadcast(e.agg(F.max("ts_ms").alias("now"))))  # one row
    hours = (F.col("now") - F.col("ts_ms")) / t.HOUR
    kind = F.when(F.col("usd") >= 100, KIND_WEIGHTS["whale_trade"]).otherwise(KIND_WEIGHTS["volume_spike"])
    turn = F.when(F.col("size").isNull(), 0).when(F.col("side") == "BUY", 1).otherwise(-1)
    s = e.filter(hours <= LOOK_BACK).select("market", "usd", turn.alias("turn"), F.least(F.col("usd") / 200, F.lit(1.0)).alias("strength"), F.least(F.coalesce("size", F.lit(0.0)) / 100, F.lit(1.0)).alias("sure"), F.pow(F.lit(0.5), hours / HALF_LIFE).alias("w"), kind.alias("kind"))
    score = F.try_divide(F.sum(F.col("turn") * F.col("strength") * F.col("sure") * F.col("w") * F.col("kind")), F.sum("w"))
    counts = [F.count_if(F.col("turn") == v).alias(k) for k, v in (("bullish", 1), ("bearish", -1), ("neutral", 0))]
    return s.groupBy("market").agg(*counts, r(F.avg("strength"), 6).alias("strength"), r(F.max("strength"), 6).alias("strongest"), r(F.avg("sure"), 6).alias("confidence"), r(F.sum("usd"), 3).alias("usd"), r(score, 6).alias("score"))


def score_signal_pairs(spark, sf):
    """Pairs of a wallet's signals that both reach a level: how strongly they agree, and what that adds."""
    out = scoring.signal_pairs(signals(spark, sf), "wallet", PAIRS)
    level = stats.ladder(F.col("strength"), [(0.8, "very strong"), (0.6, "strong"), (0.4, "moderate"), (0.2, "weak")], "negligible")
    return out.select("wallet", "first", "second", r("strength", 6).alias("strength"), level.alias("level"), r("boost", 4).alias("boost"))


def det_regime(spark, sf):
    """Each day's regime from z-scores of its volume, price spread, wallets and lean to buying among all days."""
    f = t.fills(spark, sf)
    names = ("volume", "volatility", "traders", "sentiment")
    a = f.groupBy(F.floor(F.col("ts_ms") / t.DAY).alias("day")).agg(F.sum("usd").alias("volume"), F.stddev_pop("price").alias("volatility"), F.countDistinct("wallet").cast("double").alias("traders"), F.avg((F.col("side") == "BUY").cast("double")).alias("sentiment"))
    over = a.agg(*[x for n in names for x in (F.avg(n).alias(f"m_{n}"), F.stddev_pop(n).alias(f"s_{n}"))])
    z = a.crossJoin(F.broadcast(over)).select("day", *[r(stats.population_z(F.col(n), F.col(f"m_{n}"), F.col(f"s_{n}")), 6).alias(n) for n in names])  # one row
    extreme = sum((F.abs(n) >= EXTREME).cast("int") for n in names)
    activity = (F.col("volume") + F.col("traders")) / 2
    steps = [(extreme >= EXTREME_COUNT, "extreme"), (F.col("volatility") >= VOLATILE, "high volatility"), (F.col("volatility") <= CALM, "low volatility"), (activity >= ACTIVE, "high activity"), (activity <= QUIET, "low activity"), (F.col("sentiment") >= LEANING, "bull"), (F.col("sentiment") <= -LEANING, "bear")]
    regime = F.coalesce(*[F.when(c, n) for c, n in steps], F.lit("normal"))
    return z.select("day", *names, regime.alias("regime"))


def seq_wallet_context(spark, sf):
    """A wallet's context as of each of its trades: count, mean size, share of buys, large trades, share from 23 to 6 h."""
    e = t.trades(spark, sf).filter("usd is not null")
    hour = F.pmod(F.floor(F.col("ts_ms") / t.HOUR), F.lit(24))
    w = Window.partitionBy("wallet").orderBy("ts_ms", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda c: r(F.avg(c.cast("double")).over(w), 6)
    return e.select("trade_id", "wallet", F.count("*").over(w).alias("n"), r(F.avg("usd").over(w), 5).alias("mean"), share(F.col("side") == "BUY").alias("buys"), F.count_if(F.col("usd") >= 100).over(w).alias("large"), share((hour >= 23) | (hour < 6)).alias("off_hours"))


QUERIES = {f.__name__: f for f in (cal_mapped, cal_k_fold, cal_accuracy_trend, score_signal_decay, score_signal_pairs, det_regime, seq_wallet_context)}

_CURVE = " ".join(f"WHEN p <= {b}::DOUBLE THEN {fa}::DOUBLE + (p - {a}::DOUBLE) / ({b}::DOUBLE - {a}::DOUBLE) * ({fb}::DOUBLE - {fa}::DOUBLE)" for (a, fa), (b, fb) in zip(CURVE, CURVE[1:], strict=False))
_PAIRS = ", ".join(f"('{a}', '{b}', {least}::DOUBLE, {w}::DOUBLE)" for a, b, least, w in PAIRS)
_Z = ", ".join(f"round(CASE WHEN stddev_pop({n}) OVER () > 0 THEN ({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER () ELSE 0 END, 6) AS {n}" for n in ("volume", "volatility", "traders", "sentiment"))

ORACLE_SQL = {
    "cal_mapped": t.sql("fills", PREDICTED + f" SELECT p, count(*) AS n, round(1 / (1 + exp(-p)), 6) AS platt, round(1 / (1 + exp(-ln(p / (1 - p + 1e-10)) / 1.5)), 6) AS temperature, round(p ^ 1.2 / (p ^ 1.2 + (1 - p) ^ 0.9), 6) AS beta, round(CASE {_CURVE} END, 6) AS isotonic FROM q GROUP BY p"),
    "cal_k_fold": t.sql("fills", PREDICTED + ",k AS (SELECT *, (row_number() OVER (ORDER BY ts_ms, wallet, order_id, line, p, y) - 1) // (count(*) OVER () // 5) AS fold FROM q) SELECT fold, count(*) AS n, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy, min(ts_ms) AS first_ms FROM k WHERE fold < 5 GROUP BY fold"),
    "cal_accuracy_trend": t.sql("fills markets", """,a AS (SELECT category, ts_ms // (30 * 86400000::BIGINT) AS month, count(*)::DOUBLE AS n, count(*) FILTER ((usd >= 55000) = win)::DOUBLE AS hits FROM fills JOIN markets USING (market) GROUP BY ALL),
        h AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY month) AS nth, count(*) OVER (PARTITION BY category) AS points FROM a),
        c AS (SELECT category, count(*) AS points, sum(hits) / sum(n) AS now, coalesce(avg(hits / n) FILTER (nth <= points // 2), 0) AS before FROM h GROUP BY category),
        d AS (SELECT *, round(now - before, 6) AS change FROM c)
        SELECT category, points, round(now, 6) AS now, round(before, 6) AS before, change, round(CASE WHEN before > 0 THEN (now - before) / before * 100 ELSE 0 END, 4) AS percent, CASE WHEN change > 0.02 THEN 'up' WHEN change < -0.02 THEN 'down' ELSE 'stable' END AS trend FROM d"""),
    "score_signal_decay": t.sql("trades", f""",s AS (SELECT market, usd, CASE WHEN size IS NULL THEN 0 WHEN side = 'BUY' THEN 1 ELSE -1 END AS turn, least(usd / 200, 1) AS strength, least(coalesce(size, 0) / 100, 1) AS sure, 0.5::DOUBLE ^ ((now - ts_ms) / 3600000 / {HALF_LIFE}) AS w, CASE WHEN usd >= 100 THEN 0.8::DOUBLE ELSE 0.6 END AS kind
        FROM trades, (SELECT max(ts_ms) AS now FROM trades) WHERE (now - ts_ms) / 3600000 <= {LOOK_BACK})
        SELECT market, count(*) FILTER (turn = 1) AS bullish, count(*) FILTER (turn = -1) AS bearish, count(*) FILTER (turn = 0) AS neutral, round(avg(strength), 6) AS strength, round(max(strength), 6) AS strongest, round(avg(sure), 6) AS confidence, round(sum(usd), 3) AS usd, round(sum(turn * strength * sure * w * kind) / sum(w), 6) AS score FROM s GROUP BY market"""),
    "score_signal_pairs": t.sql("fills", f""",a AS (SELECT wallet, count(*) AS n, avg(win::INT) AS wins, max(usd) AS most, count(DISTINCT market) AS m, avg((side = 'BUY')::INT) AS buys FROM fills GROUP BY wallet),
        s AS (SELECT wallet, x.k AS k, x.v AS v FROM (SELECT wallet, unnest([{{'k': 'win_rate', 'v': round(wins * 100, 6)}}, {{'k': 'size', 'v': round(least(most / 1000, 100), 6)}}, {{'k': 'focus', 'v': round(100 - least(m / n * 50, 100), 6)}}, {{'k': 'lean', 'v': round(abs(buys - 0.5) * 200, 6)}}, {{'k': 'activity', 'v': CASE WHEN n >= 5 THEN round(least(n / 5, 100), 6) END}}]) AS x FROM a)),
        p AS (SELECT i.wallet, first, second, i.v AS a, j.v AS b, least, weight FROM (VALUES {_PAIRS}) z(first, second, least, weight) JOIN s i ON i.k = first JOIN s j ON j.k = second AND j.wallet = i.wallet WHERE i.v >= least AND j.v >= least),
        g AS (SELECT *, (least(1, (a - least + b - least) / 2 / 50) + CASE WHEN greatest(a, b) > 0 THEN 1 - abs(a - b) / greatest(a, b) ELSE 0 END) / 2 AS strength FROM p)
        SELECT wallet, first, second, round(strength, 6) AS strength, CASE WHEN strength >= 0.8 THEN 'very strong' WHEN strength >= 0.6 THEN 'strong' WHEN strength >= 0.4 THEN 'moderate' WHEN strength >= 0.2 THEN 'weak' ELSE 'negligible' END AS level, round(CASE WHEN strength >= 0.3 THEN (a + b) / 2 * strength * 0.15 * weight ELSE 0 END, 4) AS boost FROM g"""),
    "det_regime": t.sql("fills", f""",a AS (SELECT ts_ms // 86400000 AS day, sum(usd) AS volume, stddev_pop(price) AS volatility, count(DISTINCT wallet)::DOUBLE AS traders, avg((side = 'BUY')::INT) AS sentiment FROM fills GROUP BY 1),
        z AS (SELECT day, {_Z} FROM a)
        SELECT *, CASE WHEN (abs(volume) >= 3)::INT + (abs(volatility) >= 3)::INT + (abs(traders) >= 3)::INT + (abs(sentiment) >= 3)::INT >= 2 THEN 'extreme' WHEN volatility >= 2 THEN 'high volatility' WHEN volatility <= -1.5 THEN 'low volatility' WHEN (volume + traders) / 2 >= 1.5 THEN 'high activity' WHEN (volume + traders) / 2 <= -1.5 THEN 'low activity' WHEN sentiment >= 1.5 THEN 'bull' WHEN sentiment <= -1.5 THEN 'bear' ELSE 'normal' END AS regime FROM z"""),
    "seq_wallet_context": t.sql("trades", "SELECT trade_id, wallet, count(*) OVER w AS n, round(avg(usd) OVER w, 5) AS mean, round(avg((side = 'BUY')::INT) OVER w, 6) AS buys, count(*) FILTER (usd >= 100) OVER w AS large, round(avg((ts_ms // 3600000 % 24 >= 23 OR ts_ms // 3600000 % 24 < 6)::INT) OVER w, 6) AS off_hours FROM trades WHERE usd IS NOT NULL WINDOW w AS (PARTITION BY wallet ORDER BY ts_ms, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
}
