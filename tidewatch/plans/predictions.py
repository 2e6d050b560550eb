"""How sure findings are, and predictions from weighted features."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as t
from ..functions import stats
from ..operators import prediction
from ..operators.graph import shared_checkpoints
from ..operators.prediction import Feature

r = stats.rounded
# Weights of the factors of confidence; the last three have no data of their own but the third.
FACTORS = {"sample": 0.25, "freshness": 0.15, "completeness": 0.15, "consistency": 0.2, "validation": 0.1, "cross": 0.05, "stability": 0.05, "reliability": 0.05}
ENOUGH, FRESH_HOURS, UNKNOWN = 30, 24, 50.0
#: Trades from which on a wallet's record in a market counts as validated, and as a source of known reliability.
VALIDATED, KNOWN = 20, 10
FEATURES = [Feature("size", 0.25, True, 0.8), Feature("wins", 0.3, True, 0.6), Feature("spread", 0.15, False, 0.3), Feature("funding", 0.15, True, 0.2), Feature("age", 0.15, False, 0.5)]
PLATT = (-6.0, 3.0)
# Weights of what is known of a market's trades in the logit of its outcome.
OUTCOME = {"bullish": 0.15, "strength": 0.10, "strongest": 0.08, "confidence": 0.08, "recent": 0.12, "volume": 0.06, "insiders": 0.12, "whales": 0.04}
TEMPERATURE, HALF_LIFE_DAYS = 0.8, 180


def _steps(value, steps, otherwise):
    """The points of the first bound that the value doesn't exceed."""
    out = F.lit(otherwise)
    for bound, points in reversed(steps):
        out = F.when(value <= bound, points).otherwise(out)
    return out


def score_confidence_levels(spark, sf):
    """How sure a finding on a wallet is: its record in each market is a signal, judged by size, age, completeness,
    agreement of the signals, validation and reliability."""
    e = t.trades(spark, sf)
    now = F.broadcast(e.agg(F.max("ts_ms").alias("now")))  # one row
    s = e.groupBy("wallet", "market").agg(F.count("*").alias("n"), F.max("ts_ms").alias("last"), F.avg((F.col("side") == "BUY").cast("double")).alias("buys"), F.avg(F.col("size").isNotNull().cast("double")).alias("full"), F.countDistinct(F.floor(F.col("ts_ms") / t.HOUR) % 24).alias("hours"))
    s = s.crossJoin(now).withColumn("age", (F.col("now") - F.col("last")) / t.HOUR)
    a = s.groupBy("wallet").agg(
        F.count("*").alias("signals"), F.sum("n").alias("n"), F.avg("age").alias("age"), r(F.avg(F.col("full") * 100), 6).alias("full"), r(F.stddev_pop(F.col("buys") * 100), 6).alias("spread"),
        F.avg((F.col("n") >= VALIDATED).cast("double")).alias("valid"), r(F.avg(F.when(F.col("n") >= KNOWN, F.col("hours") / 24 * 100)), 6).alias("reliable"),
    )
    n, age = F.col("n"), F.col("age")
    points = {
        "sample": F.when(n < 5, 15.0).when(n < 10, 35.0).when(n < ENOUGH, 40 + n / ENOUGH * 30).when(n < 2 * ENOUGH, 80.0).otherwise(95.0),
        "freshness": _steps(age, [(1, 100.0), (FRESH_HOURS / 4, 90.0), (FRESH_HOURS / 2, 75.0), (FRESH_HOURS, 55.0), (2 * FRESH_HOURS, 35.0)], 15.0),
        "completeness": F.when(F.col("full") >= 100, 100.0).when(F.col("full") >= 90, 90.0).when(F.col("full") >= 75, 70.0).when(F.col("full") >= 50, 45.0).otherwise(20.0),
        "consistency": F.when(F.col("signals") == 1, 50.0).when(F.col("spread") < 5, 100.0).when(F.col("spread") < 10, 85.0).when(F.col("spread") < 15, 70.0).when(F.col("spread") < 25, 50.0).when(F.col("spread") < 35, 30.0).otherwise(15.0),
        "validation": F.when(F.col("valid") >= 0.8, 95.0).when(F.col("valid") >= 0.5, 70.0).when(F.col("valid") > 0, 40.0).otherwise(20.0),
        "reliability": F.when(F.col("reliable").isNull(), UNKNOWN).when(F.col("reliable") >= 90, 95.0).when(F.col("reliable") >= 75, 80.0).when(F.col("reliable") >= 50, 55.0).otherwise(30.0),
    }
    score = sum((points.get(k, F.lit(UNKNOWN)) * w for k, w in FACTORS.items()), F.lit(0.0))
    out = a.select("wallet", "signals", "n", *[p.alias(k) for k, p in points.items()], r(score, 4).alias("score"))
    return out.withColumn("level", stats.ladder(F.col("score"), [(80, "very_high"), (60, "high"), (40, "medium"), (20, "low")], "very_low")).withColumn("sample", r("sample", 4))


def score_insider_predictions(spark, sf):
    """The probability that a wallet knows more than others, from features that may be missing, and what decided it."""
    f = t.fills(spark, sf)
    by_source = f.groupBy("wallet", "counterparty").agg(F.count("*").alias("k"), F.max("usd").alias("most"), F.sum(F.col("win").cast("long")).alias("wins"), F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"))
    a = by_source.groupBy("wallet").agg(F.sum("k").alias("n"), F.max("k").alias("top"), F.max("most").alias("most"), F.sum("wins").alias("w"), F.min("first").alias("first"), F.max("last").alias("last"))
    m = f.groupBy("wallet").agg(F.countDistinct("market").alias("markets")).select(F.col("wallet").alias("_w"), "markets")
    years = (F.col("last") - F.col("first")) / (5 * 365 * t.DAY)
    some = F.col("n") >= 5
    rows = a.join(m, F.col("wallet") == F.col("_w")).select(
        "wallet", F.least(F.col("most") / 100_000, F.lit(1.0)).alias("size"), F.when(some, F.col("w") / F.col("n")).alias("wins"), (F.col("markets") / F.col("n")).alias("spread"),
        F.when(some, F.col("top") / F.col("n")).alias("funding"), F.when(F.col("n") > 1, F.least(years, F.lit(1.0))).alias("age"),
    )
    out = prediction.judged(rows, "wallet", FEATURES)
    level = stats.ladder(F.col("confidence") + 1e-9, [(0.8, "very_high"), (0.6, "high"), (0.4, "medium"), (0.2, "low")], "very_low")
    return out.select("wallet", r("raw", 6).alias("raw"), r(prediction.platt(F.col("raw"), *PLATT), 6).alias("probability"), r(prediction.tempered(F.col("raw"), TEMPERATURE), 6).alias("tempered"), r("confidence", 6).alias("confidence"), level.alias("level"), "standing_out", F.get("factors", F.lit(0)).alias("first_factor"))


def _market_sums(fills, to_ms):
    """Sums of each market's fills in one pass; recent and weight are decayed from to_ms on."""
    decay = F.exp(-F.lit(0.6931471805599453) * ((F.lit(to_ms) - F.col("ts_ms")) / t.DAY) / HALF_LIFE_DAYS)
    share = lambda c: F.avg(c.cast("double"))
    return fills.groupBy("market").agg(
        F.count("*").alias("k"), share(F.col("side") == "BUY").alias("bullish"), F.avg("usd").alias("mean"), F.max("usd").alias("largest"), share(F.col("win")).alias("confidence"), F.sum(F.col("win").cast("double")).alias("wins"),
        F.sum(decay * F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)).alias("signed"), F.sum(decay).alias("weight"), share(F.col("win") & (F.col("usd") >= 50_000)).alias("insiders"), share(F.col("usd") >= 60_000).alias("whales"), F.max("ts_ms").alias("last"),
    )


def score_outcome_probability(spark, sf):
    """The probability of a market's good end from its trades, its category's record as the prior.

    Fills are summed by market before anything else, once, and only these sums meet the markets. The share of recent
    trades is the same from whatever instant weights are taken, so the last line item's will do; only if the markets'
    own trades end so much earlier that weights would vanish are they summed again, from their own last instant.
    """
    shared_checkpoints(spark)
    f, kinds = t.fills(spark, sf), t.markets(spark, sf).groupBy("market", "category").agg(F.count("*").alias("times"))
    now = t.line_ends(spark, sf)[1] or 0
    a = _market_sums(f, now).join(kinds, "market").checkpoint()
    last, top = a.agg(F.max("last"), F.max("largest")).first()
    if last is not None and now - last > 100 * HALF_LIFE_DAYS * t.DAY:
        a = _market_sums(f, last).join(kinds, "market").checkpoint()
    part = lambda c: F.try_divide(F.col(c), F.lit(top).cast("double"))
    n = F.col("k") * F.col("times")
    a = a.select(
        "category", "market", "bullish", part("mean").alias("strength"), part("largest").alias("strongest"), "confidence", F.try_divide("signed", "weight").alias("recent"), F.least(n / 50, F.lit(1.0)).alias("volume"), "insiders", "whales", (F.col("wins") * F.col("times")).alias("won"), n.alias("n"),
    )
    prior = a.groupBy(F.col("category").alias("_category")).agg((F.sum("won") / F.sum("n")).alias("prior"))
    both = a.join(F.broadcast(prior), F.col("category").eqNullSafe(F.col("_category")))  # a row a category
    p = prediction.outcome_probability({k: (F.col(k), w) for k, w in OUTCOME.items()}, F.col("prior"), 0.0, TEMPERATURE)
    return both.select("market", "category", "n", r("recent", 5).alias("recent"), r("prior", 6).alias("prior"), r(p, 5).alias("probability"))


QUERIES = {f.__name__: f for f in (score_confidence_levels, score_insider_predictions, score_outcome_probability)}

_VALUE = {f.name: f.name if f.more else f"(1 - {f.name})" for f in FEATURES}
_THERE = lambda body, none="0": " + ".join(f"CASE WHEN {f.name} IS NOT NULL THEN {body(f)} ELSE {none} END" for f in FEATURES)

ORACLE_SQL = {
    "score_confidence_levels": t.sql(
        "trades",
        f""",s AS (SELECT wallet, market, count(*) AS n, ((SELECT max(ts_ms) FROM trades) - max(ts_ms)) / 3600000 AS age, avg((side = 'BUY')::INT) AS buys, avg((size IS NOT NULL)::INT) AS "full", count(DISTINCT ts_ms // 3600000 % 24) AS hours FROM trades GROUP BY ALL),
        a AS (SELECT wallet, count(*) AS signals, sum(n)::BIGINT AS n, avg(age) AS age, round(avg("full" * 100), 6) AS "full", round(stddev_pop(buys * 100), 6) AS spread, avg((n >= {VALIDATED})::INT) AS valid, round(avg(CASE WHEN n >= {KNOWN} THEN hours / 24 * 100 END), 6) AS reliable FROM s GROUP BY wallet),
        p AS (SELECT wallet, signals, n, CASE WHEN n < 5 THEN 15 WHEN n < 10 THEN 35 WHEN n < 30 THEN 40 + n / 30 * 30 WHEN n < 60 THEN 80 ELSE 95 END::DOUBLE AS sample,
            CASE WHEN age <= 1 THEN 100 WHEN age <= 6 THEN 90 WHEN age <= 12 THEN 75 WHEN age <= 24 THEN 55 WHEN age <= 48 THEN 35 ELSE 15 END AS freshness,
            CASE WHEN "full" >= 100 THEN 100 WHEN "full" >= 90 THEN 90 WHEN "full" >= 75 THEN 70 WHEN "full" >= 50 THEN 45 ELSE 20 END AS completeness,
            CASE WHEN signals = 1 THEN 50 WHEN spread < 5 THEN 100 WHEN spread < 10 THEN 85 WHEN spread < 15 THEN 70 WHEN spread < 25 THEN 50 WHEN spread < 35 THEN 30 ELSE 15 END AS consistency,
            CASE WHEN valid >= 0.8 THEN 95 WHEN valid >= 0.5 THEN 70 WHEN valid > 0 THEN 40 ELSE 20 END AS validation,
            CASE WHEN reliable IS NULL THEN 50 WHEN reliable >= 90 THEN 95 WHEN reliable >= 75 THEN 80 WHEN reliable >= 50 THEN 55 ELSE 30 END AS reliability FROM a),
        z AS (SELECT *, round({" + ".join(f"{w} * {k if k not in ('cross', 'stability') else 50}" for k, w in FACTORS.items())}, 4) AS score FROM p)
        SELECT * REPLACE (round(sample, 4) AS sample), CASE WHEN score >= 80 THEN 'very_high' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' WHEN score >= 20 THEN 'low' ELSE 'very_low' END AS level FROM z""",
    ),
    "score_insider_predictions": t.sql(
        "fills",
        f""",c AS (SELECT wallet, max(k) AS top FROM (SELECT wallet, counterparty, count(*) AS k FROM fills GROUP BY ALL) GROUP BY wallet),
        a AS (SELECT wallet, count(*) AS n, max(usd) AS most, avg(win::INT) AS w, count(DISTINCT market) AS m, (max(ts_ms) - min(ts_ms)) / {5 * 365 * t.DAY} AS years FROM fills GROUP BY wallet),
        f AS (SELECT wallet, least(most / 100000, 1) AS size, CASE WHEN n >= 5 THEN w END AS wins, m / n AS spread, CASE WHEN n >= 5 THEN top / n END AS funding, CASE WHEN n > 1 THEN least(years, 1) END AS age FROM a JOIN c USING (wallet)),
        s AS (SELECT *, ({_THERE(lambda f: f"{_VALUE[f.name]} * {f.weight}")}) / ({_THERE(lambda f: str(f.weight))}) AS raw, (({_THERE(lambda f: "1")}) / {len(FEATURES)} + ({_THERE(lambda f: str(f.weight))}) / {sum(f.weight for f in FEATURES)}) / 2 AS confidence,
            {_THERE(lambda f: f"({_VALUE[f.name]} >= {f.stands_out})::INT")} AS standing_out,
            list_sort([{", ".join(f"{{'c': -round({_VALUE[f.name]} * {f.weight}, 9), 'n': '{f.name}'}}" for f in FEATURES)}]) AS x FROM f)
        SELECT wallet, round(raw, 6) AS raw, round(1 / (1 + exp({PLATT[0]} * raw + {PLATT[1]})), 6) AS probability, round(1 / (1 + exp(-ln(raw / (1 - raw + 1e-10)) / {TEMPERATURE})), 6) AS tempered, round(confidence, 6) AS confidence,
            CASE WHEN confidence + 1e-9 >= 0.8 THEN 'very_high' WHEN confidence + 1e-9 >= 0.6 THEN 'high' WHEN confidence + 1e-9 >= 0.4 THEN 'medium' WHEN confidence + 1e-9 >= 0.2 THEN 'low' ELSE 'very_low' END AS level, standing_out, list_filter(x, lambda y: y.c IS NOT NULL)[1].n AS first_factor FROM s""",
    ).replace("-round(1e-7 + ", "-round("),
    "score_outcome_probability": t.sql(
        "fills markets",
        f""",f AS (SELECT fills.*, category, (SELECT max(ts_ms) FROM fills JOIN markets USING (market)) AS now, (SELECT max(usd) FROM fills JOIN markets USING (market)) AS top FROM fills JOIN markets USING (market)),
        d AS (SELECT *, exp(-0.6931471805599453 * ((now - ts_ms) / {t.DAY}) / {HALF_LIFE_DAYS}) AS decay, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END AS sign FROM f),
        a AS (SELECT category, market, avg((side = 'BUY')::INT) AS bullish, avg(usd / top) AS strength, max(usd / top) AS strongest, avg(win::INT) AS confidence, sum(decay * sign) / sum(decay) AS recent, least(count(*) / 50, 1) AS volume,
            avg((win AND usd >= 50000)::INT) AS insiders, avg((usd >= 60000)::INT) AS whales, sum(win::INT) AS won, count(*) AS n FROM d GROUP BY ALL),
        b AS (SELECT *, sum(won) OVER (PARTITION BY category) / sum(n) OVER (PARTITION BY category) AS prior FROM a)
        SELECT market, category, n, round(recent, 5) AS recent, round(prior, 6) AS prior, round(1 / (1 + exp(-({" + ".join(f"{w} * {k}" for k, w in OUTCOME.items())} + ln(prior / (1 - prior + 1e-10))) / {TEMPERATURE})), 5) AS probability FROM b""",
    ),
}
