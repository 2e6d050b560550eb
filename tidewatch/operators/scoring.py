"""Composite scores, calibration and back-tests as aggregations over long tables of signals or outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import clamp, half_up


def composite(signals: DataFrame, key: str, weights: Mapping[str, float], least: int, high: float = 60.0, boost: float = 0.05, cap: float = 1.25) -> DataFrame:
    """(key, signals, raw, boosted): the weighted mean of at least `least` signals from 0 to 100, raised by `boost` for
    each of the high ones after the second. signals: (key, signal, value); signals without a weight are not used."""
    rows = [(k, float(v)) for k, v in weights.items()]
    table = signals.sparkSession.createDataFrame(rows, "signal string, weight double")
    j = signals.join(table, "signal").filter("value is not null")
    a = j.groupBy(key).agg(F.count("*").alias("signals"), F.try_divide(F.sum(F.col("value") * F.col("weight")), F.sum("weight")).alias("raw"), F.count_if(F.col("value") >= high).alias("n_high")).filter(F.col("signals") >= least)
    factor = F.when(F.col("n_high") >= 3, F.least(1 + boost * (F.col("n_high") - 2), F.lit(cap))).otherwise(1.0)
    return a.select(key, "signals", "raw", clamp(half_up(F.col("raw") * factor + 1e-9), 0, 100).cast("long").alias("boosted"))


def time_decay(hours: Column, after: float = 24.0, rate: float = 0.005, floor: float = 0.5) -> Column:
    return F.when(hours <= after, 1.0).otherwise(F.greatest(1 - rate * (hours - after), F.lit(floor)))


def calibration(rows: DataFrame, p: str, y: str) -> DataFrame:
    """One row: n, Brier score (1 without rows), log loss and base rate of predictions p of outcomes y (0 or 1)."""
    q = clamp(F.col(p), 1e-15, 1 - 1e-15)
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))), F.lit(1.0)).alias("brier"), (-F.avg(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))).alias("log_loss"), F.avg(F.col(y).cast("double")).alias("rate"))


def reliability(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(bin, n, predicted, observed), zero-filled; 1.0 belongs to the last bin."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long")
    a = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"))
    return rows.sparkSession.range(bins).select(F.col("id").alias("bin")).join(a, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "predicted", "observed")


def auc(rows: DataFrame, score: str, y: str, chunks: int = 1000) -> DataFrame:
    """One row: the chance that a positive scores above a negative, ties half, from counts of equal scores.

    Rows are first reduced to one a score; scores are summed in `chunks` steps of their range and within each.
    """
    by = rows.groupBy(F.col(score).alias("at")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    ends = by.agg(F.min("at").alias("low"), F.max("at").alias("high"))
    step = F.coalesce(F.floor(F.try_divide(F.col("at") - F.col("low"), F.col("high") - F.col("low")) * chunks), F.lit(0))
    by = by.crossJoin(F.broadcast(ends)).withColumn("step", step)  # one row
    whole = F.coalesce(F.sum("all").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = by.groupBy("step").agg(F.sum("neg").alias("all")).select("step", whole.alias("before"))
    within = F.coalesce(F.sum("neg").over(Window.partitionBy("step").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.col("before") + within
    a = by.join(sums, "step").withColumn("below", below).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return a.select(F.coalesce(F.try_divide("won", F.col("pos") * F.col("neg")), F.lit(0.5)).alias("auc"))


def confusion(rows: DataFrame, flag: Column, y: str) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1, f2 and Matthews' coefficient; 0 where undefined."""
    c = {"tp": flag & (F.col(y) == 1), "fp": flag & (F.col(y) == 0), "fn": ~flag & (F.col(y) == 1), "tn": ~flag & (F.col(y) == 0)}
    a = rows.agg(*[F.count_if(v).alias(k) for k, v in c.items()])
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    a = a.withColumns({"precision": zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))), "recall": zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))})
    f = lambda b: zero(F.try_divide((1 + b * b) * F.col("precision") * F.col("recall"), b * b * F.col("precision") + F.col("recall")))
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    mcc = zero(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))))
    return a.withColumns({"f1": f(1), "f2": f(2), "mcc": mcc})


def best_threshold(rows: DataFrame, score: str, y: str, grid: Sequence[float]) -> DataFrame:
    """(threshold, f1) of each threshold of a short grid, in one pass: each row meets each threshold, summed at once."""
    t = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("threshold")
    c = rows.groupBy(score, y).agg(F.count("*").alias("k")).select(score, y, "k", t)
    hit = F.col(score) >= F.col("threshold")
    a = c.groupBy("threshold").agg(F.sum(F.when(hit & (F.col(y) == 1), F.col("k")).otherwise(0)).alias("tp"), F.sum(F.when(hit & (F.col(y) == 0), F.col("k")).otherwise(0)).alias("fp"), F.sum(F.when(~hit & (F.col(y) == 1), F.col("k")).otherwise(0)).alias("fn"))
    return a.select("threshold", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"))


def mapped(p: Column, curve: Sequence[tuple[float, float]], a: float = -1.0, b: float = 0.0, temperature: float = 1.5, powers: tuple[float, float] = (1.2, 0.9)) -> dict[str, Column]:
    """A probability under each way of calibration: Platt's sigmoid, a temperature on the logit, the beta family, and a
    curve of ascending points, joined by straight lines."""
    logit = F.ln(p / (1 - p + 1e-10))
    up, down = F.pow(p, F.lit(powers[0])), F.pow(1 - p, F.lit(powers[1]))
    lines = [F.when(p <= x1, y0 + (p - x0) / (x1 - x0) * (y1 - y0)) for (x0, y0), (x1, y1) in zip(curve, curve[1:], strict=False)]
    return {"platt": 1 / (1 + F.exp(a * p + b)), "temperature": 1 / (1 + F.exp(-logit / temperature)), "beta": F.try_divide(up, up + down), "isotonic": F.coalesce(*lines, F.lit(float(curve[-1][1])))}


def contiguous_folds(rows: DataFrame, chunk: str, order: Sequence[str], k: int) -> DataFrame:
    """rows with `fold`, 0 to k - 1: runs of floor(n / k) rows in this order; the rows after the last run are dropped.

    chunk is a column that rises with the order. Rows are numbered within their chunk, and the counts of the chunks
    before are added, so that only one row a chunk is ever in one task.
    """
    counts = rows.groupBy(chunk).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(chunk).alias("_chunk"), before.alias("_before"), F.floor(F.sum("_n").over(Window.partitionBy(F.lit(1))) / k).alias("_size"))
    at = F.col("_before") + F.row_number().over(Window.partitionBy(chunk).orderBy(*order)) - 1
    placed = rows.join(starts, F.col(chunk).eqNullSafe(F.col("_chunk"))).withColumn("fold", F.floor(F.try_divide(at, F.col("_size"))))
    return placed.filter(F.col("fold") < k).drop("_chunk", "_before", "_size")


def signal_pairs(signals: DataFrame, key: str, pairs: Sequence[tuple[str, str, float, float]], least: float = 0.3, factor: float = 0.15) -> DataFrame:
    """(key, first, second, strength, boost) of each configured pair (first, second, level, weight) whose values both
    reach the level: the mean of how alike they are and of how far above it, 50 points being the most."""
    values = signals.filter("value is not null").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("signal", "value"))).alias("v"))
    each = F.array(*[F.struct(F.lit(f).alias("first"), F.lit(s).alias("second"), F.lit(float(at)).alias("level"), F.lit(float(w)).alias("weight")) for f, s, at, w in pairs])
    j = values.select(key, "v", F.inline(each)).select(key, "first", "second", "level", "weight", F.col("v")[F.col("first")].alias("a"), F.col("v")[F.col("second")].alias("b"))
    j = j.filter((F.col("a") >= F.col("level")) & (F.col("b") >= F.col("level")))
    most = F.greatest("a", "b")
    alike = F.when(most > 0, 1 - F.abs(F.col("a") - F.col("b")) / most).otherwise(0.0)
    above = F.least(F.lit(1.0), (F.col("a") + F.col("b") - 2 * F.col("level")) / 2 / 50)
    j = j.withColumn("strength", (above + alike) / 2)
    return j.select(key, "first", "second", "strength", F.when(F.col("strength") >= least, (F.col("a") + F.col("b")) / 2 * F.col("strength") * factor * F.col("weight")).otherwise(0.0).alias("boost"))
