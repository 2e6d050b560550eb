"""Totals of anchored windows are those of their rows, without a row for each row and window."""

import random

from pyspark.sql import functions as F

from tidewatch.operators import sequences
from tidewatch.plans import detectors
from tidewatch.plans import sequences as plans


def test_totals_are_those_of_the_windows_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice("mn"), rng.choice([1, 2, 3, None]), rng.randrange(0, 400) // rng.choice([1, 10]) * 1, float(rng.randrange(50)), rng.choice(["BUY", "SELL"])) for _ in range(500)]
    frame = spark.createDataFrame([*rows, ("m", 1, None, 1.0, "BUY")], "market string, wallet long, ts_ms long, usd double, side string")
    for width, step in ((60, 10), (10, 10), (25, 10)):
        each = sequences.anchored_windows(frame, ["market"], width, step)
        want = each.groupBy("market", "window_start").agg(F.count("*").alias("n"), F.countDistinct("wallet").alias("wallets"), F.sum("usd").alias("usd"), F.count_if(F.col("side") == "BUY").alias("buys"))
        got = sequences.anchored_totals(frame, ["market"], width, step).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_row_for_each_trade_and_window(spark, sf_dir):
    for query in (plans.seq_sliding_windows, detectors.det_volume_clusters):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("Generate explode") :]
        assert "Aggregate [market" in below.split("Relation")[0].split("Window")[0]
