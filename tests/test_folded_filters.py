"""Filters and rows that can't be told apart are looked up once, with the sums of all pairs."""

import random

from pyspark.sql import functions as F

from tidewatch.operators import predicates
from tidewatch.plans import tagging

CONDITION = "filter long, field string, kind string, any array<string>, low double, high double"


def test_filters_of_the_same_conditions_are_one_class(spark):
    conditions = [(1, "tag", "any", ["p", "q"], None, None), (1, "x", "range", None, 1.0, None), (2, "x", "range", None, 1.0, None), (2, "tag", "any", ["q", "p"], None, None), (3, "x", "range", None, None, 1.0), (4, "tag", "one", ["p", "q"], None, None)]
    filters = spark.createDataFrame([(f,) for f in range(7)], "filter long")
    got = {r.filter: r["class"] for r in predicates.alike(spark.createDataFrame(conditions, CONDITION), filters).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 0, 6: 0}


def test_many_filters_and_rows_alike_are_looked_up_once(spark, monkeypatch):
    rng = random.Random(5)
    alerts = [(rng.choice(["BUY", "SELL"]), rng.choice("kl"), rng.sample("pqr", 2), float(rng.randint(0, 40))) for _ in range(400)]
    kinds = [(rng.choice(["BUY", "SELL"]), rng.choice("pqr"), float(low := rng.randint(0, 30)), float(low + rng.randint(0, 3)) if rng.random() < 0.7 else None) for _ in range(6)]
    conditions = [c for f in range(120) for s, w, low, high in [kinds[f % 6]] for c in [(f, "side", "flag", [s], None, None), (f, "word", "any", [w], None, None), (f, "usd", "range", None, low, high)]]
    asked = []
    real = predicates.fits
    monkeypatch.setattr(predicates, "fits", lambda rows, *a: (asked.append((rows.count(), a[-1].count())), real(rows, *a))[1])
    frame = spark.createDataFrame(alerts, "side string, category string, words array<string>, usd double")
    filters = spark.createDataFrame([(f,) for f in range(121)], "filter long").filter("filter < 120")
    got = {r.filter: (r.n, r.usd) for r in tagging._matched(frame, spark.createDataFrame(conditions, CONDITION), filters).collect()}
    want = {}
    for f in range(120):
        side, word, low, high = kinds[f % 6]
        fits = [u for s, _, ws, u in alerts if s == side and word in ws and u >= low and (high is None or u <= high)]
        if fits:
            want[f] = (len(fits), sum(fits))
    assert got == want
    assert asked[0][1] == len({*kinds}) and asked[0][0] < len({(s, k, tuple(sorted(w)), u) for s, k, w, u in alerts})


def test_bounds_stand_alone(spark):
    conditions = spark.createDataFrame([(1, "x", "range", None, 1.0, 2.0)], CONDITION)
    rows = spark.createDataFrame([("a", x) for x in (0.5, 0.7, 1.0, 1.2, 1.7, 2.0, 2.1, 9.0, None)], "k string, x double")
    got = sorted((r.n, r.sum or 0.0) for r in predicates.folded(rows, ["k"], "x", "x", conditions).collect())
    assert got == [(1, 0.0), (1, 1.0), (1, 2.0), (2, 1.2), (2, 2.9), (2, 11.1)]
    assert predicates.folded(rows.select("k", F.col("x")), ["k"], "x", "x", conditions.limit(0)).count() == 2


def test_merged_filters_alike_are_one_class(spark):
    conditions = [(f, "x", "range", None, low, None) for f, low in ((1, 1.0), (2, 5.0), (3, 5.0), (4, 2.0), (5, 6.0), (6, 1.0))]
    groups = spark.createDataFrame([(10, 1), (10, 2), (20, 3), (20, 4), (30, 5), (30, 6)], "group long, filter long")
    both = predicates.merged(spark.createDataFrame(conditions, CONDITION), groups)
    got = predicates.alike(both, groups.select(F.col("group").alias("filter")).distinct()).collect()
    assert {r.filter: r["class"] for r in got} == {10: 10, 20: 10, 30: 30}


def test_places_between_bounds_are_plain_conditions(spark):
    bounds = [1.0, 2.0, 5.0, 9.0]
    rows = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 2.0, 3.0, 5.0, 9.0, 10.0)], "x double")
    place = predicates._between(F.col("x"), bounds)
    assert "lambda" not in place._jc.toString().lower()
    assert [r.p for r in rows.select("x", place.alias("p")).sort("x").collect()] == [0, 1, 2, 3, 4, 5, 7, 8]
    assert rows.select(predicates._between(F.col("x"), []).alias("p")).distinct().collect()[0].p == 0
