"""What makes many rows is shuffled packed and once, with the same results."""

import random
import re

from pyspark.sql import functions as F

from tidewatch.operators import graph
from tidewatch.plans import relations


def exchanges(df):
    return re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_near_trades_are_counted_without_a_shuffle_by_trade(spark, sf_dir):
    assert not any("trade" in x for x in exchanges(relations.pair_timing(spark, sf_dir)))


def test_reach_is_shuffled_by_start_alone_and_takes_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "PIECE", 3)
    rng = random.Random(7)
    pairs = sorted({(rng.randrange(40), rng.randrange(25)) for _ in range(120)} | {(s, 1) for s in range(30)})
    edges = spark.createDataFrame([*pairs, (None, 2)], "source long, target long")
    out = graph.reach(edges, spark.createDataFrame([(i,) for i in (0, 1, 2, 3)], "start long"), 3)
    assert not any("start" in x and "node" in x for x in exchanges(out))
    want = {}
    for start in range(4):
        level = {start}
        want[start, start] = 0
        for d in (1, 2, 3):
            level = {s for s, t in [*pairs, (None, 2)] if t in level} - {n for s, n in want if s == start}
            want |= {(start, n): d for n in level}
    assert {(r.start, r.node): r.depth for r in out.collect()} == want


def test_pairs_of_rare_keys_travel_by_one_item(spark):
    rows = spark.createDataFrame([(i, k) for k in range(60) for i in range(k % 7, 90, 7)], "item long, key long")
    got = graph.shared_pairs(rows, "item", "key", 2)
    by_pair = [x for x in exchanges(got) if [k.split("#")[0] for k in x.split(", ")[:-1]] == ["a", "b"]]
    assert len(by_pair) <= 1
    assert got.count() == sum(len(m) * (len(m) - 1) // 2 for m in (range(k, 90, 7) for k in range(7)))


def test_keys_a_little_over_common_are_rare_if_they_make_few_pairs(spark):
    kept = spark.createDataFrame([(i, k, n) for k, n in [*((k, 30) for k in range(50)), (50, 45), (51, 161)] for i in range(n)], "_i long, _k long, _n long")
    assert graph._rare(kept, 40)[0] == 45
    crowded = spark.createDataFrame([(i, k, 60) for k in range(50) for i in range(60)], "_i long, _k long, _n long")
    assert graph._rare(crowded, 40) == (40, 0.0)
    assert graph.shared_pairs(kept.select("_i", "_k").filter(F.col("_k") > 50), "_i", "_k", 1, 40).count() == 161 * 160 // 2
