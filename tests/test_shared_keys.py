"""Pairs by shared keys are made in their block's task: none is shuffled, and all are found whatever the blocks and pieces."""

import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch import tables
from tidewatch.operators import graph, shared


def _want(rows, least):
    held = {}
    for i, k in rows:
        if i is not None and k is not None:
            held.setdefault(i, set()).add(k)
    return {(a, b): n for a, b in itertools.combinations(sorted(held), 2) if (n := len(held[a] & held[b])) >= least}


def _exchanges(df):
    return re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_pairs_of_rare_keys_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_PAIRS", 50)
    rng = random.Random(3)
    rows = [(rng.randrange(80), rng.randrange(60)) for _ in range(500)] + [(None, 1), (4, None)]
    out = graph.shared_pairs(spark.createDataFrame(rows, "item long, key long"), "item", "key", 2)
    assert not any(re.match("[ab]#", x) for x in _exchanges(out))
    got = out.collect()
    assert {(r.a, r.b): r.shared for r in got} == _want(rows, 2) and len(got) == len(_want(rows, 2)) > 100


@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_common_smallest_key_does_not_make_one_block(spark, monkeypatch, kind):
    monkeypatch.setattr(graph, "BLOCK_PAIRS", 20)
    rng = random.Random(4)
    pairs = [(i, 0) for i in range(90)] + [(i, rng.randrange(1, 70)) for i in range(90) for _ in range(6)]
    rows = [(i, k if kind == "long" else f"k{k:02}") for i, k in pairs]
    df = spark.createDataFrame(rows, f"item long, key {kind}")
    assert {(r.a, r.b): r.shared for r in graph.shared_pairs(df, "item", "key", 2, 8).collect()} == _want(rows, 2)
    items = df.groupBy(F.col("item").alias("_i")).agg(F.collect_set("key").alias("keys"))
    placed = graph._placed(items, F.array_remove("keys", "k00" if kind == "string" else 0), 9)
    assert placed.select("block").distinct().count() >= 6


def test_pieces_of_an_item_with_many_pairs(monkeypatch):
    monkeypatch.setattr(shared, "PIECE_PAIRS", 3)
    rng = random.Random(9)
    rows = {(rng.randrange(12), k) for k in range(40) for _ in range(5)}
    block = lambda i: i % 3
    got = {}
    for b in range(3):
        cells = []
        for k in range(40):
            g = sorted((i for i, x in rows if x == k and block(i) >= b), key=lambda i: (block(i), i))
            cells.append((b, sum(block(i) == b for i in g), g, [0] * len(g)))
        types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int8())]
        batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cells, strict=True), types, strict=True)], ["block", "own", "items", "common"])
        for out in shared.counted(iter([batch]), 2):
            for r in out.to_pylist():
                assert (r["a"], r["b"]) not in got
                got[r["a"], r["b"]] = r["rare"]
    assert got == _want(rows, 2)


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_fills_of_some_wallets(spark, sf_dir, monkeypatch, most):
    monkeypatch.setattr(tables, "MOST_BROADCAST", most)
    graph.shared_checkpoints(spark)
    some = spark.range(3, 40, 2).withColumnRenamed("id", "wallet")
    all_of = tables.fills(spark, sf_dir).filter("wallet between 3 and 39 and wallet % 2 = 1")
    assert tables.fills(spark, sf_dir, some).exceptAll(all_of).isEmpty() and tables.fills(spark, sf_dir, some).count() == all_of.count() > 0
