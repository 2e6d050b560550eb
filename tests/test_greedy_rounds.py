"""Greedy choices whose chains are as long as the rows: the loop's result in a few rounds."""

import random

import pytest

from tidewatch.operators import greedy


@pytest.fixture
def checkpoints(spark, monkeypatch):
    kind, made = type(spark.range(1)), []
    real = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, **b: (made.append(1), real(self, *a, **b))[1])
    return made


@pytest.mark.parametrize("seed", [1, 2])
def test_a_long_chain_of_windows_takes_few_rounds(spark, checkpoints, seed):
    rng, day = random.Random(seed), 100
    # windows end with each start and hold the day before it; they shrink, so that each that is kept waits for the one before
    at = sorted([int(2000 * (i / 400) ** (0.5 if seed == 1 else 1)) + rng.randint(0, 3) for i in range(400)])
    lo = [next(j for j, x in enumerate(at) if x >= t - day) for t in at]
    rows = [(lo[i], i, at[lo[i]], at[i]) for i in range(400) if i > lo[i]]
    got = greedy.disjoint_intervals(spark.createDataFrame(rows, "lo long, hi long, start long, end long"), 2, day).collect()
    used, want = set(), []
    for a, b, *_ in sorted(rows, key=lambda r: (r[0] - r[1], r[1])):
        if len(fresh := set(range(a, b + 1)) - used) >= 2:
            used |= fresh
            want.append((b, min(fresh), max(fresh)))
    assert sorted((r.hi, r.left, r.right) for r in got) == sorted(want)
    assert len(want) > 15
    assert len(checkpoints) <= 8


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_seeds_by_shared_keys_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = sorted({(n, rng.randint(0, 25 * seed)) for n in range(60) for _ in range(3)})
    of = {n: {k for m, k in rows if m == n} for n in range(60)}
    want = {}
    for n in range(60):
        if n not in want:
            want |= {m: n for m in range(60) if m not in want and of[m] & of[n]}
    got = greedy.first_seeds_by_key(spark.createDataFrame(rows, "node long, key long")).collect()
    assert sorted((r.node, r.seed) for r in got) == sorted(want.items())


def test_a_crowded_key_makes_no_pairs(spark):
    rows = spark.range(30_000).selectExpr("id AS node", "1 AS key")
    assert greedy.first_seeds_by_key(rows).filter("seed = 0").count() == 30_000
