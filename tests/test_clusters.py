"""Linkage and greedy choices against their sequential loops."""

import itertools
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import greedy, linkage


def loop_of_linkage(rows, k):
    """rows: key -> levels. The closest two clusters merge, the first ones of equal distance, until k are left."""
    keys = sorted(rows)
    d = {(a, b): round(math.sqrt(sum((x - y) ** 2 for x, y in zip(rows[a], rows[b], strict=True))) / 1e-6) for a in keys for b in keys}
    clusters = [[key] for key in keys]
    mean = lambda x, y: Fraction(sum(d[a, b] for a in x for b in y), len(x) * len(y))
    while len(clusters) > k:
        _, i, j = min((mean(clusters[i], clusters[j]), i, j) for i, j in itertools.combinations(range(len(clusters)), 2))
        clusters[i] += clusters.pop(j)
    out = {}
    for c, members in enumerate(clusters):
        for key in members:
            if len(members) == 1 or len(clusters) == 1:
                out[key] = (c, None)
                continue
            a = sum(d[key, x] for x in members) / (len(members) - 1)
            b = min(sum(d[key, x] for x in other) / len(other) for other in clusters if other is not members)
            out[key] = (c, round((b - a) / max(a, b), 9) if max(a, b) else 0.0)
    return out


@pytest.mark.parametrize("seed,n,most,k", [(1, 40, 3, 4), (2, 60, 6, 3), (3, 25, 2, 1), (4, 50, 8, 7), (5, 12, 9, 12)])
@pytest.mark.parametrize("in_one_task", [2, 1000])
def test_linkage_equals_the_loop(spark, monkeypatch, seed, n, most, k, in_one_task):
    rng = random.Random(seed)
    rows = {i: [rng.randint(0, most), rng.randint(0, most)] for i in range(n)}
    if in_one_task == 2:
        if seed not in (1, 4):
            pytest.skip("two are enough for rounds of jobs")
        whole = linkage.average_links
        monkeypatch.setattr(linkage, "average_links", lambda pairs: whole(pairs, 8))
    frame = spark.createDataFrame([(i, x, "kept") for i, x in rows.items()], "key long, x array<int>, cluster_name string")
    distinct = len({tuple(x) for x in rows.values()})
    got = linkage.linked_clusters(frame, "key", F.col("x"), k).collect()
    want = loop_of_linkage(rows, k) if k <= distinct else None
    if want is None:
        assert len({r.cluster for r in got}) == distinct
        return
    assert {r.key: (r.cluster, None if r.silhouette is None else round(r.silhouette, 9)) for r in got} == want


def test_linkage_refuses_what_has_no_bound(spark, monkeypatch):
    monkeypatch.setattr(linkage, "MOST_POINTS", 3)
    with pytest.raises(ValueError, match="coarser"):
        linkage.linked_clusters(spark.createDataFrame([(i, [i]) for i in range(4)], "key long, x array<int>"), "key", F.col("x"), 2)


def loop_of_windows(windows, least):
    used, out = set(), []
    for lo, hi, *_ in sorted(windows, key=lambda w: (w[0] - w[1], w[1])):
        fresh = [x for x in range(lo, hi + 1) if x not in used]
        if len(fresh) >= least:
            out.append((lo, hi, fresh[0], fresh[-1]))
            used |= set(fresh)
    return sorted(out)


@pytest.mark.parametrize("seed,least", [(1, 2), (2, 2), (3, 4), (4, 1)])
def test_windows_equal_the_loop(spark, seed, least):
    rng, times = random.Random(seed), []
    t = 0
    for _ in range(250):
        t += rng.choice([0, 1, 3, 10, 45, 200])
        times.append(t)
    windows = []
    for hi, end in enumerate(times):
        lo = next(i for i, x in enumerate(times) if x >= end - 100)
        if hi > lo and rng.random() < 0.8:
            windows.append((lo, hi, times[lo], end))
    frame = spark.createDataFrame(windows, "lo long, hi long, start long, end long")
    got = greedy.disjoint_intervals(frame, least, 100).collect()
    assert sorted((r.lo, r.hi, r.left, r.right) for r in got) == loop_of_windows(windows, least)
    assert greedy.disjoint_intervals(frame.limit(0), least, 100).collect() == []


@pytest.mark.parametrize("seed,n,share", [(1, 60, 0.1), (2, 60, 0.4), (3, 30, 0.0)])
def test_seeds_equal_the_loop(spark, seed, n, share):
    rng = random.Random(seed)
    links = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < share]
    near = {x: {b if a == x else a for a, b in links if x in (a, b)} for x in range(n)}
    want = {}
    for x in range(n):
        if x not in want:
            want[x] = x
            want |= {y: x for y in near[x] if y not in want}
    got = greedy.first_seeds(spark.createDataFrame([(x,) for x in range(n)], "node long"), spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.seed for r in got.collect()} == want
