"""Density clusters against a plain reading, and without pairs of points in crowded cells."""

import math
import random

from tidewatch.operators import learning


def plain(points, eps, least):
    near = {k: [(math.hypot(x - u, y - v), m) for m, u, v in points if math.hypot(x - u, y - v) <= eps] for k, x, y in points}
    cores, root = {k for k in near if len(near[k]) >= least}, {}
    for k in sorted(cores):
        todo = [k] if k not in root else []
        while todo:
            if (c := todo.pop()) not in root:
                root[c] = k
                todo += [m for _, m in near[c] if m in cores]
    border = {k: min(d for d in near[k] if d[1] in cores)[1] for k in near if k not in cores and any(m in cores for _, m in near[k])}
    return root | {k: root[c] for k, c in border.items()}


def test_density_clusters_equal_a_plain_reading_and_stay_linear(spark):
    rng = random.Random(3)
    for shift in range(2):
        spots = [(rng.random(), rng.random()) for _ in range(12)]
        points = [(k, rng.gauss(a, 0.03), rng.gauss(b, 0.03)) for k in range(400) for a, b in [rng.choice(spots)]] if shift else [(k, rng.random(), rng.random()) for k in range(330)]
        got = learning.density_clusters(spark.createDataFrame(points, "k long, x double, y double"), "k", "x", "y", 0.05, 4).collect()
        assert {r.k: r.cluster for r in got} == plain(points, 0.05, 4)
    # 200,000 points in two crowds, a hair under eps apart, would make 20 thousand million pairs
    crowd = spark.range(200_000).selectExpr("id AS k", "IF(id % 2 = 0, 0.0, 0.0499) AS x", "0.0 AS y")
    assert learning.density_clusters(crowd, "k", "x", "y", 0.05, 4).filter("cluster = 0").count() == 200_000
