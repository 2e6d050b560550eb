"""Agglomerative clusters by average linkage, and silhouettes, over a bounded grid of weighted points."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import shared_checkpoints

#: Points that can be linked; all their pairs are rows. A grid of features keeps rows of any number to so many points.
MOST_POINTS = 5_000
#: Clusters from which on the rest is merged in one task.
IN_ONE_TASK = 1_000
#: Distances are whole numbers of this part of a grid step, so that sums of them are exact in any order.
UNIT = 1e-6


def grid_points(rows: DataFrame, key: str, levels: Column) -> DataFrame:
    """(id, weight, levels): rows with equal arrays of whole-number levels as one point, named by its smallest key."""
    return rows.groupBy(levels.alias("levels")).agg(F.min(key).alias("id"), F.count("*").alias("weight")).select("id", "weight", "levels")


def distances(points: DataFrame) -> DataFrame:
    """(a, b, d, wa, wb) of all pairs of points, a below b: the Euclidean distance in UNITs, and the weights."""
    if (n := points.count()) > MOST_POINTS:
        raise ValueError(f"{n} points are more than {MOST_POINTS}; take a coarser grid")
    other = points.select(F.col("id").alias("b"), F.col("weight").alias("wb"), F.col("levels").alias("lb"))
    squares = F.aggregate(F.zip_with("levels", "lb", lambda x, y: ((x - y) * (x - y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    pairs = points.join(F.broadcast(other), F.col("id") < F.col("b"))  # MOST_POINTS rows at most
    return pairs.select(F.col("id").alias("a"), "b", F.round(F.sqrt(squares) / UNIT).cast("long").alias("d"), F.col("weight").alias("wa"), "wb")


def average_links(pairs: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """(round, parent, child, height): all merges of average linkage down to one cluster, named by their smallest points.

    The mean distance of a merged cluster to any other lies between those of its parts, so two clusters that are nearest
    to each other stay so whatever merges elsewhere: all such pairs merge in one round, with the result of merging the
    closest pair of all, again and again. Of equal means the pair with the smaller names counts as closer. What is kept
    of two clusters is the sum of distances of their rows and how many pairs of rows there are. Late merges come one by
    one, as a large cluster takes in what lies around it: once `in_one_task` clusters are left, they are done in one task.
    """
    shared_checkpoints(pairs.sparkSession)
    whole = "decimal(38,0)"
    links = pairs.select("a", "b", (F.col("d").cast(whole) * F.col("wa") * F.col("wb")).cast(whole).alias("s"), (F.col("wa") * F.col("wb")).cast(whole).alias("p")).checkpoint()
    out, n = None, 0
    while links.count() > in_one_task * (in_one_task - 1) // 2:
        mean = F.struct((F.col("s").cast("double") / F.col("p").cast("double")).alias("height"), F.col("a").alias("parent"), F.col("b").alias("child"))
        ends = links.select(mean.alias("pair"), F.explode(F.array("a", "b")).alias("of"))
        nearest = ends.groupBy("of").agg(F.min("pair").alias("pair"))
        merged = nearest.groupBy("pair").agg(F.count("*").alias("n")).filter("n = 2").select(F.lit(n).alias("round"), "pair.parent", "pair.child", "pair.height").checkpoint()
        out = merged if out is None else out.union(merged)
        into = F.broadcast(merged.select("parent", "child"))  # points at most
        name = lambda c: F.coalesce(f"{c}_to", c)
        moved = links.join(into.select(F.col("child").alias("a"), F.col("parent").alias("a_to")), "a", "left").join(into.select(F.col("child").alias("b"), F.col("parent").alias("b_to")), "b", "left")
        moved = moved.select(F.least(name("a"), name("b")).alias("a"), F.greatest(name("a"), name("b")).alias("b"), "s", "p").filter("a != b")
        links = moved.groupBy("a", "b").agg(F.sum("s").cast(whole).alias("s"), F.sum("p").cast(whole).alias("p")).checkpoint()
        n += 1
    rest = links.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(_merged_one_by_one, "round int, parent long, child long, height double")
    return rest if out is None else out.union(rest.withColumn("round", F.col("round") + n))


def _merged_one_by_one(links: pd.DataFrame) -> pd.DataFrame:
    """The merges of the closest two clusters, again and again; sums are whole numbers of any size."""
    names = np.unique(links[["a", "b"]].to_numpy())
    i, j = np.searchsorted(names, links.a), np.searchsorted(names, links.b)
    sums, pairs = (np.zeros((len(names), len(names)), dtype=object) for _ in range(2))
    for x, c in ((sums, "s"), (pairs, "p")):
        x[i, j] = x[j, i] = [int(v) for v in links[c]]
    height = np.full(sums.shape, np.inf)
    height[i, j] = height[j, i] = (sums[i, j] / pairs[i, j]).astype(float)
    # the first of equal ones is that with the smallest names
    nearest = height.argmin(1)
    least = height[np.arange(len(names)), nearest]
    live, out = np.ones(len(names), dtype=bool), []
    for step in range(len(names) - 1):
        a = int(least.argmin())
        a, b = sorted((a, int(nearest[a])))
        out.append((step, names[a], names[b], height[a, b]))
        live[b], least[b], height[b], height[:, b] = False, np.inf, np.inf, np.inf
        others = np.flatnonzero(live & (np.arange(len(names)) != a))
        for x in (sums, pairs):
            x[a, others] = x[others, a] = x[a, others] + x[b, others]
        height[a, others] = height[others, a] = (sums[a, others] / pairs[a, others]).astype(float)
        again = np.append(others[(nearest[others] == a) | (nearest[others] == b)], a)
        nearest[again] = height[again].argmin(1)
        least[again] = height[again, nearest[again]]
    return pd.DataFrame(out, columns=["round", "parent", "child", "height"])


def cut(merges: DataFrame, k: int) -> DataFrame:
    """(child, root): points that are not the smallest of their cluster, and that one, when k clusters are left.

    Merges are done from the lowest on, of equal heights by their names, each after those that formed its clusters. All
    merges are one group, of as many rows as there are points.
    """

    def roots(m: pd.DataFrame) -> pd.DataFrame:
        m = m.sort_values(["round", "parent"]).reset_index(drop=True)
        formed: dict[int, int] = {}
        waits, follow = [0] * len(m), [[] for _ in range(len(m))]
        for i, (a, b) in enumerate(zip(m.parent, m.child, strict=True)):
            for before in {formed[x] for x in (a, b) if x in formed}:
                waits[i] += 1
                follow[before].append(i)
            formed[a] = i
        entry = lambda i: (m.height[i], m.parent[i], m.child[i], i)
        ready = [entry(i) for i in range(len(m)) if not waits[i]]
        heapq.heapify(ready)
        up: dict[int, int] = {}
        for _ in range(len(m) + 1 - k):
            _, a, b, i = heapq.heappop(ready)
            up[b] = a
            for j in follow[i]:
                waits[j] -= 1
                if not waits[j]:
                    heapq.heappush(ready, entry(j))

        def root(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        return pd.DataFrame({"child": list(up), "root": [root(x) for x in up]}, dtype="int64")

    return merges.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(roots, "child long, root long")


def linked_clusters(rows: DataFrame, key: str, levels: Column, k: int) -> DataFrame:
    """rows with `cluster` and `silhouette`: k clusters by average linkage of their grid points, numbered by smallest key.

    The silhouette is (b - a) / max(a, b), a being the mean distance to the others of the row's own cluster and b the
    least mean distance to another cluster; null if it has no others or there is one cluster only, 0 if both are 0. All
    rows count, those of one point as often as there are.
    """
    shared_checkpoints(rows.sparkSession)
    named = rows.withColumn("_levels", levels)
    points = grid_points(named, key, F.col("_levels")).checkpoint()
    pairs = distances(points).checkpoint()
    root = cut(average_links(pairs), k)
    found = points.join(root, F.col("id") == F.col("child"), "left").select("id", "weight", "levels", F.coalesce("root", "id").alias("root")).checkpoint()
    sizes = found.groupBy("root").agg(F.sum("weight").alias("size"))
    of = F.broadcast(found.select(F.col("id").alias("to"), F.col("root").alias("to_root"), F.col("weight").alias("w")))  # points at most
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("to"), "d").union(pairs.select("b", "a", "d")).join(of, "to")
    sums = both.groupBy("id", "to_root").agg(F.sum(F.col("d") * F.col("w")).alias("s")).join(F.broadcast(sizes), F.col("to_root") == sizes["root"]).select("id", "to_root", "s", "size")
    own = F.col("to_root") == F.col("root")
    mean = found.join(sums, "id", "left").groupBy("id", "root").agg(F.max(F.when(own, F.col("s"))).alias("s"), F.min(F.when(~own, F.col("s") / F.col("size"))).alias("b"))
    a = F.coalesce("s", F.lit(0)) / (F.col("size") - 1)
    score = F.when(F.col("size") > 1, F.when(F.greatest(a, "b") > 0, (F.col("b") - a) / F.greatest(a, "b")).otherwise(F.when(F.col("b").isNotNull(), 0.0)))
    numbers = found.select("root").distinct().agg(F.array_sort(F.collect_list("root")).alias("roots"))  # k of them
    scored = mean.join(F.broadcast(sizes), "root").select("id", "root", score.alias("silhouette")).crossJoin(F.broadcast(numbers))  # one row
    labels = scored.join(found.select("id", "levels"), "id").select(F.col("levels").alias("_of"), (F.array_position("roots", F.col("root")) - 1).cast("int").alias("cluster"), "silhouette")
    return named.join(F.broadcast(labels), F.col("_levels") == F.col("_of")).drop("_levels", "_of")
