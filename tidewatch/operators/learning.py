"""Clustering and outlier scores over feature tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, shared_checkpoints


def scaled(rows: DataFrame, columns: Sequence[str], how: str = "standard") -> DataFrame:
    """Columns scaled over all rows: "min-max", "standard", or "robust", which is (x - mean) / (max - min); 0 without spread."""
    a = rows.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))])
    wide = lambda c: F.col(f"hi_{c}") - F.col(f"lo_{c}")
    by = {"standard": lambda c: (F.col(f"m_{c}"), F.col(f"s_{c}")), "min-max": lambda c: (F.col(f"lo_{c}"), wide(c)), "robust": lambda c: (F.col(f"m_{c}"), wide(c))}[how]

    def one(c: str) -> Column:
        shift, width = by(c)
        return F.when(width > 0, F.try_divide(F.col(c) - shift, width)).otherwise(0.0).alias(c)

    return rows.crossJoin(F.broadcast(a)).select(*[c for c in rows.columns if c not in columns], *[one(c) for c in columns])  # one row


def assigned(rows: DataFrame, columns: Sequence[str], k: int, seed: int = 1) -> DataFrame:
    """rows with `cluster` by k-means with parallel seeding on standardised columns, and the columns `_raw` and `_features`."""
    steps = [VectorAssembler(inputCols=list(columns), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_features", withMean=True), KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster", initMode="k-means||")]
    return Pipeline(stages=steps).fit(rows).transform(rows)


def clusters(rows: DataFrame, columns: Sequence[str], k: int, seed: int = 1) -> tuple[DataFrame, float]:
    """rows with their `cluster`, see assigned, and the silhouette."""
    out = assigned(rows, columns, k, seed)
    return out.drop("_raw", "_features"), ClusteringEvaluator(featuresCol="_features", predictionCol="cluster").evaluate(out)


#: Cells of a density grid are this part of eps wide, so that points of a cell are always within eps of each other.
CELL = 0.7
#: Parts of a cell's side; the first core of each part stands for it when cells are linked.
PARTS = 4
_AROUND = [(a, b) for a in range(-2, 3) for b in range(-2, 3)]


def density_clusters(rows: DataFrame, key: str, x: str, y: str, eps: float, least: int) -> DataFrame:
    """(key, cluster) of points in two dimensions: cores have `least` points within eps, themselves included; cores
    within eps share a cluster, named by its smallest core; border points join their nearest core; noise has no row.

    All points of a cell with `least` points are cores, whatever lies around it; only points of other cells, `least` - 1
    a cell at most, are compared with what lies in the cells around. Cores of a cell share a cluster, so links are looked
    for between cells: first by a few cores of each, then by all cores near each other's box, but only of cells that
    aren't in one cluster yet. So the work grows with the points, not with their pairs.
    """
    shared_checkpoints(rows.sparkSession)
    wide = eps * CELL
    at = rows.select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    at = at.withColumns({"i": F.floor(F.col("x") / wide), "j": F.floor(F.col("y") / wide)}).checkpoint()
    size = at.groupBy("i", "j").agg(F.count("*").alias("n"))
    full = at.join(size.filter(F.col("n") >= least), ["i", "j"]).select("k", "x", "y", "i", "j")
    thin = at.join(size.filter(F.col("n") < least), ["i", "j"]).select("k", "x", "y", "i", "j").checkpoint()
    around = F.inline(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a, b in _AROUND]))
    asks = thin.select(F.col("k").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), around)
    apart = F.hypot(F.col("xa") - F.col("x"), F.col("ya") - F.col("y"))
    close = lambda points: asks.join(points, ["i", "j"]).withColumn("d", apart).filter(F.col("d") <= eps)
    more = close(at).groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(F.col("a").alias("k"))
    core = full.union(thin.join(more, "k", "left_semi")).checkpoint()

    cells = core.groupBy("i", "j").agg(F.min("k").alias("cell"), *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]).checkpoint()
    part = [F.floor(F.col(c) / (wide / PARTS)) for c in "xy"]
    some = core.groupBy("i", "j", part[0].alias("pi"), part[1].alias("pj")).agg(F.min(F.struct("k", "x", "y")).alias("p")).join(cells, ["i", "j"]).select("i", "j", "cell", "p.x", "p.y")
    beside = F.inline(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a, b in _AROUND if (a, b) > (0, 0)]))
    met = some.select(F.col("cell").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), beside).join(some.withColumnRenamed("cell", "b"), ["i", "j"]).filter(apart <= eps)
    links = met.select("a", "b").distinct().checkpoint()
    own = cells.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    so_far = components(links.union(own)).checkpoint()
    # cells of different clusters whose boxes come within eps: cores that are near the other's box meet
    boxes = ["lo_x", "hi_x", "lo_y", "hi_y"]
    other = cells.select("i", "j", F.col("cell").alias("b"), *[F.col(c).alias(f"{c}_b") for c in boxes])
    pairs = cells.select(F.col("cell").alias("a"), *boxes, beside).join(other, ["i", "j"]).drop("i", "j")
    root = lambda c: so_far.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    pairs = pairs.join(root("a"), "a").join(root("b"), "b").filter("root_a != root_b")
    of = core.join(cells.select("i", "j", "cell"), ["i", "j"]).select("k", "x", "y", "cell")
    off = lambda c, low, high: F.greatest(F.col(low) - F.col(c), F.col(c) - F.col(high), F.lit(0.0))
    # a little more than eps, so that rounding loses no link; the exact distance decides
    near = lambda mine, box: of.join(pairs, of["cell"] == pairs[mine]).filter(F.hypot(off("x", f"lo_x{box}", f"hi_x{box}"), off("y", f"lo_y{box}", f"hi_y{box}")) <= eps * (1 + 1e-9))
    left = near("a", "_b").select("a", "b", F.col("x").alias("xa"), F.col("y").alias("ya"))
    rest = left.join(near("b", "").select("a", "b", "x", "y"), ["a", "b"]).filter(apart <= eps).select("a", "b").distinct()
    roots = components(links.union(own).union(rest)).select(F.col("node").alias("cell"), F.col("root").alias("cluster"))

    border = close(core).join(core.select(F.col("k").alias("a")), "a", "left_anti").groupBy("a").agg(F.min(F.struct("d", "k", "i", "j")).alias("p"))
    joined = core.select("k", "i", "j").union(border.select("a", "p.i", "p.j"))
    return joined.join(cells.select("i", "j", "cell"), ["i", "j"]).join(roots, "cell").select(F.col("k").alias(key), "cluster")


class _Tree:
    """An isolation tree: cuts at random between the extremes of a random column."""

    def __init__(self, x: np.ndarray, rng: np.random.Generator, depth: int) -> None:
        self.n, spread = len(x), np.flatnonzero(np.ptp(x, axis=0) > 0) if len(x) > 1 else []
        self.column = int(rng.choice(spread)) if depth and len(spread) else -1
        if self.column >= 0:
            self.cut = rng.uniform(x[:, self.column].min(), x[:, self.column].max())
            low = x[:, self.column] < self.cut
            self.low, self.high = _Tree(x[low], rng, depth - 1), _Tree(x[~low], rng, depth - 1)

    def paths(self, x: np.ndarray, so_far: float = 0.0) -> np.ndarray:
        if self.column < 0:
            return np.full(len(x), so_far + average_path(self.n))
        low, out = x[:, self.column] < self.cut, np.empty(len(x))
        out[low], out[~low] = self.low.paths(x[low], so_far + 1), self.high.paths(x[~low], so_far + 1)
        return out


def average_path(n: int) -> float:
    """Mean length of an unsuccessful search in a binary tree of n nodes."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def isolation_scores(rows: DataFrame, key: str, columns: Sequence[str], trees: int = 50, sample: int = 256, seed: int = 1) -> DataFrame:
    """(key, score) with 2 ** (-mean path / average path): near 1 for what few cuts isolate.

    The trees are grown on bounded samples, trees x sample rows at most, which is the method; every row is scored.
    """
    few = rows.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    drawn = few.orderBy(F.xxhash64(F.lit(seed), key)).limit(trees * sample).toPandas()[list(columns)].to_numpy()
    rng = np.random.default_rng(seed)
    depth = int(np.ceil(np.log2(max(2, min(sample, len(drawn))))))
    forest = [_Tree(drawn[rng.choice(len(drawn), min(sample, len(drawn)), replace=False)], rng, depth) for _ in range(trees)] if len(drawn) else []
    scale = average_path(min(sample, len(drawn))) or 1.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[list(columns)].to_numpy()
            yield pd.DataFrame({key: b[key], "score": 2.0 ** (-np.mean([t.paths(x) for t in forest], axis=0) / scale)})

    return few.mapInPandas(score, f"{key} {rows.schema[key].dataType.simpleString()}, score double")


def elbow(rows: DataFrame, columns: Sequence[str], least: int, most: int, seed: int = 1) -> DataFrame:
    """(k, inertia, chosen) for each number of clusters: chosen is where the fall in inertia slows down most, the least
    number if it nowhere does. The features are assembled and cached once for all fits; one number a fit comes back."""
    steps = [VectorAssembler(inputCols=list(columns), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_features", withMean=True)]
    ready = Pipeline(stages=steps).fit(rows).transform(rows).select("_features").cache()
    cost = [float(KMeans(k=k, seed=seed, featuresCol="_features").fit(ready).summary.trainingCost) for k in range(least, most + 1)]
    ready.unpersist()
    slows = {least + i: cost[i - 1] - 2 * cost[i] + cost[i + 1] for i in range(1, len(cost) - 1)}
    best = max(slows, key=slows.get, default=least)
    best = best if slows.get(best, 0) > 0 else least
    return rows.sparkSession.createDataFrame([(least + i, c, least + i == best) for i, c in enumerate(cost)], "k int, inertia double, chosen boolean")
