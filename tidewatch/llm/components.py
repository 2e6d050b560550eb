"""Connected components by alternating large-star and small-star steps, every step a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that an edge names: the root is the smallest node of its component.

    Nodes are integers. Loops and rows with a null end are ignored; repeated edges count once; no edges give no rows.
    Large-star links the larger neighbours of a node to its smallest one, small-star the smaller ones, so that the
    edges end as one star a component. Each round is written to the scratch folder, which ends the lineage; only a row
    count and a checksum reach the driver. A hub is one key of a join, which adaptive execution splits.
    """
    ends = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a is not null and b is not null and a != b")
    now, before = saved(ends.distinct(), "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = mark
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m")).distinct()
        after = saved(small, "edges")
        dropped(now)
        now = after
