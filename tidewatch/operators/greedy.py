"""Sequential greedy choices in parallel rounds, with the result of the loop: what depends on nothing undecided is decided."""

from __future__ import annotations

import bisect
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import shared_checkpoints


#: A task settles the windows of so many chunks of time at once.
SPAN = 8


def disjoint_intervals(windows: DataFrame, least: int, chunk: int) -> DataFrame:
    """windows with `left` and `right`, what is left of [lo, hi] when larger windows, of equal ones those that end first,
    have taken their places; windows with under `least` places left are dropped and take none.

    windows(lo, hi, start, ...) have different hi, places lo to hi and times from start to start + chunk at most. They
    are dealt by spans of time; a window that reaches into two spans goes to both. Of a span a task settles, in their
    order, the windows that meet nothing unsettled before them; one in two spans is never settled there, but is when the
    spans of the next round begin half a span later. What larger windows take of a window is a head and a tail, never a
    part inside, so two places describe the rest. A task has what begins within a span, as five numbers a window.
    """
    shared_checkpoints(windows.sparkSession)
    columns = windows.columns
    numbers = ["lo", "hi", "left", "right"]
    live = windows.select("*", F.col("lo").alias("left"), F.col("hi").alias("right")).filter(F.col("right") - F.col("left") + 1 >= least).checkpoint()
    out, turn = None, 0
    while not live.isEmpty():
        span = lambda c, turn=turn: F.floor((F.floor(F.col(c) / chunk) + turn % 2 * (SPAN // 2)) / SPAN)
        one = span("start") == span("end")
        dealt = live.select(*[F.col(c).cast("long").alias(c) for c in numbers], one.alias("inside"), F.explode(F.array_distinct(F.array(span("start"), span("end")))).alias("_span"))
        told = dealt.groupBy("_span").applyInPandas(_settling(least), "hi long, left long, right long, kept boolean")
        # one in two spans is cut by both
        cuts = told.groupBy(F.col("hi").alias("_hi")).agg(F.max("left").alias("_left"), F.min("right").alias("_right"), F.max("kept").alias("_kept"))
        both = live.join(cuts, F.col("hi") == F.col("_hi")).select(*columns, F.col("_left").alias("left"), F.col("_right").alias("right"), "_kept").checkpoint()
        kept = both.filter("_kept").drop("_kept")
        out = kept if out is None else out.union(kept)
        live = both.filter(~F.col("_kept") & (F.col("right") - F.col("left") + 1 >= least)).drop("_kept")
        turn += 1
    return (live if out is None else out).select(*columns, "left", "right")


def _settling(least: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a task does with the windows of a span."""

    class Places:
        """Places, as ascending ranges that neither meet nor touch."""

        def __init__(self) -> None:
            self.starts: list[int] = []
            self.ends: list[int] = []

        def add(self, left: int, right: int) -> None:
            i, j = bisect.bisect_left(self.ends, left - 1), bisect.bisect_right(self.starts, right + 1)
            if i < j:
                left, right = min(left, self.starts[i]), max(right, self.ends[j - 1])
            self.starts[i:j], self.ends[i:j] = [left], [right]

        def meets(self, left: int, right: int) -> bool:
            i = bisect.bisect_left(self.ends, left)
            return i < len(self.starts) and self.starts[i] <= right

        def rest(self, left: int, right: int) -> tuple[int, int]:
            """left and right without a range at either end."""
            i = bisect.bisect_left(self.ends, left)
            if i < len(self.starts) and self.starts[i] <= left:
                left = self.ends[i] + 1
            i = bisect.bisect_right(self.starts, right) - 1
            if i >= 0 and self.ends[i] >= right:
                right = self.starts[i] - 1
            return left, right

    def settled(windows: pd.DataFrame) -> pd.DataFrame:
        """hi, left, right and `kept` of the windows of a span that are kept or can't be settled yet; the others are gone."""
        windows = windows.assign(n=windows.hi - windows.lo).sort_values(["n", "hi"], ascending=[False, True])
        taken, waiting, out = Places(), Places(), []
        for hi, left, right, inside in zip(*(windows[c].tolist() for c in ("hi", "left", "right", "inside")), strict=True):
            left, right = taken.rest(left, right)
            if right - left + 1 < least:
                if not inside:  # the other span has to know
                    out.append((hi, left, right, False))
                continue
            now = inside and not waiting.meets(left, right)
            (taken if now else waiting).add(left, right)
            out.append((hi, left, right, now))
        return pd.DataFrame(out, columns=["hi", "left", "right", "kept"]).astype({"hi": "int64", "left": "int64", "right": "int64", "kept": "bool"})

    return settled


def first_seeds(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, seed): nodes go in ascending order; one that no seed has claimed becomes a seed and claims its neighbours.

    nodes(node) are distinct; links(a, b) are undirected, each once. A node below all its undecided neighbours is a
    seed; what a seed is linked to can't be one. Claims go to the smallest seed among the neighbours, which is the
    first to have come by; a seed has itself.
    """
    shared_checkpoints(nodes.sparkSession)
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a != b").distinct().checkpoint()
    seeds, live, open_links = None, nodes.select("node").checkpoint(), both
    while not live.isEmpty():
        blocked = open_links.filter("b < a").select(F.col("a").alias("node")).distinct()
        new = live.join(blocked, "node", "left_anti").checkpoint()
        seeds = new if seeds is None else seeds.union(new)
        claimed = open_links.join(new, F.col("a") == F.col("node")).select(F.col("b").alias("node"))
        done = new.union(claimed).distinct().checkpoint()
        live = live.join(done, "node", "left_anti").checkpoint()
        over = done.select(F.col("node").alias("_n"))
        open_links = open_links.join(over, F.col("a") == F.col("_n"), "left_anti").join(over, F.col("b") == F.col("_n"), "left_anti").checkpoint()
    if seeds is None:
        return nodes.select("node", F.col("node").alias("seed"))
    by = both.join(seeds, F.col("b") == F.col("node")).groupBy("a").agg(F.min("b").alias("seed"))
    own = seeds.select("node", F.col("node").alias("seed"))
    return own.union(by.join(seeds, F.col("a") == F.col("node"), "left_anti").select(F.col("a").alias("node"), "seed"))


def first_seeds_by_key(rows: DataFrame) -> DataFrame:
    """(node, seed) as of first_seeds, of nodes that are linked if they share a key; rows(node, key) are distinct.

    A node that is the smallest undecided one of all its keys is a seed and claims who has one of them. No pair is made:
    a round is two aggregations of the rows, whatever many nodes have in common.
    """
    shared_checkpoints(rows.sparkSession)
    all_of = rows.select("node", "key").checkpoint()
    live, seeds = all_of, None
    while not live.isEmpty():
        least = live.groupBy("key").agg(F.min("node").alias("_least"))
        new = live.join(least, "key").groupBy("node").agg(F.min((F.col("node") == F.col("_least")).cast("int")).alias("_first")).filter("_first = 1").select("node")
        won = live.join(new, "node", "left_semi").select("key", F.col("node").alias("seed")).checkpoint()
        seeds = won if seeds is None else seeds.union(won)
        # a key has one seed at most: whoever shares it with that one is claimed
        done = live.join(won, "key", "left_semi").select("node").distinct()
        live = live.join(done, "node", "left_anti").checkpoint()
    if seeds is None:
        return rows.select("node", F.col("node").alias("seed"))
    own = seeds.select(F.col("seed").alias("node"), "seed").distinct()
    claimed = all_of.join(seeds, "key").groupBy("node").agg(F.min("seed").alias("seed"))
    return own.union(claimed.join(own.select("node"), "node", "left_anti"))
