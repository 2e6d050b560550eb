"""Links between wallets: components, breadth-first reach and pairs made through shared keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from . import neighbourhoods, shared


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of all nodes of undirected edges; root is the smallest node of the component.

    Large-star links the larger neighbours of a node to its smallest one, small-star the smaller ones, until the edges
    are one star a component. Each round is checkpointed, which cuts the lineage, and ends when the edges are those of
    the round before; only their count and a checksum reach the driver.
    """
    shared_checkpoints(edges.sparkSession)
    alone = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b))).filter("node is not null").distinct()
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a is not null and b is not null and a != b").distinct().checkpoint()
    before = None
    while (mark := now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()) != before:
        before = mark
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = small.union(least).distinct().checkpoint()
    root = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return alone.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def shared_checkpoints(spark: SparkSession) -> None:
    """Let checkpoints go to the folder that the cluster names; a temporary one serves local runs alone."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))


#: Neighbours that one array holds at most, about; tasks at most.
PIECE, MOST_TASKS = 1_024, 4_000
#: Steps from the starts of a block, about, had no two of them a node in common; pairs that a block counts, about.
BLOCK_STEPS, BLOCK_PAIRS = 20_000_000, 5_000_000


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth): nodes reached against the direction of edges (source, target), each at its least depth.

    Starts are dealt to blocks by the smallest of their sources, so that those with sources in common tend to be
    together. What a block needs of the edges is found level by level, each node once a block, and goes to the task of
    the block, packed; the steps from each of its starts are made there, so what is reached is never shuffled. Nodes are longs.
    """
    spark = edges.sparkSession
    shared_checkpoints(spark)
    pieces = edges.groupBy("target").agg(F.ceil(F.count("*") / PIECE).alias("_pieces"))
    parted = edges.join(pieces, "target").groupBy("target", F.pmod(F.xxhash64("source"), F.col("_pieces")).alias("_piece"))
    near = parted.agg(F.collect_set(F.struct("source")).alias("s")).select("target", F.transform("s", lambda x: x["source"]).alias("nodes")).checkpoint()  # an unknown source too
    starts = starts.select("start").distinct()
    least = near.groupBy("target").agg(F.min(F.array_min("nodes")).alias("least"))
    placed = starts.join(least, starts["start"] == least["target"], "left").select("start", "least").checkpoint()
    mean = near.agg(F.sum(F.size("nodes")) / F.count_distinct("target")).first()[0] or 0.0
    steps = placed.count() * sum(mean**d for d in range(1, depth + 1))
    blocks = int(min(max(steps / BLOCK_STEPS, int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_TASKS))
    placed = placed.repartitionByRange(blocks, "least", "start").select(F.spark_partition_id().alias("block"), "start").checkpoint()
    level = placed.filter("start is not null").select("block", F.col("start").alias("node"))
    known = level.withColumn("depth", F.lit(0))
    for d in range(1, depth):
        step = level.join(near, level["node"] == near["target"]).select("block", F.explode("nodes").alias("node"), F.lit(d).alias("depth"))
        known = known.union(step.filter("node is not null")).groupBy("block", "node").agg(F.min("depth").alias("depth")).checkpoint()
        level = known.filter(F.col("depth") == d).select("block", "node")
    needed = known.filter(F.lit(depth > 0)).join(near, known["node"] == near["target"]).select("block", "node", "nodes")
    dealt = placed.filter("start is not null").select("block", F.col("start").alias("node"), F.lit(None).cast("array<bigint>").alias("nodes")).union(needed)
    out = dealt.repartitionById(blocks, "block").mapInArrow(lambda batches: neighbourhoods.reached(batches, depth), "start long, node long, depth int")
    return out.union(placed.filter("start is null").select("start", F.col("start").alias("node"), F.lit(0).alias("depth")))  # an unknown start


def _rare(kept: DataFrame, common: int) -> tuple[int, float]:
    """How many items a rare key has at most, and how many pairs rare keys make, see _rarest; a row of kept is one item of a key."""
    return _rarest(kept.groupBy("_n").agg(F.count("*").alias("rows")), common)


def _rarest(sizes: DataFrame, common: int) -> tuple[int, float]:
    """From the rows that keys of _n items have: `common` items, or up to four times as many where all such keys make no
    more pairs a row than keys of `common` items do, half as many."""
    rows = sizes.agg(F.sum("rows")).first()[0] or 0
    few = sizes.filter(F.col("_n") <= 4 * common).select("_n", (F.col("rows") * (F.col("_n") - 1) / 2).alias("pairs"))
    most, total, so_far = common, 0.0, 0.0
    for size, pairs in sorted(few.collect()):  # 4 x common rows at most
        so_far += pairs
        if size <= common or so_far <= rows * common / 2:
            most, total = max(most, size), so_far
    return most, total


def _placed(items: DataFrame, keys: Column, blocks: int) -> DataFrame:
    """items with their block, a range of the smallest of these keys, which items of keys in common tend to share."""
    kind = items.select(keys).schema[0].dataType.elementType
    least = F.array_min(keys) if kind in (LongType(), IntegerType()) else F.xxhash64(F.array_min(keys))
    at = F.percentile_approx(least.cast("long"), F.array(*[F.lit(i / blocks) for i in range(1, blocks)]), F.lit(100 * blocks)) if blocks > 1 else F.lit(None)
    bounds = sorted(set(items.agg(at).first()[0] or []))
    ends = F.array(*[F.lit(x) for x in bounds]).cast("array<long>")
    return items.withColumn("block", F.size(F.filter(ends, lambda x: x < least)).cast("int"))


def shared_pairs(rows: DataFrame, item: str, key: str, least: int, common: int = 40) -> DataFrame:
    """(a, b, shared): all pairs of items, a below b, that share `least` keys or more, with how many, from rows(item, key).

    Keys that more than `common` items have (or a little more, see _rarest) would make pairs with the square of their size.
    They are first counted by rarer keys; only pairs that common keys alone can make are looked for among those, without each item's least - 1
    most common ones: two items that share `least` of them still meet at the rarest. Items with the same common keys
    are one class there, and classes become pairs of items only where they share `least` keys, which are results.

    Items are dealt to blocks. A rare key's members go to a block of theirs once, however many of them are in it; pairs
    are made and counted in the task of the block and travel only where they are shared enough. Items are longs.
    """
    spark = rows.sparkSession
    shared_checkpoints(spark)
    items = rows.select(F.col(item).alias("_i"), F.col(key).alias("_k")).filter("_i is not null and _k is not null").groupBy("_i").agg(F.collect_set("_k").alias("keys")).checkpoint()
    size = items.select(F.explode("keys").alias("_k")).groupBy("_k").agg(F.count("*").alias("_n")).filter("_n > 1").checkpoint()
    most, pairs = _rarest(size.groupBy("_n").agg(F.sum("_n").alias("rows")), common)
    often = size.filter(F.col("_n") > most)
    crowded = not often.isEmpty()
    blocks = int(min(max(pairs / BLOCK_PAIRS, int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_TASKS))
    if crowded:
        each = items.select("_i", F.explode("keys").alias("_k")).join(often, "_k")
        lists = each.groupBy("_i").agg(F.array_sort(F.collect_list(F.struct("_n", "_k"))).alias("keys"))
        lists = lists.select("_i", F.transform("keys", lambda x: x["_k"]).alias("keys")).checkpoint()
        items = items.join(lists.select("_i", F.col("keys").alias("often")), "_i", "left").checkpoint()
    # by a rare key, as all may have a common one
    rarest = F.when(F.col("often").isNull(), F.col("keys")).otherwise(F.array_except("keys", "often")) if crowded else F.col("keys")
    placed = _placed(items, rarest, blocks)
    # a pair shares no more common keys than either has
    c = F.least(F.coalesce(F.size("often"), F.lit(0)), F.lit(least)) if crowded else F.lit(0)
    rarely = placed.select("_i", "block", c.cast("byte").alias("c"), F.explode(rarest).alias("_k")).join(size.filter(F.col("_n") <= most).select("_k"), "_k")
    group = rarely.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("block", "_i", "c"))).alias("g"))
    each = group.select("g", F.explode(F.array_distinct(F.transform("g", lambda x: x["block"]))).alias("block"))
    members = F.filter("g", lambda x: x["block"] >= F.col("block"))
    packed = each.select("block", F.size(F.filter("g", lambda x: x["block"] == F.col("block"))).alias("own"), members.alias("g")).filter(F.size("g") > 1)
    dealt = packed.select("block", "own", F.transform("g", lambda x: x["_i"]).alias("items"), F.transform("g", lambda x: x["c"]).alias("common")).repartitionById(blocks, "block")
    rare = dealt.mapInArrow(lambda batches: shared.counted(batches, least), "a long, b long, rare long")
    if not crowded:
        return rare.select("a", "b", F.col("rare").alias("shared"))
    classes = lists.filter(F.size("keys") >= least).groupBy("keys").agg(F.min("_i").alias("class"), F.count("*").alias("n"))
    prefix = classes.select("class", "keys", F.explode(F.slice("keys", F.lit(1), F.size("keys") - (least - 1))).alias("_k"))
    side = lambda x: prefix.select("_k", F.col("class").alias(f"class_{x}"), F.col("keys").alias(f"keys_{x}"))
    enough = F.size(F.array_intersect("keys_a", "keys_b")) >= least
    met = side("a").join(side("b"), "_k").filter((F.col("class_a") < F.col("class_b")) & enough).select("class_a", "class_b").distinct()
    met = met.union(classes.filter("n > 1").select("class", F.col("class")))
    of = lists.join(classes.select("keys", "class"), "keys").select("_i", "class")
    each = met.join(of.select(F.col("class").alias("class_a"), F.col("_i").alias("x")), "class_a").join(of.select(F.col("class").alias("class_b"), F.col("_i").alias("y")), "class_b")
    each = each.filter((F.col("x") < F.col("y")) | (F.col("class_a") != F.col("class_b"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(0).cast("long").alias("rare"))
    found = rare.union(each).groupBy("a", "b").agg(F.max("rare").alias("rare"))
    both = found.join(lists.select(F.col("_i").alias("a"), F.col("keys").alias("ka")), "a", "left").join(lists.select(F.col("_i").alias("b"), F.col("keys").alias("kb")), "b", "left")
    total = F.col("rare") + F.coalesce(F.size(F.array_intersect("ka", "kb")), F.lit(0))
    return both.select("a", "b", total.cast("long").alias("shared")).filter(F.col("shared") >= least)
