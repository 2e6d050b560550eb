"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child draws -ln(u) / weight, u being a hash of doc_id
and the child's name in (0, 1], and the smallest draw wins: a child wins in proportion to its weight, the sum of what
lies below. A child's draw depends on nothing but doc_id, its own name and its weight, so a change of weights moves
documents only into children that gain and out of those that lose.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, saved, text_or_empty

#: The tree that the first shards form: racks a region and shards a rack.
RACKS, SHARDS, BASE = 2, 4, 40

Tree = dict[str, dict[str, dict[int, float]]]


def tree_for(n_shards: int, base: int = BASE) -> Tree:
    """region -> rack -> shard -> weight. The first `base` shards fill regions of RACKS x SHARDS; each one after them is
    a region of its own, so that growing by one shard raises no weight but the new region's."""
    tree: Tree = {}
    for s in range(n_shards):
        per = RACKS * SHARDS
        region, rack = (f"r{s // per}", f"k{s % per // SHARDS}") if s < base else (f"r+{s}", "k0")
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return tree


_LEAF = "struct<name:string,weight:double,shard:int>"
_RACK = f"struct<name:string,weight:double,below:array<{_LEAF}>>"
_REGION = f"struct<name:string,weight:double,below:array<{_RACK}>>"


def _draw(key: Column, child: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11).cast("double") + 1) / 2.0**53
    return -F.ln(u) / child["weight"]


def _winner(key: Column, children: Column) -> Column:
    """The child with the smallest draw; the first of equal ones."""
    best = F.array_min(F.transform(children, lambda c, i: F.struct(_draw(key, c), i.alias("i"))))["i"]
    return F.get(children, best)


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key: one draw for each child of the nodes on its way; what has no weight gets nothing."""
    regions = []
    for region, racks in tree.items():
        inner = []
        for rack, shards in racks.items():
            if leaves := [{"name": f"{region}/{rack}/{s}", "weight": w, "shard": s} for s, w in shards.items() if w > 0]:
                inner.append({"name": f"{region}/{rack}", "weight": sum(x["weight"] for x in leaves), "below": leaves})
        if inner:
            regions.append({"name": region, "weight": sum(x["weight"] for x in inner), "below": inner})
    top = F.from_json(F.lit(json.dumps(regions)), f"array<{_REGION}>")
    return let(_winner(key, top), lambda region: let(_winner(key, region["below"]), lambda rack: _winner(key, rack["below"])["shard"]))


def sharded(docs: DataFrame, tree: Tree, grown: Tree, chunk_rows: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard of every row of docs(doc_id, text).

    size is the text's UTF-8 bytes plus 16, text_crc32 its unsigned checksum; a null text counts as empty. slot numbers
    the rows of a shard from 0 without gaps: each shard is dealt into chunks by a hash of doc_id and text, rows are
    numbered in each chunk, and sums of the chunks' counts are added, so that no task sees a whole shard. Rows with a
    null doc_id share one key and hence one shard; repeated rows get a slot each; an empty table gives no rows; other
    columns are ignored.
    """
    key = F.col("doc_id")
    data = text_or_empty(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(data) + F.lit(16).cast("long")).alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64("doc_id", "text").alias("mix"), F.spark_partition_id().alias("part"))
    rows = saved(rows.select("doc_id", "size", "text_crc32", "mix", "part", shard_of(key, tree).alias("shard"), shard_of(key, grown).alias("grown_shard")), "sharded")
    chunks = rows.count() // chunk_rows + 8
    # copies of one row would share a chunk, so the part of the input deals them out too
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("mix", "part"), F.lit(chunks)))
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "mix", "part")) - 1)
    return numbered.join(starts, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth")).cast("long").alias("slot"), "grown_shard")
