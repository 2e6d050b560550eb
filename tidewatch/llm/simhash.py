"""SimHash near-duplicate groups with covering locality-sensitive hashing.

A fingerprint has 64 bits and two documents are linked when theirs differ in at most three. Every bit position gets a
nonzero vector of four bits; for each nonzero v of four bits, the mask of v hides the positions whose vector is
orthogonal to v. Three differing positions span at most three of the four dimensions, so some v is orthogonal to all of
them and its mask hides all three: each linked pair collides in at least one of the 15 tables, with no chance involved.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, runs, saved
from .components import connected_components

BITS, RADIUS, SHINGLE, SEED, SECOND = 64, 3, 3, 42, 32
#: A bucket with more fingerprints than this is dealt out again by a second set of masks.
BUCKET = 16_384


def covering_masks(vector_of: list[int], radius: int = RADIUS) -> list[int]:
    """The masks for all nonzero v, as signed 64-bit integers; vector_of: each position's vector of radius + 1 bits."""
    masks = [sum(1 << i for i, x in enumerate(vector_of) if (x & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]
    return [m - 2**BITS if m >= 2 ** (BITS - 1) else m for m in masks]


MASKS = covering_masks([1 + i % 15 for i in range(BITS)])
#: The same vectors in another order: what a table of each rule leaves open is at most 18 bits.
MASKS_2 = covering_masks(random.Random(SECOND).sample([1 + i % 15 for i in range(BITS)], BITS))

_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_BYTE_AT = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes) -> int:
    """The fingerprint of a UTF-8 text: bit by bit, 1 if set in over half of the shingles' hashes; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly the six ASCII white-space characters
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
        starts = np.r_[0, ends[:-1]].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())]  # noqa: B905
    seen = np.zeros(8 * 256, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        rows = np.array(hashes[at : at + 65_536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        seen += np.bincount((rows + _BYTE_AT).ravel(), minlength=len(seen))
    ones = (seen.reshape(8, 256) @ _BIT_OF_BYTE).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (signed long) of every row of docs(doc_id, text); a null text has no words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py() or b"") for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(each, "doc_id long, fp long")


def forest(fps: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what is within the radius in one bucket, one fewer than members for each connected part."""
    left, out = np.arange(len(fps)), []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            at = stack.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= RADIUS
            if near.any():
                found = left[near]
                out += [(ids[at], ids[x]) for x in found]
                stack += found.tolist()
                left = left[~near]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int]] = []
    for group in runs(batches, ["k1", "k2", "key"]):
        out += forest(group["fp"], group["node"])
        if len(out) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])


def _counted(keyed: DataFrame) -> DataFrame:
    return keyed.withColumn("n", F.count("*").over(Window.partitionBy("k1", "k2", "key")))


def links(classes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between nodes that connect the same classes as all pairs within the radius; classes(node, fp).

    Each class has 15 rows, one a table. A bucket is counted in a window, which spills, and its links come from one
    pass over its sorted rows that holds one bucket of at most `bucket` rows. Larger ones are dealt out again by a
    second set of masks: what two tables share leaves at most 18 bits open, so that no bucket grows with the input.
    """
    tables = F.array(*[F.struct(F.lit(i).alias("k1"), F.lit(-1).alias("k2"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(MASKS)])
    counted = _counted(classes.select("node", "fp", F.inline(tables)))
    small = counted.filter((F.col("n") > 1) & (F.col("n") <= bucket))
    large = counted.filter(F.col("n") > bucket).drop("n", "k2", "key")
    both = [F.lit(a | b) for a in MASKS for b in MASKS_2]
    again = F.array(*[F.struct(F.lit(j).alias("k2")) for j in range(len(MASKS_2))])
    mask = F.element_at(F.array(*both), F.col("k1") * len(MASKS_2) + F.col("k2") + 1)
    finer = _counted(large.select("node", "fp", "k1", F.inline(again)).select("node", "fp", "k1", "k2", F.col("fp").bitwiseAND(mask).alias("key"))).filter("n > 1")
    cols = ["k1", "k2", "key", "fp", "node"]
    found = [x.select(*cols).sortWithinPartitions("k1", "k2", "key").mapInArrow(_links, "a long, b long") for x in (small, finer)]
    return found[0].union(found[1])


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of docs(doc_id, text).

    component_id is the smallest doc_id that links of at most three differing bits reach, the row's own included. Equal
    fingerprints form one class before any comparison, so copies cost no more than one row each. Null and empty texts
    have the fingerprint zero and are linked like any other; a repeated row gives a repeated result; a row without a
    doc_id takes part in its class, but names no component (null if the whole component has no doc_id); an empty table
    gives no rows. Other columns are ignored.
    """
    marked = saved(fingerprints(docs), "fingerprints")
    classes = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first")).select("fp", "first"), "classes")
    named = classes.filter("first is not null").select(F.col("first").alias("node"), "fp")
    # a doc_id on rows of different texts can be the smallest of two classes; then they share a node and a component
    edges = saved(links(named, bucket), "links")
    roots = connected_components(edges)
    dropped(edges)
    component = classes.join(roots, classes["first"] == roots["node"], "left").select("fp", F.coalesce("root", "first").alias("component_id"))
    return marked.join(component, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
