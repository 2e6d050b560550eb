"""Near copies of whole texts: five-word shingles that are alike, found by SimHash of words under covering masks.

Two texts are linked when the similarity of their sets of five-word shingles is 0.8 or more, as their shapes tell it: a
shape is a SimHash of 256 bits of the shingles, and the share of bits in which two differ is the angle between the sets.
At 0.8 about 39 bits differ, and about 10 of a shape of 64 bits, for which covering masks would need thousands of
tables. The same texts share nearly all their words, though, since a word that differs spoils five shingles: SimHashes
of 64 bits of their sets of words differ in four bits or so. Covering masks for six bits bring each pair within that
radius together in at least one of 127 tables, and most pairs beyond it; shapes are then compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, saved, text_or_empty
from .components import connected_components
from .passages import WordHashes, gram_hashes
from .simhash import covering_masks

SHINGLE, SIMILARITY, RADIUS, SHAPE = 5, 0.8, 6, 4
#: The vectors of the positions are 1 and the position's number: a first-order Reed-Muller code, so that each mask but
#: the one that reads all bits reads 32.
MASKS = covering_masks([64 | i for i in range(64)], RADIUS)
#: The same in another order, for buckets with more classes than BUCKET.
MASKS_2 = covering_masks([64 | (37 * i + 11) % 64 for i in range(64)], RADIUS)
BUCKET = 262_144
_COLUMNS = [f"s{i}" for i in range(SHAPE)]
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Hashes (n rows of k unsigned longs) as k longs, each bit that of more than half of the rows."""
    lanes = 8 * hashes.shape[1]
    seen = np.zeros(lanes * 256)
    for at in range(0, len(hashes), 65_536):
        rows = np.ascontiguousarray(hashes[at : at + 65_536]).astype(">u8").view(np.uint8).reshape(-1, lanes)
        seen += np.bincount((rows + np.arange(lanes) * 256).ravel(), minlength=len(seen))
    ones = seen.reshape(lanes, 256).astype(np.float32) @ _BITS
    return np.packbits(2 * ones.ravel() > len(hashes)).view(">u8").astype(np.uint64)


def prints(words: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The SimHash of the set of words and the shape of the set of shingles, from the words' hashes; zeros without words."""
    if not len(words):
        return np.zeros(1 + SHAPE, dtype=np.uint64)
    grams = np.unique(gram_hashes(words, min(shingle, len(words))))
    wide = np.stack([(grams ^ grams >> np.uint64(31)) * m for m in _MIX], axis=1)
    wide ^= wide >> np.uint64(29)
    wide *= np.uint64(0xBF58476D1CE4E5B9)
    wide ^= wide >> np.uint64(32)
    return np.concatenate([_majority(np.unique(words)[:, None]), _majority(wide)])


_WORDS = WordHashes()


def printed(docs: DataFrame, key: str, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key, fp and the longs of the shape of every row of docs(doc_id, text, key); words are ASCII-lower-cased."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, 1 + SHAPE), dtype=np.uint64)
            for i, text in enumerate(batch.column(2)):
                found[i] = prints(_WORDS.of((text.as_py() or b"").lower().split()), shingle)
            longs = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in found.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *longs], names=["doc_id", key, "fp", *_COLUMNS])

    return docs.select(F.col("doc_id").cast("long"), key, F.col("text").cast("binary")).mapInArrow(each, f"doc_id long, {key} long, fp long, " + ", ".join(f"{c} long" for c in _COLUMNS))


def most_bits(similarity: float) -> int:
    """In how many bits the shapes of two equally large sets with this Jaccard similarity differ."""
    return math.floor(64 * SHAPE * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def forest(shapes: np.ndarray, nodes: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what differs in `most` bits at most, one fewer than members for each connected part."""
    left, out = np.arange(len(shapes)), []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            at = stack.pop()
            near = _differ(shapes[left], shapes[at]) <= most
            if near.any():
                found = left[near]
                out.append((np.full(len(found), nodes[at]), nodes[found]))
                stack += found.tolist()
                left = left[~near]
    return out


def _links(most: int):
    """From rows sorted by k to links (a, b): all buckets against their first row at once, the rest one by one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(k: np.ndarray, nodes: np.ndarray, shapes: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[first, len(k)])
            head = np.repeat(first, size)
            near = _differ(shapes, shapes[head]) <= most
            whole = np.repeat(np.logical_and.reduceat(near, first) | (size < 3), size)
            rows = np.flatnonzero(whole & near & (np.arange(len(k)) != head))
            links = [(nodes[head[rows]], nodes[rows])]
            for at in first[~whole[first]]:
                to = at + size[np.searchsorted(first, at)]
                links += forest(shapes[at:to], nodes[at:to], most)
            a, b = (np.concatenate(x) for x in zip(*links, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(2)] + [np.stack([batch.column(2 + i).to_numpy() for i in range(SHAPE)], axis=1).view(np.uint64)]
            held = now if held is None else [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
            if not len(held[0]):
                continue
            end = int(np.searchsorted(held[0], held[0][-1]))  # k ascends; the last bucket may go on
            if end:
                yield from found(*(x[:end] for x in held))
                held = [x[end:] for x in held]
        if held is not None and len(held[0]):
            yield from found(*held)

    return each


def links(classes: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect what all pairs within the radius and the similarity connect; classes(node, fp, s0...).

    Tables carry nothing but a hash of what a mask reads and the node; shapes join those alone that meet another class
    somewhere. A bucket of at most `bucket` classes is one pass over its sorted rows; larger ones are dealt out again by
    a second set of masks.
    """
    keyed = lambda df, masks, *more: df.select("node", F.explode(F.array(*[F.xxhash64(*more, F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("k"))
    counted = lambda df: df.withColumn("n", F.count("*").over(Window.partitionBy("k"))).filter("n > 1")
    met = saved(counted(keyed(classes, MASKS)), "met")
    shaped = classes.select("node", *_COLUMNS)
    crowded = met.filter(F.col("n") > bucket).select("node", F.col("k").alias("of")).join(classes, "node")
    finer = counted(keyed(crowded, MASKS_2, F.col("of")))
    compared = met.filter(F.col("n") <= bucket).select("k", "node").union(finer.select("k", "node")).join(shaped, "node")
    dealt = compared.select("k", "node", *_COLUMNS).repartition("k").sortWithinPartitions("k", "node")
    return dealt.mapInArrow(_links(most_bits(similarity)), "a long, b long").distinct()


def kept_rows(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """One row of each group of near copies in docs(doc_id, text, ...): the one with the smallest doc_id.

    Groups are the connected parts of the links between texts. Rows without a doc_id come last in a group, and among
    rows with one doc_id the hash of all columns decides, so that each row is judged by its own text; repeated rows are
    one. Texts of fewer words than a shingle are one shingle; null and empty texts are copies of each other; very long
    texts are taken whole; an empty table gives no rows. All columns come back; none but doc_id and text decides a link.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    row_key = F.xxhash64(*names)
    marked = saved(printed(docs.select("doc_id", text_or_empty(F.col("text")).alias("text"), row_key.alias("row_key")), "row_key", shingle), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    # numbered once: the ids are written with the classes
    classes = saved(marked.groupBy("fp", *_COLUMNS).agg(first).withColumn("node", F.monotonically_increasing_id()), "classes")
    edges = saved(links(classes, similarity, bucket), "links")
    roots = connected_components(edges)
    dropped(edges)
    groups = classes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("first").alias("first"))
    kept = groups.select(F.col("first.doc_id").alias("kept_doc"), F.col("first.row_key").alias("kept_key"))
    again = marked.groupBy("doc_id", "row_key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("kept_doc"), F.col("row_key").alias("kept_key"))
    # the rows' own columns travel as one, so that they may have any names
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("doc"), row_key.alias("key"))
    same = F.col("doc").eqNullSafe(F.col("kept_doc")) & (F.col("key") == F.col("kept_key"))
    several = kept.join(again, kept["kept_doc"].eqNullSafe(again["kept_doc"]) & (kept["kept_key"] == again["kept_key"]), "left_semi")
    # rows that repeat are few: only they are compared with each other
    once = rows.join(kept, same, "left_semi").join(several, same, "left_anti")
    return once.union(rows.join(several, same, "left_semi").distinct()).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
