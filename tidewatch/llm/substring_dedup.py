"""Substring dedup: words covered by a window of words that also starts elsewhere, found with FM-indexes.

A window can only occur twice where its minimizer does: the smallest hash of the grams inside it, which equal windows
share. So documents are cut into segments, runs of windows with one minimizer, and only segments whose minimizer occurs
again go further. They are dealt into shards by minimizer; each shard's distinct segments form a compressed FM-index,
and the segments themselves are streamed through it by backward search. Each shard sees every place of every window
that belongs to it, so the result is exact, and the work grows with the repeated text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved, text_or_empty
from .fm_index import FMIndex
from .passages import WordHashes, segments

WINDOW, GRAM = 35, 8
#: A minimizer with more distinct segments than this is dealt out by whole windows instead.
HOT = 1024
#: Words in one FM-index at most, but for what one key has; windows that are handed on at a time.
INDEX_WORDS, TOGETHER = 400_000, 20_000


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))


def _cut(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                split = [t.split() for t in batch.column(2).to_pylist()]
                starts = np.r_[0, np.cumsum([len(w) for w in split])]
                of, first, count, low, places = segments(known.of([w for words in split for w in words]), starts, window, min(GRAM, window))
                keys = [batch.column(i).take(pa.array(of)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(low.view(np.int64)), pa.array(places.astype(np.int32))], names=["doc_id", "text_key", "first", "n", "minimizer", "places"])

    return each


def _content(words: bytes) -> bytes:
    return xxhash.xxh128_digest(words)


def _passages(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, text_key, text, parts) to one row a part: its words joined by a space and their 128-bit hash."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, parts = batch.column(2)[i].as_py().split(), batch.column(3)[i].values
                first, n, low = (parts.field(k) for k in range(3))
                texts = [b" ".join(words[a : a + b + window - 1]) for a, b in zip(first.to_pylist(), n.to_pylist(), strict=True)]
                same = [pa.array([batch.column(k)[i].as_py()] * len(texts), pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, first, n, low, pa.array([_content(t) for t in texts], pa.binary()), pa.array(texts, pa.binary())], names=["doc_id", "text_key", "first", "n", "minimizer", "content", "words"])

    return each


def _windows(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (content, words, copies) to one row a window: its place in the segment, its words and their hash."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["content", "at", "piece", "words", "copies"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for content, text, copies in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = text.split(b" ")
                for i in range(len(words) - window + 1):
                    one = b" ".join(words[i : i + window])
                    out.append((content, i, _content(one), one, copies))
                    if len(out) >= TOGETHER:
                        yield made(out)
                        out = []
            if out:
                yield made(out)

    return each


def covered(pieces: list[list[bytes]], copies: list[int], window: int) -> list[list[tuple[int, int]]]:
    """For each piece, the (start, end) word ranges that windows with two places or more cover, by one FM-index.

    A place of a piece counts as often as the piece has copies. A piece with copies is repeated as a whole.
    """
    lengths = np.array([len(p) for p in pieces])
    codes, _ = pd.factorize(np.array([w for p in pieces for w in p], dtype=object))
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    text = np.zeros(int(ends[-1]), dtype=np.int64)
    place = np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(len(codes))
    text[place] = codes + 1
    index = FMIndex(text, int(codes.max()) + 2, np.repeat(np.array(copies), lengths + 1), window)
    single = np.flatnonzero(np.array(copies) < 2)
    n = lengths[single] - window + 1
    ask = np.repeat(starts[single] + window - 1 - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
    hit = index.matched(text, ask, window) >= window
    out: list[list[tuple[int, int]]] = [[(0, int(k))] if c > 1 else [] for k, c in zip(lengths, copies, strict=True)]
    owner = np.repeat(single, n)[hit]
    for p, begin in zip(owner.tolist(), (ask[hit] - window + 1 - starts[owner]).tolist(), strict=True):
        mine = out[p]
        if mine and begin <= mine[-1][1]:
            mine[-1] = (mine[-1][0], begin + window)
        else:
            mine.append((begin, begin + window))
    return out


def _searched(window: int, index_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (route, piece, words, copies) in the order of route to (piece, start, end)."""

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        found = covered([r[2].split(b" ") for r in rows], [r[3] for r in rows], window)
        out = [(r[1], a, b) for r, ranges in zip(rows, found, strict=True) for a, b in ranges]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["piece", "start", "end"]) if out else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if rows and size >= index_words and rows[-1][0] != row[0]:
                    if out := flush(rows):
                        yield out
                    rows, size = [], 0
                rows.append(row)
                size += row[2].count(b" ") + 1
        if rows and (out := flush(rows)):
            yield out

    return each


def repeated_ranges(docs: DataFrame, window: int = WINDOW, hot: int = HOT, index_words: int = INDEX_WORDS) -> DataFrame:
    """(doc_id, text_key, start, end): ranges of word positions that repeated windows cover; they can overlap.

    Rows with one doc_id and one text share the ranges. text_key is Spark's xxhash64 of the text.
    """
    keyed = _keyed(docs)
    cut = saved(keyed.mapInArrow(_cut(window), "doc_id long, text_key long, first int, n int, minimizer long, places int"), "segments")
    again = cut.groupBy("minimizer").agg(F.sum("places").alias("total")).filter("total > 1")
    mine = cut.join(again, "minimizer").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "n", "minimizer")).alias("parts"))
    mine = mine.withColumnsRenamed({"doc_id": "part_doc", "text_key": "part_key"})
    with_parts = keyed.join(mine, keyed["doc_id"].eqNullSafe(mine["part_doc"]) & (keyed["text_key"] == mine["part_key"])).select(keyed["doc_id"], "text_key", "text", "parts")
    places = saved(with_parts.mapInArrow(_passages(window), "doc_id long, text_key long, first int, n int, minimizer long, content binary, words binary"), "passages")
    dropped(cut)

    distinct = places.groupBy("minimizer", "content").agg(F.first("words").alias("words"), F.count("*").alias("copies"))
    distinct = saved(distinct, "distinct")
    crowded = distinct.groupBy("minimizer").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > hot)
    plain = distinct.join(crowded, "minimizer", "left_anti").select(F.col("minimizer").alias("route"), F.col("content").alias("piece"), "words", "copies")
    single = saved(distinct.join(crowded, "minimizer", "left_semi").select("content", "words", "copies").mapInArrow(_windows(window), "content binary, at int, piece binary, words binary, copies long"), "windows")
    alone = single.groupBy("piece").agg(F.first("words").alias("words"), F.sum("copies").alias("copies")).select(F.xxhash64("piece").alias("route"), "piece", "words", "copies")

    columns = "piece binary, start int, end int"
    routed = [x.repartition("route").sortWithinPartitions("route").mapInArrow(_searched(window, index_words), columns) for x in (plain, alone)]
    of_segment = routed[0].withColumnRenamed("piece", "content")
    of_window = routed[1].join(single.select("piece", "content", "at"), "piece").select("content", (F.col("start") + F.col("at")).alias("start"), (F.col("end") + F.col("at")).alias("end"))
    found = of_segment.union(of_window).groupBy("content").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    hits = places.select("doc_id", "text_key", "first", "content").join(found, "content")
    return hits.select("doc_id", "text_key", "first", F.inline("ranges")).select("doc_id", "text_key", (F.col("start") + F.col("first")).alias("start"), (F.col("end") + F.col("first")).alias("end"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            words, ranges = (batch.column(1)[i].as_py() or b"").split(), batch.column(2)[i].as_py()
            gone = np.zeros(len(words), dtype=bool)
            for r in ranges or ():
                gone[r["start"] : r["end"]] = True
            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if ranges else b" ".join(words)
            out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
        if out:
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT, index_words: int = INDEX_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (UTF-8 bytes) of every row of docs(doc_id, text).

    A word goes if a window of `window` consecutive words of its document covers it and the same words also start
    anywhere else, in the same document or another; windows are judged on the input. Words keep their case; kept words
    are joined by one space. A null or empty text has no words, a text shorter than a window loses none; a repeated row
    is a second place of its windows; a null doc_id is an id like any other; an empty table gives no rows; other columns
    are ignored.
    """
    ranges = repeated_ranges(docs, window, hot, index_words)
    by_doc = ranges.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("ranges")).withColumnsRenamed({"doc_id": "r_doc", "text_key": "r_key"})
    keyed = _keyed(docs)
    joined = keyed.join(by_doc, keyed["doc_id"].eqNullSafe(by_doc["r_doc"]) & (keyed["text_key"] == by_doc["r_key"]), "left").select(keyed["doc_id"], "text", "ranges")
    return joined.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
