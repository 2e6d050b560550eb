"""Benchmark decontamination by spaced seeds: hashes under fixed masks, then aligned overlaps that allow substitutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, saved, text_or_empty

#: Token positions that a seed reads; it ignores the one left out. Of 20 aligned tokens with any four substituted, one
#: of the two seeds hits at least once.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 2, 3, 5))
#: One more for items of fewer than SHORT tokens: with it, all lengths from MIN_TOKENS on are hit within tolerance.
SHORT_MASK, SHORT = (0, 1, 2, 3), 16
#: An overlap is this many aligned tokens, or the whole item if shorter, of which this share is equal.
OVERLAP, SHARE = 20, 0.8
#: Items with fewer tokens are looked for whole, all tokens equal.
MIN_TOKENS = 8
#: Benchmark hashes that may be broadcast, about 24 bytes each; more are joined by a shuffle.
MAX_BROADCAST = 500_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}]+"), "")


def masks_for(size: int) -> list[tuple[int, ...]]:
    """The masks that find an item of this many tokens."""
    if size < MIN_TOKENS:
        return [tuple(range(size))] if size else []
    return [*MASKS, SHORT_MASK] if size < SHORT else [*MASKS]


def _hashed(df: DataFrame, words: str, masks: list[tuple[int, ...]], *keep: str, own: bool = False) -> DataFrame:
    """One row a mask and position at which it fits: keep, at (the position) and h; own: only the masks for the size of words."""
    width = max(max(m) for m in masks) + 1
    zipped = F.arrays_zip(*[F.slice(words, k + 1, F.size(words)) for k in range(width)])
    names = [str(k) for k in range(width)]
    rows = df.select(*keep, F.size(words).alias("size"), F.posexplode(zipped).alias("at", "w"))

    def of_mask(m: tuple[int, ...]) -> Column:
        fits = F.col("w")[names[max(m)]].isNotNull()
        if own:
            fits &= F.col("size").isin([n for n in range(1, SHORT) if m in masks_for(n)]) | ((F.col("size") >= SHORT) & F.lit(m in MASKS))
        return F.when(fits, F.xxhash64(F.lit(str(m)), *[F.col("w")[names[k]] for k in m]))

    return rows.select(*keep, "at", F.explode(F.array(*[of_mask(m) for m in masks])).alias("h")).filter("h is not null")


def best_overlap(doc: Column, item: Column, diagonal: Column) -> Column:
    """Most equal tokens in an overlap of the item and the document shifted by the diagonal (document's place minus
    item's), as a struct (equal, needed); null if what is aligned is shorter than an overlap."""
    start = F.greatest(-diagonal, F.lit(0))
    length = F.least(F.size(item), F.size(doc) - diagonal) - start
    want = F.least(F.lit(OVERLAP), F.size(item))
    equal = F.zip_with(F.slice(item, start + 1, length), F.slice(doc, start + diagonal + 1, length), lambda a, b: (a == b).cast("int"))
    window = lambda e, i: F.aggregate(F.slice(e, i, want), F.lit(0), lambda s, x: s + x)
    most = let(equal, lambda e: F.array_max(F.transform(F.sequence(F.lit(1), F.size(e) - want + 1), lambda i: window(e, i))))
    return F.when(length >= want, F.struct(most.alias("equal"), F.when(want < MIN_TOKENS, want.cast("long")).otherwise(F.ceil(SHARE * want)).alias("needed")))


def _counted(df: DataFrame, most: int) -> DataFrame:
    """A saved table as one to broadcast, if it has at most `most` rows."""
    return F.broadcast(df) if df.count() <= most else df


def _overlaps(docs: DataFrame, items: DataFrame, max_broadcast: int) -> DataFrame:
    """(doc_id, text_key, item_id, best) for each row of docs and item that share an overlap; equal texts of one doc_id once."""
    bench = items.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("item")).filter(F.size("item") > 0).distinct()
    bench = saved(bench.withColumn("item_key", F.xxhash64("item")), "benchmark")
    short = [r["n"] for r in bench.select(F.size("item").alias("n")).filter(F.col("n") < SHORT).distinct().collect()]  # 15 rows at most
    masks = list(dict.fromkeys([*MASKS, *[m for n in sorted(short) for m in masks_for(n)]]))
    known = saved(_hashed(bench, "item", masks, "item_id", "item_key", own=True).withColumnRenamed("at", "item_at").distinct(), "seeds")
    known = _counted(known, max_broadcast)  # four numbers a row
    text = text_or_empty(F.col("text"))
    ours = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), tokens(F.col("text")).alias("words"))
    hits = _hashed(ours, "words", masks, "doc_id", "text_key").join(known, "h").select("doc_id", "text_key", "item_id", "item_key", (F.col("at") - F.col("item_at")).alias("diagonal"))
    # one row a document and item, with as many diagonals as the two have tokens at most
    hits = saved(hits.groupBy("doc_id", "text_key", "item_id", "item_key").agg(F.collect_set("diagonal").alias("diagonals")), "hits")
    hits = hits.withColumnsRenamed({"doc_id": "hit_doc", "text_key": "hit_key", "item_id": "hit_item"})
    with_item = hits.join(bench, hits["hit_item"].eqNullSafe(bench["item_id"]) & (hits["item_key"] == bench["item_key"])).select("hit_doc", "hit_key", "item_id", "item", "diagonals")
    # texts without a hit are left out before the texts with one are shuffled
    texts = _counted(saved(hits.select(F.col("hit_key").alias("text_key")).distinct(), "hit-texts"), max_broadcast)
    some = ours.join(texts, "text_key", "left_semi").distinct()
    both = some.join(with_item, some["doc_id"].eqNullSafe(with_item["hit_doc"]) & (some["text_key"] == with_item["hit_key"]))
    best = F.array_max(F.transform("diagonals", lambda g: best_overlap(F.col("words"), F.col("item"), g)))
    return both.select("doc_id", "text_key", "item_id", best.alias("best")).filter("best.equal >= best.needed")


def contaminated(docs: DataFrame, items: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, item_id, n_equal, n_needed): each document and benchmark item that share an overlap, one row a pair.

    docs(doc_id, text), items(item_id, text). Tokens are lower-cased runs of letters and digits, so that case and
    punctuation don't hide a passage. Only places that share a seed's hash are aligned; n_equal counts equal tokens in
    the best overlap. Items of fewer than MIN_TOKENS tokens are found where all their tokens stand in a row. Texts and
    items without tokens are in no pair; repeated rows give one pair; a null doc_id or item_id is an id like any other;
    very long texts are searched whole; empty tables give no rows; other columns are ignored.
    """
    found = _overlaps(docs, items, max_broadcast)
    return found.groupBy("doc_id", "item_id").agg(F.max("best.equal").cast("long").alias("n_equal"), F.max("best.needed").cast("long").alias("n_needed"))


def decontaminated(docs: DataFrame, items: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs without the rows whose own text is contaminated; rows of other texts that share their doc_id stay."""
    bad = _overlaps(docs, items, max_broadcast).select(F.col("doc_id").alias("bad_doc"), F.col("text_key").alias("bad_key")).distinct()
    bad = _counted(saved(bad, "contaminated"), max_broadcast)
    key = F.xxhash64(text_or_empty(docs["text"]))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["bad_doc"]) & (key == bad["bad_key"]), "left_anti")
