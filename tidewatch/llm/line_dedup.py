"""Line dedup by overlapping windows of three lines that occur again anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, let, saved, text_or_empty

WINDOW = 3


def _with_lines(docs: DataFrame, *keep: Column) -> DataFrame:
    text = text_or_empty(F.col("text"))
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(F.regexp_replace(x, GAP, " ")).alias("t")))
    return docs.select(*keep, F.col("doc_id").cast("long").alias("line_doc"), F.xxhash64(text).alias("text_key"), F.filter(numbered, lambda x: x["t"] != "").alias("lines"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """line_doc, text_key and gone, an ascending array of 0-based line numbers to remove, of documents that lose lines.

    A window is three consecutive lines with a word, white space evened out, known by 128 hash bits. Of the places of a
    window that occurs more than once, the first in the order of doc_id, text and line stays; the lines of the later
    ones go, even if another window's first place holds them too: windows are judged on the input. Places of a common
    window are counted before the shuffle; the join that marks them can split its hot keys.
    """
    hashed = F.transform(F.sequence(F.lit(1), F.size("lines") - (WINDOW - 1)), lambda k: _window(F.slice("lines", k, WINDOW)))
    places = _with_lines(docs).filter(F.size("lines") >= WINDOW).select("line_doc", "text_key", F.inline(hashed))
    places = saved(places, "windows")
    at = F.struct("line_doc", "text_key", "first_line")
    found = places.groupBy("h1", "h2").agg(F.min(at).alias("kept"), F.max(at).alias("last")).filter("kept != last").drop("last")
    later = places.join(found, ["h1", "h2"]).filter(~(F.struct("line_doc", "text_key", "first_line") == F.col("kept")))
    gone = F.array_sort(F.array_distinct(F.flatten(F.collect_set("covered"))))
    return later.groupBy("line_doc", "text_key").agg(gone.alias("gone"))


def _window(three):
    texts = F.transform(three, lambda x: x["t"])
    return F.struct(F.xxhash64(texts).alias("h1"), F.xxhash64(F.lit(1), texts).alias("h2"), F.get(three, F.lit(0))["i"].alias("first_line"), F.transform(three, lambda x: x["i"]).alias("covered"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with n_lines (lines with a word), n_removed and text, from which the removed lines went; all else stays.

    Rows with equal doc_id and equal text count as one document and lose the same lines. Documents of fewer than three
    lines with a word, null and empty texts lose none; a null doc_id comes before all others; very long texts are cut
    into lines whole; an empty table gives no rows. Columns named n_lines or n_removed are replaced; others may have any
    name, as they travel as one.
    """
    gone = repeated_lines(docs)
    other = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    counted = _with_lines(docs, F.struct(*[F.col(f"`{c}`") for c in other]).alias("row"))
    key = [F.col("line_doc").eqNullSafe(F.col("g_doc")), F.col("text_key") == F.col("g_key")]
    joined = counted.join(gone.select(F.col("line_doc").alias("g_doc"), F.col("text_key").alias("g_key"), "gone"), key[0] & key[1], "left")
    raw = F.split("row.text", "\n")
    left = let(raw, lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "gone"), lambda i: F.get(x, i)))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    return joined.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in other], F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
