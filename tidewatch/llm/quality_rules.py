"""Quality rules: base counts of a document, then the frequency of its lines across the documents of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, let, saved, text_or_empty, words_of

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: A line is frequent on a host if more distinct documents than both of these have it: a number, a share of the host's.
MIN_DOCUMENTS, MAX_SHARE = 20, 0.1
#: A document of which less than this share of words is left after frequent lines went is depleted.
MIN_LEFT = 0.2


def normal_line(line: Column) -> Column:
    """The form in which lines are compared across documents: lower case, single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), GAP, " "))


def covered_words(starts: Column, width: int) -> Column:
    """How many positions the windows of this width at these ascending starts cover together."""
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"))
    return F.aggregate(starts, F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def repeated_starts(hashes: Column) -> Column:
    """Ascending 0-based positions of the hashes that occur twice or more, by one sort."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda e, j, x: F.coalesce(F.get(e, j)["h"] == x["h"], F.lit(False))
    twice = let(pairs, lambda e: F.filter(e, lambda x, j: ((j > 0) & same(e, F.greatest(j - 1, F.lit(0)), x)) | same(e, j + 1, x)))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def base_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row a document: doc_id, host, row_key, the base counts and its lines as (hash, words)."""
    text = text_or_empty(F.col("text"))
    step = docs.select(F.col("doc_id").cast("long"), F.col(host).alias("host"), text.alias("text"), words_of(F.col("text")).alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("raw"))
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    step = step.select("*", windows.alias("windows"))
    repeats = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), covered_words(repeated_starts(F.col("windows")), WINDOW)).otherwise(0)
    lines = F.transform("raw", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.size(words_of(x)).alias("w"), F.length(x).alias("c")))
    return step.select(
        "doc_id",
        "host",
        F.xxhash64("text", "host").alias("row_key"),
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        F.transform(lines, lambda x: F.struct(x["h"].alias("h"), x["w"].alias("w"))).alias("lines"),
    ).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def frequent_lines(counts: DataFrame, min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, h, n_docs) of the lines above both limits; counts: from base_counts.

    Documents are told apart by their whole text (row_key), so that exact copies count once: a line that stands in many
    copies of one text isn't boilerplate. Each line is first reduced to one row a host and document; a line in a third
    of all documents is summed up before the shuffle.
    """
    held = counts.select("host", "row_key", F.explode("lines").alias("x")).select("host", "row_key", F.col("x.h").alias("h"))
    by_line = held.groupBy("host", "h", "row_key").agg(F.lit(1)).groupBy("host", "h").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > min_documents)
    by_host = counts.groupBy("host", "row_key").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("n_host"))
    return by_line.join(by_host, by_line["host"].eqNullSafe(by_host["host"])).filter(F.col("n_docs") > max_share * F.col("n_host")).select(by_line["host"], "h", "n_docs")


def _judged(counts: DataFrame, min_documents: int, max_share: float, min_left: float) -> DataFrame:
    """counts with gone_lines (hashes of the row's frequent lines; null if none), n_words_frequent and kept.

    A document's frequent lines come back to it as one array, which its own lines bound.
    """
    often = frequent_lines(counts, min_documents, max_share).withColumnRenamed("host", "on")
    at = counts.select("doc_id", "row_key", "host", F.posexplode("lines").alias("at", "x")).select("doc_id", "row_key", "host", "at", "x.*")
    hit = at.join(often, (at["h"] == often["h"]) & at["host"].eqNullSafe(often["on"]), "left_semi")
    # a repeated row has each of its lines once
    removed = hit.groupBy("doc_id", "row_key", "at").agg(F.max("w").alias("w"), F.max("h").alias("h")).groupBy("doc_id", "row_key").agg(F.sum("w").alias("gone"), F.collect_set("h").alias("gone_lines"))
    removed = removed.select(F.col("doc_id").alias("d"), F.col("row_key").alias("k"), "gone", "gone_lines")
    out = counts.join(removed, counts["doc_id"].eqNullSafe(removed["d"]) & (counts["row_key"] == removed["k"]), "left").withColumn("n_words_frequent", F.coalesce("gone", F.lit(0).cast("long")))
    depleted = F.col("n_words") - F.col("n_words_frequent") < min_left * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def quality_rules(docs: DataFrame, host: str = "source", min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The verdict on every row of docs(doc_id, text, host).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_words_frequent
    (words in frequent lines) and row_key, a hash of text and host that tells rows with one doc_id apart. A document is
    kept unless the base rules fail it or frequent lines hold so much of it that less than min_left of its words is
    left. A null text counts as empty and fails; a null host is a host of its own; repeated rows and a null doc_id each
    get their row; very long texts are counted whole; an empty table gives none; other columns are ignored.
    """
    out = _judged(saved(base_counts(docs, host), "quality"), min_documents, max_share, min_left)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_frequent", "row_key")


def cleaned(docs: DataFrame, host: str = "source", min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """docs without the rows that quality_rules rejects, the frequent lines of each host taken out of the texts of the rest.

    All columns stay, whatever their names, as they travel as one; the cases are those of quality_rules. Only rows that
    change or go are looked up, by doc_id and a hash of text and host, so that each row is decided by its own text.
    """
    judged = _judged(saved(base_counts(docs, host), "quality"), min_documents, max_share, min_left)
    marks = judged.filter("not kept or gone_lines is not null").groupBy("doc_id", "row_key").agg(F.first("kept").alias("stays"), F.first("gone_lines").alias("gone_lines"))
    marks = marks.select(F.col("doc_id").alias("marked_doc"), F.col("row_key").alias("marked_key"), "stays", "gone_lines")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text_or_empty(F.col("text")), F.col(host)).alias("key"))
    joined = rows.join(marks, F.col("doc").eqNullSafe(F.col("marked_doc")) & (F.col("key") == F.col("marked_key")), "left").filter(F.coalesce("stays", F.lit(True)))
    left = F.array_join(F.filter(F.split("row.text", "\n"), lambda x: ~F.array_contains("gone_lines", F.xxhash64(normal_line(x)))), "\n")
    text = F.when(F.col("gone_lines").isNull(), F.col("row.text")).otherwise(left)
    return joined.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
