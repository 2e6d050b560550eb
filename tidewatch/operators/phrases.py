"""Dictionaries of phrases: many phrases of several words found at once, with weights, required context and exclusions.

patterns(tag, phrase, weight, context, never): a pattern counts for a text that has its phrase, one at least of the
phrases of `context` if there are any, and none of `never`; words are what stands between other signs than letters and
digits, in lower case. A pattern counts once a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that are broadcast to the texts; a larger dictionary is joined by a shuffle of the texts' word runs.
MAX_BROADCAST = 100_000


def spelled(text: Column) -> Column:
    """The words of a text as an array."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def found_phrases(texts: DataFrame, key: str, text: str, phrases: DataFrame) -> DataFrame:
    """(key, has): the phrases of phrases(phrase) that each text has, as an array; texts without any have no row.

    Runs of words of each length that phrases have are looked up as they are, each once a text.
    """
    known = phrases.select(F.array_join(spelled(F.col("phrase")), " ").alias("run"), F.size(spelled(F.col("phrase"))).alias("n")).filter("n > 0").distinct()
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())  # a few numbers
    words = texts.select(key, spelled(F.col(text)).alias("_w"))
    runs = lambda n: F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: F.array_join(F.slice("_w", i + 1, n), " ")) if n > 1 else F.col("_w")
    none = F.array().cast("array<string>")
    each = F.array_distinct(F.concat(none, *[F.when(F.size("_w") >= n, runs(n)).otherwise(none) for n in lengths]))
    known = known.select("run")
    if known.count() <= MAX_BROADCAST:
        known = F.broadcast(known)
    hits = words.select(key, F.explode(each).alias("run")).join(known, "run")
    return hits.groupBy(key).agg(F.collect_set("run").alias("has"))


def tagged(texts: DataFrame, key: str, text: str, patterns: DataFrame, most: float = 100.0) -> DataFrame:
    """(key, tag, score, n): the weights of a text's patterns by tag, `most` at most, and how many patterns there are."""
    plain = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.array_join(spelled(x), " "))
    p = patterns.select("tag", F.array_join(spelled(F.col("phrase")), " ").alias("_phrase"), F.col("weight").cast("double").alias("weight"), plain("context").alias("context"), plain("never").alias("never"))
    every = p.select(F.explode(F.concat(F.array("_phrase"), "context", "never")).alias("phrase")).distinct()
    has = found_phrases(texts, key, text, every)
    if p.count() <= MAX_BROADCAST:
        p = F.broadcast(p)
    hits = has.select(key, "has", F.explode("has").alias("_phrase")).join(p, "_phrase")
    allowed = ((F.size("context") == 0) | F.arrays_overlap("has", "context")) & ~F.arrays_overlap("has", "never")
    return hits.filter(allowed).groupBy(key, "tag").agg(F.least(F.sum("weight"), F.lit(most)).alias("score"), F.count("*").alias("n"))
