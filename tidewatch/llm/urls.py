"""URL filters: host and path rules, and for what no rule fits, the ratio of two character language models."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: What the models tell apart; start signs and the end sign besides. Digits are one symbol, the rest is "_".
ALPHABET = string.ascii_lowercase + "0./-_^$"
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: up to ``?``, ``#`` or the end."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        on, slash, below = text.partition("/")
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(slash + below)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def symbols(host: Column, path: Column) -> Column:
    """What the models read: two start signs, the mapped host and path, an end sign."""
    low = F.regexp_replace(F.lower(F.concat(host, path)), "[0-9]", "0")
    return F.concat(F.lit("^^"), F.regexp_replace(low, "[^a-z0./-]", "_"), F.lit("$"))


def log_ratio(grams: DataFrame) -> DataFrame:
    """(g, ratio): for each three symbols, the logarithm of the last one's likelihood among accepted over rejected URLs.

    grams(g, accepted, rejected) has how often each group of three occurs. Each model has variable order by Witten-Bell
    smoothing: the estimate after two symbols gives way to that after one, that to the one after none, that to the same
    for all; a context gives way by the number of different symbols that follow it. At most len(ALPHABET)**3 rows.
    """
    out = grams.select("g", F.substring("g", 2, 1).alias("b"), F.substring("g", 3, 1).alias("c"), F.substring("g", 1, 2).alias("ab"), F.substring("g", 2, 2).alias("bc"), "accepted", "rejected")
    for kind in ("accepted", "rejected"):
        n = out.groupBy("c").agg(F.sum(kind).alias("n"))
        total = n.agg(F.sum("n").alias("all"), F.count_if(F.col("n") > 0).alias("kinds"))
        none = n.crossJoin(total).select("c", F.coalesce(F.try_divide(F.col("n") + F.col("kinds") / len(ALPHABET), F.col("all") + F.col("kinds")), F.lit(1 / len(ALPHABET))).alias("p0"))  # one row of totals
        pairs = out.groupBy("b", "c", "bc").agg(F.sum(kind).alias("n"))
        after = pairs.groupBy("b").agg(F.sum("n").alias("all"), F.count_if(F.col("n") > 0).alias("kinds"))
        one = pairs.join(after, "b").join(none, "c").select("bc", F.when(F.col("all") > 0, (F.col("n") + F.col("kinds") * F.col("p0")) / (F.col("all") + F.col("kinds"))).otherwise(F.col("p0")).alias("p1"))
        after = out.groupBy("ab").agg(F.sum(kind).alias("all"), F.count_if(F.col(kind) > 0).alias("kinds"))
        two = F.when(F.col("all") > 0, (F.col(kind) + F.col("kinds") * F.col("p1")) / (F.col("all") + F.col("kinds"))).otherwise(F.col("p1"))
        out = out.join(after, "ab").join(one, "bc").withColumn(f"p_{kind}", two).drop("all", "kinds", "p1")
    return out.select("g", (F.ln("p_accepted") - F.ln("p_rejected")).alias("ratio"))


def judged_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of pages(page_id, url).

    URLs that a rule allows or blocks train the accepted and the rejected model. What no rule fits is allowed if its
    score, the log-likelihood difference per symbol, reaches a threshold: the point that is as many standard deviations
    below the accepted mean as above the rejected one. A quarter of the ruled URLs, by a hash of their symbols, train no
    model and give the threshold; where they lack a kind, all ruled URLs do. Without ruled URLs of both kinds, what no
    rule fits is allowed. Equal symbol strings are counted and scored once; scores are rounded to nine digits, so that
    the order of a sum decides nothing. A null url, or one without ``://``,
    has an empty host and path, which no rule fits; repeated rows and null page_ids each get their row; an empty table
    gives none; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = split.select("*", rule.alias("rule"), verdict.alias("ruled"), symbols(F.col("host"), F.col("path")).alias("s"))
    # what several rules fit together can differ for one string of symbols, so kinds are counted apart
    held = F.substring(F.md5("s"), 1, 1).isin("0", "1", "2", "3")
    strings = saved(rows.groupBy("s").agg(F.count_if(F.col("ruled") == "allow").alias("accepted"), F.count_if(F.col("ruled") == "block").alias("rejected")), "strings")
    cut = F.transform(F.sequence(F.lit(1), F.length("s") - 2), lambda i: F.substring(F.col("s"), i, F.lit(3)))
    each = strings.select("*", F.explode(cut).alias("g"))
    learns = lambda kind: F.sum(F.when(held, 0).otherwise(F.col(kind))).alias(kind)
    grams = saved(each.groupBy("g").agg(learns("accepted"), learns("rejected")), "grams")
    ratio = F.broadcast(saved(log_ratio(grams), "ratio"))  # at most 36,000 short rows
    scored = saved(each.join(ratio, "g").groupBy("s").agg(F.round(F.avg("ratio"), 9).alias("score"), F.first("accepted").alias("accepted"), F.first("rejected").alias("rejected")), "scores")

    def between(part: Column) -> tuple[Column, Column]:
        """Whether this part of the ruled URLs has both kinds, and the point between their scores."""
        of = {k: F.when(part, F.col(k)).otherwise(0) for k in ("accepted", "rejected")}
        n = {k: F.sum(x) for k, x in of.items()}
        mean = {k: F.sum(x * F.col("score")) / F.nullif(n[k], F.lit(0)) for k, x in of.items()}
        square = {k: F.sum(x * F.col("score") * F.col("score")) / F.nullif(n[k], F.lit(0)) for k, x in of.items()}
        dev = {k: F.sqrt(F.greatest(square[k] - mean[k] * mean[k], F.lit(1e-12))) for k in of}
        at = (mean["accepted"] * dev["rejected"] + mean["rejected"] * dev["accepted"]) / (dev["accepted"] + dev["rejected"])
        return (n["accepted"] > 0) & (n["rejected"] > 0), at

    (both, at), (_, of_all) = between(held), between(F.lit(True))
    least = scored.agg(F.round(F.when(both, at).otherwise(of_all), 9).alias("least"))
    says = scored.crossJoin(F.broadcast(least)).select("s", "score", F.when(F.col("score") < F.col("least"), "block").otherwise("allow").alias("method"))  # one row
    return rows.join(says, "s", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "method").alias("verdict"), "score")
