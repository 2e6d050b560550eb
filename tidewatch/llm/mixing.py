"""Mixing sources to target weights by soft membership.

A classifier learned from a labelled table gives each document a posterior over domains. Nonnegative document rates are
then fitted by projected-gradient least squares, so that the expected tokens of each domain, the sum over documents of
rate, tokens and posterior, meet its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, dropped, let, sampled, saved, text_or_empty

#: Word features are hashed into so many buckets; tokens of evidence at which a posterior stops sharpening.
BUCKETS, EVIDENCE = 4096, 300.0
#: Projected-gradient steps at most, and the relative error of all domain totals at which they end.
STEPS, TOLERANCE = 30, 5e-3
#: Newton steps at most, for targets that the gradient has not met by then.
NEWTON = 20
#: Labelled documents that may train the classifier, those with the smallest hashes of their doc_id.
MOST_ROWS = 20_000
#: Production targets: domain -> share of tokens. Domains are quality and toxicity labels.
TARGETS = {"q1t0": 0.9, "q1t1": 0.02, "q0t0": 0.07, "q0t1": 0.01}


def domain_of_labels(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) as (doc_id, domain); labels that are not 0 or 1 are left out, the least of several counts."""
    name = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))
    sound = labels.filter("doc_id is not null and quality in (0, 1) and toxic in (0, 1)")
    return sound.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(name).alias("domain"))


def features(text: Column) -> Column:
    """Buckets of a text's word features: a word's signs if it has any but stops and commas, else the lower-cased word."""
    # a run begins where none goes on and is taken whole, so that each character is looked at once
    signs = F.regexp_replace(F.lower(text_or_empty(text)), r"(?<![\p{L}\p{N}.,])[\p{L}\p{N}.,]++([^\p{L}\p{N}.,\s]+)", "$1")
    words = F.array_remove(F.split(signs, r"[\s.,]+"), "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def learned(marked: DataFrame, domains: Sequence[str]) -> dict[str, tuple[float, list[float]]]:
    """Naive Bayes with add-one smoothing: domain -> (log prior, log likelihood of each bucket).

    marked(domain, buckets). Counts are summed by Spark; what comes to the driver has BUCKETS x domains rows at most.
    """
    import math

    names = list(domains)
    counted = marked.filter(F.col("domain").isin(names))
    docs = {r["domain"]: r["n"] for r in counted.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    table = {d: [1.0] * BUCKETS for d in names}
    for r in counted.select("domain", F.explode("buckets").alias("b")).groupBy("domain", "b").agg(F.count("*").alias("n")).collect():
        table[r["domain"]][r["b"]] += r["n"]
    total = sum(docs.values()) + len(names)
    out = {}
    for d in names:
        mass = sum(table[d])
        out[d] = (math.log((docs.get(d, 0) + 1) / total), [math.log(x / mass) for x in table[d]])
    return out


def posteriors(buckets: Column, model: dict[str, tuple[float, list[float]]]) -> Column:
    """Logits of each domain as an array in the model's order.

    Log likelihoods are scaled by EVIDENCE / (EVIDENCE + words), so that a long text is no surer than its mean word
    makes it; without words the posterior is the prior.
    """
    names = list(model)
    scale = F.lit(EVIDENCE) / (F.lit(EVIDENCE) + F.size(buckets))

    def logit(prior: float, weights: list[float]) -> Column:
        # one literal text, folded once: thousands of literals would make the plan slow
        table = F.from_json(F.lit("[" + ",".join(f"{w:.9g}" for w in weights) + "]"), "array<double>")
        return F.lit(prior) + scale * F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(table, b))

    return F.array(*[logit(*model[d]) for d in names])


def soft_membership(logits: Column) -> Column:
    """Softmax of an array of logits."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    mass = let(logits, lambda x: let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))))
    return let(mass, lambda m: let(total(m), lambda t: F.transform(m, lambda x: x / t)))


def fitted_rates(rows: DataFrame, targets: Sequence[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> list[list[float]]:
    """The rate of a posterior follows from the errors returned, one array of domains a step: see rate_of.

    rows(p, n_tokens): posterior and tokens of every document; each step is one pass that only sums. The objective is
    the sum over domains of the squared error of its total over its total at rate 1; steps are taken in the metric in
    which a document weighs its tokens, where the gradient of a rate is the posterior times the errors, and the
    projection is a cut at 0. In this scale the Hessian's rows sum to 1, so that a step of 1 never overshoots. Small
    domains converge slowly: what is left after `steps` goes by Newton steps over the documents with a rate above 0, of
    which only the domains x domains sums come to the driver, as long as they lessen the worst error.
    """
    import numpy as np

    k = len(targets)
    errors: list[list[float]] = []
    base = None
    least = None
    for n in range(steps + NEWTON + 1):
        rated = rows.select("p", "n_tokens", rate_of("p", errors).alias("rate"))
        shares = [F.get("p", F.lit(i)) for i in range(k)]
        sums = [F.sum(F.col("n_tokens") * F.col("rate") * x) for x in shares]
        if n >= steps:
            sums += [F.sum(F.when(F.col("rate") > 0, F.col("n_tokens") * x * y)) for x in shares for y in shares]
        found = [x or 0.0 for x in rated.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()]
        now = found[:k]
        base = base or now
        off = [(s - t) / b if b else 0.0 for s, t, b in zip(now, targets, base, strict=True)]
        worst = max((abs(o) * b / t if t else abs(o) for o, b, t in zip(off, base, targets, strict=True)), default=0)
        if least is not None and worst >= least:
            return errors[:-1]
        if worst < tolerance or n == steps + NEWTON:
            return errors
        if n < steps:
            errors.append(off)
            continue
        least = worst
        scale = np.sqrt([b or 1.0 for b in base])
        hessian = np.array(found[k:]).reshape(k, k) / np.outer(scale, scale)
        left = np.array([s - t for s, t in zip(now, targets, strict=True)]) / scale
        errors.append((np.linalg.lstsq(hessian, left, rcond=1e-9)[0] / scale).tolist())
    return errors


def rate_of(p: str, errors: list[list[float]]) -> Column:
    """The rate that the steps with these errors give a posterior in column p: from 1, each step subtracts the expected
    error and cuts at 0."""
    rate = "1D"
    for e in errors:  # in SQL, which is compiled; functions on arrays are not
        rate = f"greatest(0D, {rate} - (" + " + ".join(f"{p}[{i}] * ({x!r}D)" for i, x in enumerate(e)) + "))"
    return F.expr(rate)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, keep: Sequence[str] = (), most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, n_tokens, posterior, rate and copies of every row of docs(doc_id, text), and the columns to keep.

    targets: domain -> weight, of which the shares count; budget: expected tokens of the result, by default those of the
    input. At most `most_rows` labels train the classifier; they are broadcast to the documents, so that no text or
    feature is shuffled; rates and totals cover every document. n_tokens counts words. copies is the rate rounded to a
    whole number: its whole part, and one more if a hash of doc_id and text falls below the rest, so that expected
    totals hold and a rerun decides alike. A domain without labels still has its prior; targets that no nonnegative
    rates meet are met as closely as least squares can. Null and empty texts have no tokens and the prior as posterior;
    a null doc_id is hashed like any other; repeated rows get equal rows; very long texts are taken whole; an empty table
    gives none; other columns are ignored.

    Features are worked out for the labelled documents and then, in one pass that writes each document once with its
    posterior and the columns to keep, for all.
    """
    targets = targets or TARGETS
    names = sorted(targets)
    text = text_or_empty(F.col("text"))
    few = saved(sampled(domain_of_labels(labels), most_rows), "chosen")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id")  # most_rows short rows
    training = saved(known.select("domain", features(F.col("text")).alias("buckets")), "training")
    model = learned(training, names)
    dropped(few, training)
    n_tokens = F.size(F.array_remove(F.split(text, GAP), "")).cast("long")
    rows = docs.select(*keep, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("draw"), n_tokens.alias("n_tokens"), features(F.col("text")).alias("buckets"))
    members = rows.select(*keep, "doc_id", "draw", "n_tokens", soft_membership(posteriors(F.col("buckets"), model)).alias("p"))
    members = saved(members, "memberships")
    total = members.agg(F.sum("n_tokens")).first()[0] or 0
    mass = sum(targets.values())
    errors = fitted_rates(members, [targets[d] / mass * (budget or total) for d in names])
    out = members.withColumn("rate", rate_of("p", errors))
    part = F.shiftrightunsigned(F.xxhash64("draw"), 11).cast("double") / 2.0**53
    copies = F.floor("rate") + (part < F.col("rate") - F.floor("rate")).cast("long")
    named = F.map_from_arrays(F.array(*[F.lit(d) for d in names]), F.col("p"))
    return out.select(*keep, "doc_id", "n_tokens", named.alias("posterior"), "rate", copies.cast("long").alias("copies"))
