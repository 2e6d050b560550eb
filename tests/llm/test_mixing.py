import math
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import mixing


def fit(p, tokens, target, steps=mixing.STEPS):
    """Projected gradient over single documents, not groups."""
    rate = np.ones(len(tokens))
    base = (tokens[:, None] * p).sum(0)
    for _ in range(steps):
        off = ((rate * tokens)[:, None] * p).sum(0) - target
        if max(abs(off) / target) < mixing.TOLERANCE:
            break
        rate = np.maximum(0, rate - p @ (off / base))
    return rate


@pytest.fixture(scope="module")
def result(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return mixing.mixed(docs, labels).toPandas().sort_values("doc_id")


def test_rates_meet_the_targets_and_equal_brute_force(result):
    names = sorted(mixing.TARGETS)
    p = np.array([[r[d] for d in names] for r in result.posterior])
    assert np.allclose(p.sum(1), 1)
    tokens = result.n_tokens.to_numpy(float)
    target = np.array([mixing.TARGETS[d] for d in names]) * tokens.sum()
    assert np.allclose(result.rate, fit(p, tokens, target), atol=1e-6)
    reached = ((result.rate.to_numpy() * tokens)[:, None] * p).sum(0)
    assert np.abs(reached / target - 1).max() < 0.02
    assert ((result.copies - result.rate).abs() < 1).all() and (result.copies >= 0).all()


def test_memberships_equal_brute_force(spark, sf_dir, result):
    import re

    import xxhash

    docs = dict(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall())
    domain = {d: f"q{q}t{t}" for d, q, t in duckdb.sql(f"select doc_id, quality, toxic from '{sf_dir}/labels.parquet'").fetchall()}

    def feats(t):
        t = re.sub(r"[^\W_][^\s]*?(?=[^\w.,\s])|[^\W_]+(?=_)", lambda m: m[0], t.lower())
        t = re.sub(r"(?:[^\W_]|[.,])+((?:[^\w.,\s]|_)+)", r"\1", t)
        return [xxhash.xxh64_intdigest(w.encode(), 42) % 2**64 for w in re.split(r"[\s.,]+", t) if w]

    signed = lambda h: (h - 2**64 if h >= 2**63 else h) % mixing.BUCKETS
    buckets = {d: [signed(h) for h in feats(t or "")] for d, t in docs.items()}
    names = sorted(mixing.TARGETS)
    count = {d: np.ones(mixing.BUCKETS) for d in names}
    for d, name in domain.items():
        for b in buckets.get(d, ()):
            count[name][b] += 1
    n = {k: sum(v == k for d, v in domain.items() if d in docs) for k in names}
    total = sum(n.values()) + len(names)
    worst = 0
    for r in result.itertuples():
        b = buckets[r.doc_id]
        s = mixing.EVIDENCE / (mixing.EVIDENCE + len(b))
        x = np.array([math.log((n[k] + 1) / total) + s * np.log(count[k] / count[k].sum())[b].sum() for k in names])
        e = np.exp(x - x.max())
        worst = max(worst, np.abs(e / e.sum() - [r.posterior[k] for k in names]).max())
    assert worst < 1e-6  # weights have nine digits


def test_clean_documents_are_told_from_others(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.filter("doc_id % 3 = 0").toPandas().set_index("doc_id")
    out = mixing.mixed(docs, labels.filter("doc_id % 3 != 0")).toPandas().set_index("doc_id").loc[held.index]
    best = out.posterior.map(lambda p: max(p, key=p.get))
    want = "q" + held.quality.astype(str) + "t" + held.toxic.astype(str)
    assert (best == want).mean() > 0.85
    assert (out.copies[want == "q1t0"] > 0).mean() > 0.95


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "good words here"), (3, "good words here"), (None, "bad *** words ***"), (4, "bad *** " * 5000)]
    docs = spark.createDataFrame([(*r, 0.5, "p") for r in rows], "doc_id long, text string, rate double, p string")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 0, 0), (None, 1, 1), (9, 1, 1), (2, None, 1)], "doc_id long, quality int, toxic int")
    out = mixing.mixed(docs, labels).collect()
    assert len(out) == 6 and all(abs(sum(r.posterior.values()) - 1) < 1e-9 and r.rate >= 0 for r in out)
    assert len({(r.rate, r.copies) for r in out if r.doc_id == 3}) == 1
    assert mixing.mixed(docs, labels.limit(0)).count() == 6
    assert mixing.mixed(docs, labels, most_rows=1).count() == 6
    assert mixing.mixed(docs.limit(0), labels).count() == 0


def test_each_domain_meets_its_own_target_by_exact_posteriors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1.5, (3000, 4)) + [1, -1, 4, 0]
    docs = spark.createDataFrame([(int(n), [float(v) for v in row]) for n, row in zip(rng.integers(20, 3000, len(x)), x, strict=True)], "n_tokens long, x array<double>")
    rows = docs.select("n_tokens", mixing.soft_membership(docs.x).alias("p"), "x")
    target = np.array([0.07, 0.01, 0.9, 0.02]) * rows.toPandas().n_tokens.sum()
    errors = mixing.fitted_rates(rows, target.tolist())
    out = rows.withColumn("rate", mixing.rate_of("p", errors)).toPandas()
    e = np.exp(np.stack(out.x))
    p = e / e.sum(1, keepdims=True)
    assert np.allclose(np.stack(out.p), p, atol=1e-12)
    reached = ((out.rate * out.n_tokens).to_numpy()[:, None] * p).sum(0)
    assert np.abs(reached / target - 1).max() < 0.02


def test_word_features_are_those_of_the_plain_pattern_and_a_long_run_takes_no_square(spark):
    texts = ["x.y,z!!", "!a?b", "ab" * 40 + "#$", "", "É1.,?! é", ",.;a;", "a-b--c d_e's", "?\n.a\t..!b", None]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[\p{L}\p{N}.,]+([^\p{L}\p{N}.,\s]+)", "$1")
    words = F.array_remove(F.split(plain, r"[\s.,]+"), "")
    want = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(mixing.BUCKETS)).cast("int"))
    assert rows.filter(~want.eqNullSafe(mixing.features(F.col("text")))).count() == 0
    began = time.time()
    assert spark.range(1).select(F.size(mixing.features(F.repeat(F.lit("a"), F.col("id").cast("int") + 300_000))).alias("n")).first().n == 1
    assert time.time() - began < 15
