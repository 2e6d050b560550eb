import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidewatch.llm import substring_dedup
from tidewatch.llm.fm_index import FMIndex
from tidewatch.llm.passages import WordHashes, segments


def brute(rows, window):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    places = Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if places[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def test_against_brute_force(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute(rows, 35)
    assert sum(r[2] for r in want) > 0
    assert got(substring_dedup.without_repeats(docs)) == want


@pytest.mark.parametrize("hot", [1, 128])
def test_hot_minimizers_and_small_indexes(spark, hot):
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(12)]
    rows = [(i, " ".join([*rng.choice(["a", "b", "c"], rng.integers(0, 9)), *passage[: rng.integers(3, 13)], *rng.choice(["a", "b"], 6)])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(substring_dedup.without_repeats(docs, window=5, hot=hot, index_words=50)) == brute(rows, 5)


def test_edge_cases(spark):
    long = " ".join(f"w{i % 997}" for i in range(4000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c d e"), (5, "a b c d e"), (6, "A b c d e"), (7, "x x x x x x x"), (8, long), (9, "solo solo2"), (9, "solo solo2"), (None, "q r s t u v"), (None, "q r s t u v"), (10, "é é b c d\x0be a b c d e")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, start int, content string")
    assert got(substring_dedup.without_repeats(docs, window=5)) == brute(rows, 5)
    assert substring_dedup.without_repeats(docs.limit(0)).count() == 0


def test_fm_index_matches_counting():
    rng = np.random.default_rng(1)
    text = np.r_[rng.integers(1, 4, 200), 0, rng.integers(1, 4, 100), 0]
    weights = np.r_[np.full(201, 1), np.full(101, 1)]
    ends = np.flatnonzero(text)
    got_lengths = FMIndex(text, 4, weights, 12).matched(text, ends, 12)
    for e, n in zip(ends, got_lengths, strict=True):
        def places(k, e=e):
            want = text[e - k + 1 : e + 1]
            return 0 if k > e + 1 or 0 in want else sum((text[i : i + k] == want).all() for i in range(len(text) - k + 1))
        assert all(places(k) >= 2 for k in range(1, n + 1)) and (n == 12 or places(n + 1) < 2)


def test_segments_take_every_window_once():
    rng = np.random.default_rng(2)
    texts = [[b"%d" % x for x in rng.integers(0, 50, n)] for n in (0, 3, 40, 7, 200)]
    starts = np.r_[0, np.cumsum([len(t) for t in texts])]
    of, first, count, low, _ = segments(WordHashes().of([w for t in texts for w in t]), starts, 7, 3)
    seen = [(int(o), int(f) + k) for o, f, c in zip(of, first, count, strict=True) for k in range(c)]
    assert seen == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - 6)]
    by_window = {}
    for (o, k), m in zip(seen, np.repeat(low, count), strict=True):
        assert by_window.setdefault(tuple(texts[o][k : k + 7]), m) == m
