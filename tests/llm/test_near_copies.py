import random

import duckdb
import numpy as np

from tidewatch.llm import near_copies
from tidewatch.llm.passages import WordHashes


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def roots(n, pairs):
    of = list(range(n))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in pairs:
        of[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def kept(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return near_copies.kept_rows(docs, **how)


def test_masks_cover_the_radius():
    rng = random.Random(5)
    for masks in (near_copies.MASKS, near_copies.MASKS_2):
        assert len(masks) == 127 and sorted({(m % 2**64).bit_count() for m in masks}) == [32, 64]
        for _ in range(300):
            differ = sum(1 << i for i in rng.sample(range(64), near_copies.RADIUS))
            assert any(m % 2**64 & differ == 0 for m in masks)


def test_against_exact_similarities(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet' order by doc_id").fetchall()
    words = [f"w{i}" for i in range(5000)]
    rng = random.Random(1)
    for g in range(40):  # copies with 1 to 3 words in 150 replaced: similarities on both sides of 0.8
        text = rng.choices(words, k=150)
        for _ in range(4):
            rows.append((10**6 + len(rows), " ".join(rng.choice(words) if rng.random() < 0.003 * (1 + g % 4) else w for w in text)))
    sets = [shingles(t) for _, t in rows]
    pairs = {(a, b): jaccard(sets[a], sets[b]) for a in range(len(rows)) for b in range(a)}
    got = {r.doc_id for r in kept(spark, rows).collect()}
    loose, strict = (roots(len(rows), [p for p, j in pairs.items() if j >= least]) for least in (0.72, 0.88))
    # one of each group stays: at least one of each loosely linked one, at most one of each strictly linked one
    assert {loose[i] for i, (d, _) in enumerate(rows) if d in got} == set(loose)
    assert len([d for d in got]) == len({strict[i] for i, (d, _) in enumerate(rows) if d in got})
    exact = roots(len(rows), [p for p, j in pairs.items() if j >= 0.8])
    assert abs(len(got) - len(set(exact))) <= 0.05 * len(set(exact))


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = rng.choices(words, k=400)
    rows = [(i, " ".join(w if rng.random() > 0.002 else "x" + w for w in base)) for i in range(40)] + [(100 + i, " ".join(rng.choices(words, k=80))) for i in range(20)]
    want = sorted(r.doc_id for r in kept(spark, rows).collect())
    assert sorted(r.doc_id for r in kept(spark, rows, bucket=3).collect()) == want and want[0] == 0 and len(want) == 21


def test_forest_joins_what_is_linked():
    rng = np.random.default_rng(3)
    shapes = rng.integers(0, 2**63, (60, 4), dtype=np.uint64)
    for i in range(1, 30):
        shapes[i] = shapes[i - 1] ^ np.uint64(0xFF << i % 8 * 7)
    near = [(a, b) for a in range(60) for b in range(a) if np.bitwise_count(shapes[a] ^ shapes[b]).sum() <= 38]
    links = [(int(a), int(b)) for x, y in near_copies.forest(shapes, np.arange(60), 38) for a, b in zip(x, y, strict=True)]
    assert roots(60, links) == roots(60, near) and len(links) == 60 - len(set(roots(60, near)))


def test_edge_cases(spark):
    same = "one two three four five six seven eight"
    rows = [(5, None), (4, ""), (3, "one two"), (2, "One  TWO"), (1, same), (1, same), (1, "another text of the same id and with other words in it"), (None, same), (None, "no id but a text of its own"), (9, same), (7, "word " * 30_000), (8, "word " * 29_000)]
    out = sorted((r.doc_id or -1, (r.text or "")[:7]) for r in kept(spark, rows).collect())
    assert out == [(-1, "no id b"), (1, "another"), (1, "one two"), (2, "One  TW"), (4, ""), (7, "word wo")]
    assert kept(spark, rows).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert near_copies.kept_rows(spark.createDataFrame([], "doc_id long, text string, fp int, k int, node int")).count() == 0


def test_prints_need_no_order_of_words_or_repetition():
    of = WordHashes().of
    a, b = (near_copies.prints(of(t.encode().split())) for t in ("a b c d e f", "f e d c b a a a"))
    assert a[0] == b[0] and (a[1:] != b[1:]).any()
    assert not near_copies.prints(of([])).any()
    assert near_copies.most_bits(0.8) == 38
