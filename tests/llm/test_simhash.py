import duckdb
import numpy as np
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from tidewatch.llm import simhash


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(rows):
    """(doc_id, text) to a sorted list of (doc_id, fingerprint, component_id), all pairs compared."""
    prints = [plain(t) for _, t in rows]
    fps = np.array(sorted(set(prints)), dtype=np.uint64)
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for f in fps:
        for g in fps[np.bitwise_count(fps ^ f) <= 3]:
            root[find(int(g))] = find(int(f))
    low = {}
    for (d, _), f in zip(rows, prints, strict=True):
        low[find(f)] = min(low.get(find(f), d), d)
    return sorted((d, f"{f:016x}", low[find(f)]) for (d, _), f in zip(rows, prints, strict=True))


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect())


def test_against_brute_force(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(simhash.near_duplicates(docs)) == brute(rows)


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_masks_cover_every_pair_in_the_radius(x, flipped):
    y = x
    for b in flipped:
        y ^= 1 << b
    for masks in (simhash.MASKS, simhash.MASKS_2):
        assert any((x ^ y) & (m % 2**64) == 0 for m in masks)


def test_two_tables_leave_few_bits_open():
    assert max((~a & ~b & (2**64 - 1)).bit_count() for a in simhash.MASKS for b in simhash.MASKS_2) <= 18


def test_small_buckets_give_the_same_components(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(rng.integers(0, 120, 60).tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(simhash.near_duplicates(docs, bucket=2)) == got(simhash.near_duplicates(docs)) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one\x0btwo"), (5, "one\x0btwo"), (6, "É é A a " * 3000), (7, "one"), (8, "TWO words"), (2**40, "two words")]
    docs = spark.createDataFrame([(*r, 1, "x", r[1]) for r in rows], "doc_id long, text string, n int, fp string, component_id string")
    assert got(simhash.near_duplicates(docs)) == brute(rows)
    out = simhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (9, "a b c"), (None, "d e f")], "doc_id long, text string"))
    assert sorted(((r.doc_id or -1, r.component_id or -1) for r in out.collect())) == [(-1, -1), (-1, 9), (9, 9)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_on_a_path_and_a_star(spark):
    from tidewatch.llm.components import connected_components

    edges = [(i, i + 1) for i in range(100, 140)] + [(0, k) for k in range(1, 50)] + [(7, 7), (None, 3), (100, 101)]
    out = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 100 for i in range(100, 141)} | {i: 0 for i in range(50)}
