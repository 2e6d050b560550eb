import itertools
import re

import duckdb

from tidewatch.llm import decontamination as dc


def toks(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def brute(docs, items):
    """Every diagonal of every pair, without seeds."""
    out = {}
    for d, t in docs:
        a = toks(t)
        for i, u in items:
            b = toks(u)
            if len(b) < dc.MIN_TOKENS:
                continue
            want = min(20, len(b))
            for g in range(-len(b) + want, len(a) - want + 1):
                s = max(0, -g)
                e = [a[j + g] == b[j] for j in range(s, min(len(b), len(a) - g))]
                best = max((sum(e[k : k + want]) for k in range(len(e) - want + 1)), default=0)
                if 5 * best >= 4 * want:
                    out[d, i] = max(out.get((d, i), 0), best)
    return out


def got(df):
    return {(r.doc_id, r.item_id): r.n_equal for r in df.collect()}


def test_seeds_hit_any_twenty_tokens_with_four_substituted():
    for gone in itertools.combinations(range(20), 4):
        assert any(not set(gone) & {m + o for m in mask} for mask in dc.MASKS for o in range(15))


def test_seeds_hit_items_of_every_length_within_tolerance():
    for n in range(1, 21):
        for gone in itertools.combinations(range(n), n - -(-4 * n // 5) if n >= dc.MIN_TOKENS else 0):
            assert any(not set(gone) & {m + o for m in mask} for mask in dc.masks_for(n) for o in range(n - max(mask)))


def test_short_items_are_found(spark):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (1, 3, 4, 7, 8, 10, 11, 12, 15)]
    swapped = {8: {2}, 10: {3, 6}, 11: {3, 6}, 12: {4, 7}, 15: {4, 5, 8}, 7: {3}}
    text = {n: t.split() for n, t in items}
    docs = [(n, f"before {t} after") for n, t in items] + [(100 + n, t) for n, t in items]
    docs += [(200 + n, " ".join("x" if k in gone else w for k, w in enumerate(text[n]))) for n, gone in swapped.items()]
    found = got(dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert found == {(d + n, n): n for n, _ in items for d in (0, 100)} | {(200 + n, n): n - len(gone) for n, gone in swapped.items() if n >= 8}


def test_against_brute_force(spark, sf_dir):
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet' order by n_chars limit 150").fetchall()
    items = duckdb.sql(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()
    docs += [(1000 + i, "x y z " + t.upper().replace(" ", " -- ") + " q") for i, t in items[:5]]
    docs += [(2000 + i, " ".join(w if k % 6 != 5 else "other" for k, w in enumerate(t.split()))) for i, t in items[:8]]
    docs += [(3000 + i, " ".join(t.split()[: len(t.split()) // 2])) for i, t in items]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {k for k in want if k[0] >= 1000}
    assert got(dc.contaminated(d, i)) == got(dc.contaminated(d, i, max_broadcast=0)) == want
    assert {r.doc_id for r in dc.decontaminated(d, i).collect()} == {x for x, _ in docs} - {x for x, _ in want}


def test_edge_cases(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, None), (2, ""), (3, item), (3, item), (4, item + " " + item), (None, item), (5, "ten " * 30), (6, "w " * 20000 + item)]
    d = spark.createDataFrame([(*r, 7, "q") for r in docs], "doc_id long, text string, item_id int, item string")
    i = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "short item"), (4, "ten " * 30)], "item_id long, text string")
    assert got(dc.contaminated(d, i)) == {(3, 1): 10, (4, 1): 10, (None, 1): 10, (6, 1): 10, (5, 4): 20}
    assert dc.contaminated(d.limit(0), i).count() == dc.contaminated(d, i.limit(0)).count() == 0
