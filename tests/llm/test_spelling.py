"""Spelling variants against brute force: words as the task states them, pairs by edit distance, forms and roots by walking."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewatch.llm import spelling
from tidewatch.llm.queries import queries

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    """Whether exactly one character is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def forms(n, near):
    out = {}
    for w, k in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        out[w] = best if best is not None and n[best] >= 2 * k else None

    def root(w):
        while out[w] is not None:
            w = out[w]
        return w

    return sorted(((w, f, root(w), n[w], len(near[w]), n[f] if f is not None else None) for w, f in out.items()), key=repr)


def brute(n):
    """All pairs are compared."""
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    return forms(n, near)


def keyed(n):
    """The same for many words: pairs meet by patterns and deletions, and are compared then."""
    at, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            at[w[:i] + w[i + 1 :]].add(w)
        at[w].add(w)
    for group in at.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    return forms(n, {w: near[w] for w in n})


def rows(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@given(st.dictionaries(st.text(alphabet="abÿ", min_size=1, max_size=7), st.integers(1, 40), min_size=1, max_size=80))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_dense_words(spark, n):
    found = spark.createDataFrame(list(n.items()), "word string, n long")
    assert rows(spelling.spelling_forms(found)) == brute(n)


def test_shapes_of_tries(spark):
    """Runs of one letter, a caterpillar, a full class, chains of forms, and words of extreme length."""
    n = {"a" * i: i + 1 for i in range(1, 40)} | {"x" + c + "yz": 5 for c in "abcdefghijklmnopqrstuvwxyzÀÉßñÿ×÷"}
    n |= {"chain" + "xyzuvw"[:i] + "s" * i: 3 * 2**i for i in range(7)} | {"é" * 50_000: 9, "é" * 49_999: 3, "é" * 25_000 + "è" + "é" * 24_999: 4, "": 2}
    found = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert rows(spelling.spelling_forms(found)) == keyed(n)


@pytest.mark.parametrize("parts,most", [(1, 200_000), (3, 200_000), (1000, 0)])
def test_hot_nodes_any_way(spark, monkeypatch, parts, most):
    monkeypatch.setattr(spelling, "HOT_PARTS", parts)
    monkeypatch.setattr(spelling, "MAX_BROADCAST", most)
    n = {f"{a}{b}{c}{d}": (i * 7) % 23 + 1 for i, (a, b, c, d) in enumerate((a, b, c, d) for a in "pq" for b in "abc" for c in "ab" for d in ("", "a", "ba"))}
    assert rows(spelling.spelling_forms(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute(n)


def test_words_edge_cases(spark):
    texts = ["Straße straße STRAßE strasse strasse strasse", None, "", "ÀÉÎ àéîõü àéîõü àéîõü abcd abcd abcd", "x" * 200_000, "naïve_naïve9naïve\nnaïvé naive naive naive", "×÷×÷× ×÷×÷× ×÷×÷×", "12345 --- 67"]
    data = [(i * 31 + j if j else None, t, "w", 1) for i, t in enumerate(texts) for j in range(40)] * 2
    docs = spark.createDataFrame(data, "doc_id long, text string, word string, n int")
    got = {r.word: r.n for r in spelling.words(docs).collect()}
    assert got == counted((k, t) for k, t, *_ in data)
    assert any(len(w) == 199_999 for w in got) or "x" * 200_000 in got
    assert spelling.words(docs.limit(0)).collect() == []
    assert spelling.spelling_forms(spelling.words(docs.limit(0))).collect() == []


def test_query_equals_brute_force(spark, sf_dir):
    texts = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    want = keyed(counted(texts))
    assert rows(queries()["op13_spelling_variants"](spark, sf_dir)) == want
    assert any(r[1] for r in want)
