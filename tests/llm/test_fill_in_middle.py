"""Fill-in-middle against a plain reading by a regular expression, its SQL, and the cases of its docstring."""

import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import fill_in_middle as fim
from tidewatch.llm.queries import oracle_sql, queries

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain(doc_id, text):
    """n, form, characters of prefix and middle, output."""
    text = text or ""
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = UNIT.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@given(st.text(alphabet=" \t\n\r\v\f\x1c\x85\xa0aé€😀<", max_size=60), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
@settings(max_examples=400, deadline=None)
def test_parts(text, h1, h2):
    data, units = text.encode(), UNIT.findall(text)
    n, a, b = fim.parts(data, h1, h2)
    first, second = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    assert n == len(units)
    assert (data[:a].decode(), data[a:b].decode()) == ("".join(units[:first]), "".join(units[first:second]))


@given(st.integers(1, 2**200))
def test_place(bits):
    width = bits.bit_length() + 3
    found = [fim.place(bits, k, width) for k in range(bits.bit_count())]
    assert found == [i for i in range(width) if bits >> i & 1]


TEXTS = ["", None, "a", " ", "\n\t ", "one two  three\n\nfour ", "é€😀 ü x \x85y", "has <P> in it", "<M", "x <S", "<" * 50 + " " + ">" * 50, "P> <S <M ", "wörd " * 200_000, "w" * 1_000_000]


def test_edge_cases(spark):
    rows = [(i * 100 + j if j else None, t, "extra", 7, "o") for i, t in enumerate(TEXTS) for j in range(12)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, h1 int, form string").repartition(5)
    out = fim.filled_in(docs)
    got = out.withColumn("back", fim.restored(out["output"], out["form"])).collect()
    want = sorted(repr((k, *plain(k, t), t or "")) for k, t, *_ in rows)
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back)) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.filled_in(docs.limit(0)).collect() == []


def test_query_equals_sql_and_plain(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(oracle_sql()["op11_fill_in_middle"])
    names = [c[0] for c in want.description]
    rows = queries()["op11_fill_in_middle"](spark, sf_dir).select(*names).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want.fetchall()))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    read = {k: (plain(k, t), t) for k, t in con.execute("select doc_id, text from documents").fetchall()}
    for r in rows:
        (n, form, a, b, output), text = read[r.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, b, digest(output), digest(text or ""))


@pytest.mark.parametrize("text", ["a b c d e", "wort " * 1000])
def test_another_seed_draws_anew(spark, text):
    docs = spark.createDataFrame([(i, text) for i in range(60)], "doc_id long, text string")
    assert {r.output for r in fim.filled_in(docs).collect()} != {r.output for r in fim.filled_in(docs, seed=7).collect()}
