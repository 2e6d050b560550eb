"""Quality rules, line dedup, sharding and URL filters against plain Python, with the edge cases of their docstrings."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import line_dedup, quality_rules, sharding, urls
from tidewatch.llm.queries import oracle_sql, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", ["op6_quality_rules", "op7_line_dedup", "op10_url_filter"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    want = con.execute(oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries()[name](spark, sf_dir).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    rep = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep)


def test_quality_rules_on_edge_cases(spark):
    clean = " ".join(f"word{i}" for i in range(30))
    shared = "this line stands in all documents of one host and of no other"
    rows = [(1, None, "a"), (2, "", "a"), (3, clean, None), (3, clean, None), (None, clean, "b"), (4, "x y z " * 40, "a"), (5, "é# é#\né# é#\n" + clean, "a"), (6, clean * 400, "a")]
    rows += [(100 + i, f"{shared}\nown {i}", "h") for i in range(40)] + [(200 + i, shared + "\n" + clean.replace("word", f"w{i}x"), "h") for i in range(40)]
    docs = spark.createDataFrame([(*r, 5, "q") for r in rows], "doc_id long, text string, source string, n_words int, h string")
    out = quality_rules.quality_rules(docs).collect()
    assert len(out) == len(rows)
    want = defaultdict(set)
    for d, t, _ in rows:
        want[d].add(base(t))
    for r in out:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) in want[r.doc_id]
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and (not failed or not r.kept)
        if r.doc_id and r.doc_id >= 100:
            assert r.n_words_frequent == len(shared.split()) and r.kept == (r.doc_id >= 200)
    left = quality_rules.cleaned(docs)
    assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted(r.doc_id or -1 for r in out if r.kept)
    assert texts[205] == clean.replace("word", "w5x") and texts[3] == clean
    assert quality_rules.quality_rules(docs.limit(0)).count() == quality_rules.cleaned(docs.limit(0)).count() == 0


def test_copies_do_not_make_a_line_frequent(spark):
    text = "\n".join(" ".join(f"w{i}x{k}" for k in range(9)) for i in range(5))
    docs = spark.createDataFrame([(i, text, "h") for i in range(60)], "doc_id long, text string, source string")
    assert quality_rules.quality_rules(docs).filter("kept").count() == 60


def test_a_longest_line_that_many_documents_share_is_frequent(spark):
    licence = " ".join(f"licence{k}" for k in range(40))
    docs = spark.createDataFrame([(i, f"own words {i}\n{licence}", "h") for i in range(60)], "doc_id long, text string, source string")
    out = quality_rules.quality_rules(docs).collect()
    assert [r.n_words_frequent for r in out] == [40] * 60 and not any(r.kept for r in out)


def lines_left(rows):
    docs = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    places = defaultdict(list)
    kept = {d: [(i, re.sub("[\x20\x09-\x0d]+", " ", x).strip(" ")) for i, x in enumerate(d[1].split("\n")) if WORD.search(x)] for d in docs}
    for d in docs:
        for k in range(len(kept[d]) - 2):
            places[tuple(t for _, t in kept[d][k : k + 3])].append((d, [i for i, _ in kept[d][k : k + 3]]))
    gone = defaultdict(set)
    for at in places.values():
        for d, covered in at[1:]:
            gone[d] |= set(covered)
    return {d: (len(kept[d]), len(gone[d]), "\n".join(x for i, x in enumerate(d[1].split("\n")) if i not in gone[d])) for d in docs}


def test_line_dedup_on_edge_cases(spark):
    a = "one\ntwo\n\nthree  x\nfour"
    rows = [(1, None), (2, ""), (3, a), (3, a), (4, "zero\n" + a), (5, "one\ntwo"), (None, a), (6, "r\n" * 50), (7, "five\n two \nthree x\nfour\n"), (8, "\n".join(f"l{i % 700}" for i in range(3000)))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_lines int")
    out = line_dedup.deduplicated(docs)
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed"]
    want = lines_left(rows)
    got = [(r.doc_id, r.n_lines, r.n_removed, r.text) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(repr((d, *want[d, t or ""][:2], None if t is None else want[d, t or ""][2])) for d, t in rows)
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0


def test_sharding(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall() + [(10**6 + i, None) for i in range(3000)] + [(7, "again"), (7, "again"), (None, "x"), (None, "")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, shard int")
    out = sharding.sharded(docs, sharding.tree_for(40), sharding.tree_for(41), chunk_rows=50).collect()
    sizes = Counter((r.doc_id, r.size, r.text_crc32) for r in out)
    assert sizes == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    for s in range(40):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots))) and 30 < len(slots) < 160
    assert all(r.grown_shard in (r.shard, 40) for r in out) and 20 < sum(r.grown_shard == 40 for r in out) < 160
    assert len({(r.doc_id, r.shard) for r in out}) == len({r.doc_id for r in out})
    assert sharding.sharded(docs.limit(0), sharding.tree_for(40), sharding.tree_for(41)).count() == 0


def test_shards_equal_plain_draws(spark):
    tree = {"a": {"x": {0: 1.0, 1: 0.5}, "y": {2: 2.0}}, "b": {"x": {3: 1.5, 4: 0.0}}, "c": {"z": {5: 0.25, 6: 1.0, 7: 3.0}}}

    def draw(doc, name, weight):
        h = xxhash.xxh64_intdigest(name.encode(), xxhash.xxh64_intdigest(struct.pack("<q", doc), 42))
        return -math.log(((h >> 11) + 1) / 2.0**53) / weight

    def plain(doc):
        path, node = "", tree
        total = lambda n: n if isinstance(n, float) else sum(map(total, n.values()))
        while isinstance(node, dict):
            named = {k: (f"{path}/{k}".lstrip("/"), total(v)) for k, v in node.items() if total(v)}
            best = min(named, key=lambda k: draw(doc, *named[k]))  # noqa: B023
            path, node = named[best][0], node[best]
        return best

    docs = [-5, 0, 1, 2**40, *range(100, 1100)]
    out = spark.createDataFrame([(d,) for d in docs], "id long").select("id", sharding.shard_of(F.col("id"), tree).alias("s")).collect()
    assert {r.id: r.s for r in out} == {d: plain(d) for d in docs}


def test_weights_move_documents_only_into_what_gains(spark):
    tree, heavy = sharding.tree_for(40), sharding.tree_for(40)
    heavy["r2"]["k1"][21] = 3.0
    keys = spark.range(20_000)
    both = keys.select(sharding.shard_of(keys.id, tree).alias("a"), sharding.shard_of(keys.id, heavy).alias("b")).collect()
    region = lambda s: s // 8
    assert all(region(r.a) == region(r.b) or region(r.b) == 2 for r in both)
    rack = range(20, 24)  # the shards of r2/k1
    assert all(r.b in (r.a, 21) for r in both if r.a in rack)
    assert all(r.a == r.b or r.b in rack for r in both if region(r.a) == 2)
    n = Counter(r.b for r in both)
    assert 1250 < n[21] < 1650 and all(350 < n[s] < 620 for s in range(40) if s != 21)


def test_urls_on_edge_cases(spark):
    cases = {
        "http://WWW.Example.com/en/x?y": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "https://a.b.example.com/en/": ("a.b.example.com", "/en/", "example.com/en/", "block"),
        "https://a.example.com/en": ("a.example.com", "/en", "com/", "allow"),
        "ftp://x.net/fr/1#z": ("x.net", "/fr/1", "net/fr/", "block"),
        "http://net/es/": ("net", "/es/", "net/es/", "block"),
        "http://subnet/es/": ("subnet", "/es/", None, None),
        "http://x.com?q=/en/": ("x.com", "", None, None),
        "no scheme": ("", "", None, None),
        "": ("", "", None, None),
        "a://b://c.com/": ("b:", "//c.com/", None, None),
        "http://É.com/É": ("É.com", "/É", "com/", "allow"),
        "http://x.org/" + "a" * 50_000: ("x.org", "/" + "a" * 50_000, None, None),
    }
    rows = [(i, u) for i, u in enumerate(cases)] + [(90, None), (91, "http://x.net/es/1"), (91, "http://x.net/es/1"), (None, "http://x.com/")]
    pages = spark.createDataFrame([(*r, 1, "r") for r in rows], "page_id long, url string, score int, rule string")
    out = urls.judged_urls(pages).collect()
    assert len(out) == len(rows) and all(r.verdict in ("allow", "block") for r in out)
    by = {r.page_id: r for r in out}
    for i, want in enumerate(cases.values()):
        assert (by[i].host, by[i].path, by[i].rule) == want[:3] and want[3] in (None, by[i].verdict)
    assert (by[90].host, by[90].path, by[90].rule) == ("", "", None)
    assert urls.judged_urls(pages.limit(0)).count() == 0
    none = urls.judged_urls(pages, rules=()).collect()
    assert {r.verdict for r in none} == {"allow"}


def test_model_follows_what_rules_say(spark):
    good, bad = [f"http://site{i}.com/about/page{i}" for i in range(60)], [f"http://x{i}.net/es/casino-win-{i}" for i in range(60)]
    rows = list(enumerate([*good, *bad, "http://y.org/about/page7", "http://y.org/casino-win-7"]))
    out = {r.page_id: r.verdict for r in urls.judged_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (out[120], out[121]) == ("allow", "block")


def test_kept_text_hash(spark, sf_dir):
    out = queries()["op7_line_dedup"](spark, sf_dir).limit(3).collect()
    assert all(len(r.kept_md5) == hashlib.md5().digest_size * 2 for r in out)
