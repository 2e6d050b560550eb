import math
import re
import unicodedata
import zlib

import duckdb
import pytest

from tidewatch.llm import rule_ensemble as re_


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_quality(tables):
    docs, labels = tables
    out = re_.classified(docs, labels).join(labels, "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in out.doc_id]).all()
    held = out[out.held_out]
    assert held.score.between(0, 1).all()
    good, bad = held.score[held.quality == 1], held.score[held.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95
    assert (held.predicted == held.quality).mean() > 0.9


def test_compiled_rules_equal_a_plain_reading(spark, tables):
    docs, labels = tables
    known = labels.filter(~re_.held_out(labels.doc_id)).select("doc_id", "quality")
    rules = re_.trained(docs.select("doc_id", "text"), known)
    assert 0 < len(rules.rules) < 200 and re_.Rules.from_json(rules.to_json()) == rules
    stats = docs.limit(200).select("doc_id", *[c.cast("double").alias(n) for n, c in re_.statistics(docs.text).items()]).collect()
    score = {r.doc_id: r.score for r in re_.scored(docs, rules).collect()}
    for r in stats:
        total = rules.bias + sum(w for cs, w in rules.rules if all((r[n] <= b) if s == "<=" else (r[n] > b) for n, s, b in cs))
        assert math.isclose(score[r.doc_id], 1 / (1 + math.exp(-total)), abs_tol=1e-8)


def test_statistics_equal_a_plain_count(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {r.doc_id: r for r in docs.select("doc_id", *[c.alias(n) for n, c in re_.statistics(docs.text).items()]).collect()}
    for d, t in rows:
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if x]
        n = max(1, len(words))
        part = lambda pattern: len(re.findall(pattern, t)) / max(1, len(t))  # noqa: E731, B023
        want = {"symbols": part(r"[#*$%&|<>@^~_{}\\\[\]=+]"), "stops": part("[.,;:]"), "digits": part("[0-9]"), "capitals": sum(unicodedata.category(c) == "Lu" for c in t) / max(1, len(t)), "line_words": len(words) / max(1, len(lines))}
        want["other"] = sum(c.isalpha() or c in " \t\n\x0b\x0c\r.," for c in t) / max(1, len(t))
        want |= {"log_words": math.log1p(len(words)), "word_chars": sum(map(len, words)) / n, "distinct": len(set(words)) / n, "marks": len(re.findall("[!?]", t)) / max(1, len(t)), "repeated_lines": (len(lines) - len(set(lines))) / max(1, len(lines))}
        assert set(want) == set(re_.STATISTICS)
        assert all(math.isclose(out[d][k], v, abs_tol=1e-9) for k, v in want.items())


def test_sample_is_bounded(spark):
    known = spark.range(5000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    assert re_.sampled(known, 100).count() == 100 and re_.sampled(known, 9000).count() == 5000


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "fine words in a line"), (3, "fine words in a line"), (None, "*** $$$"), (4, "a b " * 20000)]
    docs = spark.createDataFrame([(*r, 0.1, "x") for r in rows], "doc_id long, text string, score double, symbols string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, None), (3, 1, 0), (4, 1, 1), (None, 1, 0), (8, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    out = re_.classified(docs, labels).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert len(re_.classified(docs, labels.limit(0)).collect()) == 6
    assert re_.classified(docs.limit(0), labels).count() == 0
