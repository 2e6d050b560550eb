import duckdb
import pytest

import corpus_pipeline as cp
from tests.llm import test_decontamination, test_near_copies, test_token_files
from tidewatch.llm import mixing
from tidewatch.llm.sql import QUALITY


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What each stage got and gave, as lists of rows."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_columns(stages):
    assert all(c == list(cp.COLUMNS) for *_, c in stages[:-1])


def test_quality_rules(stages, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"select doc_id from ({QUALITY}) where kept").fetchall()}
    assert {r.doc_id for r in stages[0][1]} == kept and len(kept) < len(stages[0][0])


def test_frequent_lines_go(stages):
    before, after, _ = stages[0]
    host, n_docs, has = {r.doc_id: r.source for r in before}, {}, {}
    lines = lambda t: [x for x in (t or "").split("\n") if x.split()]
    normal = lambda x: " ".join(x.lower().split())
    for source, text in {(r.source, r.text or "") for r in before}:
        n_docs[source] = n_docs.get(source, 0) + 1
        for x in set(map(normal, lines(text))):
            has[source, x] = has.get((source, x), 0) + 1
    often = {k for k, n in has.items() if n > 20 and n > 0.1 * n_docs[k[0]]}
    texts = {r.doc_id: r.text for r in before}
    for r in after:
        want = "\n".join(x for x in texts[r.doc_id].split("\n") if (host[r.doc_id], normal(x)) not in often)
        assert r.text == want and r.n_chars == len(want)


def test_one_document_of_each_group_stays(stages):
    before, after, _ = stages[1]
    sets = [test_near_copies.shingles(r.text) for r in before]
    pairs = {(a, b): test_near_copies.jaccard(sets[a], sets[b]) for a in range(len(sets)) for b in range(a)}
    loose, strict = (test_near_copies.roots(len(sets), [p for p, j in pairs.items() if j >= least]) for least in (0.72, 0.88))
    kept = {r.doc_id for r in after}
    assert {loose[i] for i, r in enumerate(before) if r.doc_id in kept} == set(loose)
    assert len(after) == len(kept) == len({strict[i] for i, r in enumerate(before) if r.doc_id in kept})


def test_benchmarks_go(stages, sf_dir):
    before, after, _ = stages[2]
    items = duckdb.sql(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()
    bad = {d for d, _ in test_decontamination.brute([(r.doc_id, r.text) for r in before], items)}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - bad


def test_mixing_repeats_by_the_rates(stages, spark, sf_dir):
    before, after, _ = stages[3]
    docs = spark.createDataFrame(before)
    copies = {r.doc_id: r.copies for r in mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert sorted(r.doc_id for r in after) == sorted(d for d, n in copies.items() for _ in range(n))


def test_ids_are_those_of_what_is_left(stages):
    before, after, _ = stages[4]
    want = test_token_files.brute([(r.doc_id, r.text) for r in before])
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in after) == want


ROWS = [
    (1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, "e f g h", "en", None, 7), (None, "i j", None, "s", 3),
    (3, None, None, None, None), (4, "", "en", "s", 0), (5, "word " * 30_000, "en", "s", 150_000), (1, "another text", "en", "s", 12),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_edge_cases_of_each_stage(spark, sf_dir):
    docs = spark.createDataFrame([(*r, 1, "k") for r in ROWS], SCHEMA + ", copies int, row_key string")
    ids = lambda df: sorted((r.doc_id or -1, r.text) for r in df.collect())
    assert [d for d, _ in ids(cp.one_of_each_group(spark, docs, ""))] == [-1, 1, 1, 2, 3, 5]
    assert cp.good_documents(spark, docs, "").count() == 0  # all are short or repeat themselves
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    both = docs.union(spark.createDataFrame([(1, item, "en", "s", 9, 1, "k"), (None, item, "en", "s", 9, 1, "k")], docs.schema))
    rest = cp.without_benchmarks(spark, both, sf_dir).collect()
    assert sorted(map(str, rest)) == sorted(map(str, docs.select(*cp.COLUMNS).collect()))  # rows that share an id stay
    assert cp.mixed(spark, docs, sf_dir).columns == list(cp.COLUMNS)
    assert cp.token_index(spark, docs, sf_dir).count() == len(ROWS)


def test_empty_tables(spark, sf_dir):
    for _, stage in cp.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), sf_dir).count() == 0


def test_run_equals_the_stages_and_leaves_no_scratch(spark, stages, sf_dir):
    from tidewatch.llm.common import table_count

    before = table_count()
    out = cp.run(spark, sf_dir)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, stages[-1][1]))
    assert table_count() - before <= 3  # the last stage's input and files
