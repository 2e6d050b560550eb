"""Columns of any name pass through the operators that hand rows on, and each run drops its own scratch tables only."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import line_dedup, near_copies, quality_rules
from tidewatch.llm.common import dropped, saved, scratch

NAMES = ["gone", "lines", "text_key", "line_doc", "g_doc", "g_key", "stays", "gone_lines", "kept_doc", "kept_key", "row", "doc", "key", "row_key", "fp", "node", "first", "h", "n", "a.b", "marked_doc", "kept"]
LINES = "one line here\nanother line there\nthe third of them\n" + "\n".join(f"words of number {i} and more of them to make a text" for i in range(6))


@pytest.mark.parametrize("operator", [line_dedup.deduplicated, quality_rules.cleaned, near_copies.kept_rows])
def test_any_names(spark, operator):
    rows = [(i, LINES + f"\nlast {i}" if i < 3 else t, "s", *(f"{c}{i}" for c in NAMES)) for i, t in enumerate([None] * 3 + ["", None, "a b c " * 30])]
    names = ["doc_id", "text", "source", *NAMES]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    plain = docs.select("doc_id", "text", "source")
    got = operator(docs)
    assert got.columns[: len(names)] == names
    # near copies are told apart by a hash of all columns, but the ids decide first
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.text is not None) == sorted((r.doc_id, r.text) for r in operator(plain).collect() if r.text is not None)
    for r in got.collect():
        assert [r[c] for c in NAMES] == [f"{c}{r.doc_id}" for c in NAMES]


def test_runs_side_by_side_drop_their_own_tables(spark):
    def run(i):
        with scratch() as tables:
            kept = saved(spark.range(i + 1), "kept")
            saved(spark.range(3), "used")
            assert len(tables) == 2
            dropped(*[t for t in tables if t is not kept])
        return kept.count(), kept

    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(run, range(8)))
    assert [n for n, _ in found] == list(range(1, 9))
    dropped(*[t for _, t in found])
    assert not any(os.path.exists(t._scratch_path) for _, t in found)
    dropped(found[0][1])  # once more


def test_blocks_list_nothing_of_others(spark):
    with scratch() as outer:
        first = saved(spark.range(1).select(F.lit(1).alias("x")), "outer")
    second = saved(spark.range(1), "none")
    assert outer == [first]
    dropped(first, second)
