"""Pairs of wallets by near trades: no shuffle of pairs, the same counts as by brute force whatever the blocks and pieces."""

import random
import re
from collections import Counter

import pyarrow as pa

from tidewatch.operators import nearby
from tidewatch.plans import relations


def _trades(seed):
    rng = random.Random(seed)
    busy = [(1, "x", rng.randrange(-500, 500)) for _ in range(60)]
    rows = busy + [(rng.randrange(12), rng.choice("xyz"), rng.randrange(-500, 500)) for _ in range(150)]
    return [*rows, *rows[-9:], (None, "x", 0), (3, None, 0), (4, "y", None), (77, None, None)]


def _want(rows, within):
    total, hits = Counter(w for w, *_ in rows), Counter()
    for w, m, at in rows:
        if None not in (w, m, at):
            hits.update((w, b) for b in {v for v, n, to in rows if None not in (v, to) and n == m and v != w and abs(to - at) <= within})
    return {(a, b): (n, min(total[a], total[b])) for (a, b), n in hits.items()}


def test_pairs_of_trades_are_not_shuffled(spark, sf_dir):
    plan = relations.pair_timing(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x.startswith(("a#", "a,")) or "bucket" in x for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan))


def test_near_pairs_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearby, "MOST_TRADES", 60)
    monkeypatch.setattr(nearby, "SPAN_MS", 100)
    rows = _trades(5)
    out = nearby.near_pairs(spark.createDataFrame(rows, "wallet long, market string, ts_ms long"), 20)
    got = out.collect()
    assert {(r.a, r.b): (r.hits, r.n) for r in got} == _want(rows, 20) and len(got) == len(_want(rows, 20))
    assert nearby.near_pairs(spark.createDataFrame([], "wallet long, market string, ts_ms long"), 20).count() == 0


def test_pieces_end_within_a_busy_wallet(monkeypatch):
    monkeypatch.setattr(nearby, "PIECE_PAIRS", 7)
    rows = _trades(6)
    full = [r for r in rows if r[0] is not None]
    known = [(w, m if at is not None else None, at or 0) for w, m, at in full]
    block = lambda w: w % 2
    got = {}
    for upper, lower in ((0, 0), (1, 0), (1, 1)):
        cells = [(0, block(w) == upper, block(w) == lower, m, [w], [at]) for w, m, at in known if block(w) in (upper, lower)]
        names = ["square", "upper", "lower", "market", "wallets", "times"]
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*cells, strict=True)], names)
        for out in nearby._squares(iter([batch]), 20):
            for r in out.to_pylist():
                assert (r["a"], r["b"]) not in got
                got[r["a"], r["b"]] = r["hits"], r["n"]
    assert got == _want(rows, 20)
