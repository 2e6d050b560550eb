"""Nodes reached in steps within a block: what is reached is not shuffled, and is that of a plain search."""

import random
import re

import pyarrow as pa

from tidewatch.operators import graph, neighbourhoods


def _edges():
    rng = random.Random(11)
    pairs = {(rng.randrange(-20, 60), rng.randrange(-20, 40)) for _ in range(160)} | {(s, 1) for s in range(30)}
    return sorted(pairs) + [(None, 2), (None, 5)]


def _want(edges, starts, depth):
    out = {}
    for start in starts:
        out[start, start] = 0
        level = {start} - {None}
        for d in range(1, depth + 1):
            level = {s for s, t in edges if t is not None and t in level} - {n for s, n in out if s == start}
            out |= {(start, n): d for n in level}
    return out


def test_what_is_reached_is_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "PIECE", 3)
    monkeypatch.setattr(graph, "BLOCK_STEPS", 40)
    edges, starts = _edges(), [*range(-5, 30), 1_000, None]
    e = spark.createDataFrame([*edges, (7, None)], "source long, target long")
    for depth in (0, 1, 3):
        out = graph.reach(e, spark.createDataFrame([(i,) for i in (*starts, 3, 3)], "start long"), depth)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any("start" in x for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan))
        got = out.collect()
        assert {(r.start, r.node): r.depth for r in got} == _want(edges, starts, depth) and len(got) == len(_want(edges, starts, depth))


def test_cells_and_steps_in_small_pieces(monkeypatch):
    monkeypatch.setattr(neighbourhoods, "CELLS", 250)
    monkeypatch.setattr(neighbourhoods, "PIECE_STEPS", 5)
    edges, starts = _edges(), [*range(-5, 30), 1_000]
    near = {}
    for s, t in edges:
        near.setdefault(t, []).append(s)
    rows = [(0, s, None) for s in starts] + [(0, t, x[i : i + 4]) for t, x in near.items() for i in range(0, len(x), 4)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["block", "node", "nodes"])
    got = [r for out in neighbourhoods.reached(iter([batch]), 3) for r in out.to_pylist()]
    assert {(r["start"], r["node"]): r["depth"] for r in got} == _want(edges, starts, 3) and len(got) == len(_want(edges, starts, 3))
