"""Stored filters and dictionaries of phrases against plain readings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import phrases, predicates
from tidewatch.plans import dictionaries

CONDITION = "filter long, field string, kind string, any array<string>, low double, high double"


def holds(row, conditions):
    for _, field, kind, any_of, low, high in conditions:
        x = row[field]
        if kind == "range":
            if x is None or low is not None and x < low or high is not None and x > high:
                return False
        elif not (kind == "any" and not any_of) and not set(x or []) & set(any_of):
            return False
    return True


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_filters_equal_a_plain_reading(spark, seed):
    rng = random.Random(seed)
    rows = [{"id": i, "side": [rng.choice("ab")], "tags": rng.sample("pqrstu", rng.randint(0, 4)), "x": rng.choice([None, 0.0, 1.0, rng.uniform(-5, 5)]), "y": float(rng.randint(0, 9))} for i in range(60)] * 2
    conditions = []
    for f in range(80):
        if rng.random() < 0.4:
            conditions.append((f, "side", "flag", [rng.choice("abz")], None, None))
        if rng.random() < 0.5:
            conditions.append((f, "tags", rng.choice(["one", "any"]), rng.sample("pqrstuvw", rng.randint(0, 3)), None, None))
        for field in "xy":
            if rng.random() < 0.5:
                low, high = rng.choice([None, rng.uniform(-7, 5), 0.0]), rng.choice([None, rng.uniform(-2, 12), 1.0])
                conditions.append((f, field, "range", None, low, high))
    frame = spark.createDataFrame(rows, "id long, side array<string>, tags array<string>, x double, y double")
    filters = spark.createDataFrame([(f,) for f in range(80)], "filter long")
    found = predicates.fits(frame, {"side": F.col("side"), "tags": F.col("tags")}, {"x": F.col("x"), "y": F.col("y")}, spark.createDataFrame(conditions, CONDITION), filters)
    got = sorted((r.filter, r.id) for r in found.collect())
    assert got == sorted((f, row["id"]) for f in range(80) for row in rows if holds(row, [c for c in conditions if c[0] == f]))


def test_merged_filters(spark):
    conditions = [
        (1, "side", "flag", ["a"], None, None), (2, "side", "flag", ["b"], None, None), (1, "tag", "any", ["p", "q"], None, None), (2, "tag", "any", ["q", "r"], None, None), (3, "tag", "any", ["p"], None, None),
        (4, "tag", "any", ["r"], None, None), (1, "x", "range", None, 1.0, None), (2, "x", "range", None, 0.0, 9.0), (5, "kind", "one", ["k"], None, None),
    ]
    groups = spark.createDataFrame([(10, 1), (10, 2), (20, 3), (20, 4), (30, 5), (30, 6)], "group long, filter long")
    got = {(r.filter, r.field): (r.kind, r.any, r.low, r.high) for r in predicates.merged(spark.createDataFrame(conditions, CONDITION), groups).collect()}
    assert got == {(10, "side"): ("flag", ["b"], None, None), (10, "tag"): ("any", ["q"], None, None), (10, "x"): ("range", None, 1.0, 9.0), (20, "tag"): ("any", [], None, None), (30, "kind"): ("one", ["k"], None, None)}


PATTERNS = dictionaries.patterns(dictionaries.CATEGORIES)


def plain(text):
    words = " " + " ".join(re.findall(r"[^\W_]+", (text or "").lower())) + " "
    has = lambda p: f" {p} " in words
    out = {}
    for tag, phrase, weight, context, never in PATTERNS:
        if has(phrase) and (not context or any(map(has, context))) and not any(map(has, never)):
            score, n = out.get(tag, (0.0, 0))
            out[tag] = (min(score + weight, 100.0), n + 1)
    return out


TEXTS = [
    "Will the prime minister win the presidential election?", "Senate race: who takes the seat?", "Senate house museum", "No-fly zone over the border; troops withdraw by May", "Hot plate or cold plate", "plate", "A red ring, a large ring",
    "FDA drug approval before the compliance deadline", "Rate cut by the central bank as inflation falls, interest rate path", None, "", "?? --", "World Cup final; grand slam", "grand slam election", "élection élections", "ring " * 50_000 + "blue",
]


@pytest.mark.parametrize("most", [100_000, 0])
def test_phrases_equal_a_plain_reading(spark, monkeypatch, most):
    monkeypatch.setattr(phrases, "MAX_BROADCAST", most)
    texts = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "id long, text string, tag2 string")
    found = phrases.tagged(texts, "id", "text", spark.createDataFrame(PATTERNS, "tag string, phrase string, weight double, context array<string>, never array<string>"))
    got = {}
    for r in found.collect():
        got.setdefault(r.id, {})[r.tag] = (r.score, r.n)
    assert got == {i: plain(t) for i, t in enumerate(TEXTS) if plain(t)}


def test_dictionary_lines_are_read():
    assert ("politics", "senate", 20.0, ["vote", "bill", "race", "seat"], []) in PATTERNS
    assert ("sports", "grand slam", 30.0, [], ["election"]) in PATTERNS
    assert len(PATTERNS) > 80 and all(w > 0 for _, _, w, _, _ in PATTERNS)
