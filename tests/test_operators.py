"""Operators without SQL, and the functions whose conventions differ from Spark's."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import stats
from tidewatch.operators import book, graph, learning, scoring, sequences
from tidewatch.sources import files


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column).first()[0]


def test_half_up_and_ladders(spark):
    assert [one(spark, stats.half_up(F.lit(x))) for x in (-2.5, 2.5, 2.4)] == [-2, 3, 2]
    steps = [(80.0, "a"), (60.0, "b")]
    assert [one(spark, stats.ladder(F.lit(x), steps, "c")) for x in (80.0, 79.9, 1.0)] == ["a", "b", "c"]


def test_weeks_start_on_sunday(spark):
    sunday = 1_704_585_600_000  # 2024-01-07
    assert [one(spark, stats.sunday_week_ms(F.lit(sunday + d))) for d in (0, 1, 604_799_999)] == [sunday] * 3
    assert one(spark, stats.sunday_week_ms(F.lit(sunday - 1))) == sunday - 604_800_000


def test_similarities(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<int>")
    assert one(spark, stats.jaccard(a(1, 2), a(2, 3), 0.0)) == pytest.approx(1 / 3)
    assert [one(spark, stats.jaccard(a(), a(), e)) for e in (0.0, 1.0)] == [0.0, 1.0]
    assert one(spark, stats.cosine(a(1, 0), a(1, 1))) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, stats.cosine(a(0, 0), a(1, 1))) == 0.0
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert flat.agg(stats.pearson("x", "y")).first()[0] == 0.0


def test_wilson_and_z(spark):
    low, high = (one(spark, c) for c in stats.wilson(F.lit(8), F.lit(10)))
    assert (round(low, 4), round(high, 4)) == (0.4902, 0.9433)
    assert [one(spark, c) for c in stats.wilson(F.lit(0), F.lit(0))] == [0.0, 1.0]
    assert one(spark, stats.two_proportion_z(F.lit(0), F.lit(0), F.lit(1), F.lit(2))) == 0.0


def test_percentile_rank_does_not_divide_by_zero(spark):
    points = [(25.0, F.lit(0.0)), (50.0, F.lit(10.0)), (75.0, F.lit(10.0)), (95.0, F.lit(20.0))]
    assert [one(spark, stats.percentile_rank(F.lit(v), points)) for v in (0.0, 5.0, 10.0, 15.0, 1e9)] == [0.0, 37.5, 50.0, 85.0, 100.0]


def test_average_cost_may_leave_a_negative_size(spark):
    rows = [("w", 1, "BUY", 2.0, 10.0), ("w", 2, "BUY", 4.0, 10.0), ("w", 3, "SELL", 5.0, 10.0), ("w", 4, "SELL", 6.0, 20.0)]
    out = sequences.average_cost(spark.createDataFrame(rows, "k string, at int, side string, price double, size double"), ["k"], ["at"]).first()
    assert (out["size"], out["realised"]) == (-10.0, pytest.approx(10 * 2 + 20 * 3))


def test_gap_of_exactly_the_limit_stays_in_a_session(spark):
    rows = [("m", t, 1.0) for t in (0, 300_000, 600_001)]
    out = sequences.sessions(spark.createDataFrame(rows, "m string, ts_ms long, usd double"), ["m"], ["ts_ms"], 300_000, 1).collect()
    assert sorted((r.start, r.end, r.n) for r in out) == [(0, 300_000, 2), (600_001, 600_001, 1)]


def test_as_of_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 10)], "k int, ts_ms long")
    right = spark.createDataFrame([(1, 6, "a", 1), (1, 10, "b", 1), (1, 10, "c", 2), (1, 11, "d", 1)], "k int, ts_ms long, v string, o int")
    assert sorted((r.k, r.ts_ms, r.v or "") for r in sequences.as_of(left, right, ["k"], ["v"], "o").collect()) == [(1, 5, ""), (1, 10, "c"), (2, 10, "")]


def test_down_sampling(spark):
    rng = random.Random(1)
    rows = [("s", i, rng.random()) for i in range(500)] + [("t", i, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, x long, y double")
    out = sequences.lttb(df, "k", "x", "y", 20).collect()
    s = sorted(r.x for r in out if r.k == "s")
    assert (s[0], s[-1], len(s)) == (0, 499, 20) and sum(r.k == "t" for r in out) == 3
    assert all(not 0 < x < 498 // 18 for x in s)
    assert sorted(r.x for r in sequences.lttb(df, "k", "x", "y", 2).collect() if r.k == "s") == [0, 499]


def test_regularity_groups_around_the_first(spark):
    df = spark.createDataFrame([(1, [10.0, 12.0, 14.0, 11.0]), (2, [])], "k int, gaps array<double>")
    assert {r.k: r.regularity for r in sequences.regularity(df, "k", "gaps", 2).collect()} == {1: 0.75, 2: 0.0}


def test_components_and_reach(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(1, 2), (3, 1)], "a long, b long")
    assert {r.node: r.root for r in graph.components(edges).collect()} == {i: 10 for i in range(10, 41)} | {1: 1, 2: 1, 3: 1}
    e = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (1, 3)], "source long, target long")
    out = graph.reach(e, spark.createDataFrame([(1,)], "start long"), 2)
    assert sorted((r.node, r.depth) for r in out.collect()) == [(1, 0), (2, 1), (3, 2)]


def test_books(spark):
    levels = spark.createDataFrame([("b", "bid", 9.0, 1.0), ("b", "bid", 8.0, 2.0), ("b", "ask", 11.0, 1.0), ("b", "ask", 12.0, 5.0), ("b", "ask", 13.0, 0.0)], "book string, side string, price double, size double")
    assert tuple(book.fill_price(levels, "ask", 3.0).first()) == ("b", pytest.approx(35 / 3), 12.0)
    assert book.fill_price(levels, "ask", 7.0).count() == 0
    s = book.book_stats(levels).first()
    assert (s.bid, s.ask, s.middle, s.ratio) == (9.0, 11.0, 10.0, 0.5)
    deltas = spark.createDataFrame([("b", "bid", 9.0, 1.0, 1), ("b", "bid", 9.0, 0.0, 2), ("b", "bid", 8.0, 2.0, 1)], "book string, side string, price double, size double, at int")
    assert [r.price for r in book.latest(deltas).collect()] == [8.0]


def test_composite_needs_enough_signals(spark):
    rows = [(1, "a", 80.0), (1, "b", 80.0), (1, "c", 80.0), (2, "a", 80.0), (2, "b", None), (2, "x", 1.0)]
    out = scoring.composite(spark.createDataFrame(rows, "k int, signal string, value double"), "k", {"a": 0.5, "b": 0.25, "c": 0.25}, 3).collect()
    assert [(r.k, r.signals, r.raw, r.boosted) for r in out] == [(1, 3, 80.0, 84)]


def test_calibration_of_nothing(spark):
    none = spark.createDataFrame([], "p double, y int")
    r = scoring.calibration(none, "p", "y").first()
    assert (r.n, r.brier) == (0, 1.0) and scoring.reliability(none, "p", "y").filter("n = 0").count() == 10
    assert scoring.auc(none, "p", "y").first()[0] == 0.5


def test_density_clusters(spark):
    rows = [(i, i * 0.1, 0.0) for i in range(10)] + [(20 + i, 5 + i * 0.1, 5.0) for i in range(5)] + [(99, 50.0, 50.0)]
    out = learning.density_clusters(spark.createDataFrame(rows, "k long, x double, y double"), "k", "x", "y", 0.15, 3)
    assert {r.k: r.cluster for r in out.collect()} == {i: 1 for i in range(10)} | {20 + i: 21 for i in range(5)}


def test_isolation_finds_the_odd_one(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)] + [(999, 12.0, -12.0)]
    out = learning.isolation_scores(spark.createDataFrame(rows, "k long, x double, y double"), "k", ["x", "y"]).orderBy(F.desc("score")).first()
    assert out.k == 999 and out.score > 0.6


def test_sources_and_sinks(spark, tmp_path):
    lines = ['{"trade_id":"1","price":"0.5","size":"100","side":"buy","timestamp":"1700000000"}', '{"trade_id":"2","price":"x","size":"1"}', "broken", '{"trade_id":"3","price":"2","size":"9000","side":"SELL","timestamp":"2024-01-01T00:00:00Z"}']
    (tmp_path / "t.json").write_text("\n".join(lines))
    raw = files.raw_trades(spark, str(tmp_path / "t.json"))
    out = {r.trade_id: r for r in files.parsed_trades(raw.cache()).collect()}
    assert set(out) == {"1", "3"} and out["1"].usd == 50.0 and out["3"].large and out["1"].ts.year == 2023
    table = str(tmp_path / "table")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    files.append_new(rows, table, "id")
    files.append_new(spark.createDataFrame([(2, "z"), (3, "c")], "id int, v string"), table, "id")
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    old, new = (spark.createDataFrame([(1, a, p, f)], "id int, at int, price double, flag string") for a, p, f in ((1, 5.0, "x"), (2, 6.0, "y")))
    assert tuple(files.merged(old, new, "id", "at", ["price"]).first()) == (1, 2, 5.0, "y")


@pytest.mark.parametrize("name", ["ml_wallet_clusters", "ml_isolation_forest", "ml_density_clusters", "ml_elbow", "seq_down_sampled"])
def test_queries_without_sql_give_rows(spark, sf_dir, name):
    from tidewatch import catalog

    assert catalog.queries()[name](spark, sf_dir).count() > 0


def plain_lttb(rows, points):
    rows, n = sorted(rows), len(rows)
    if n <= points or points <= 2:
        return rows if n <= points else [rows[0], rows[-1]]
    size, kept = (n - 2) / (points - 2), [0]
    for i in range(points - 2):
        a, b, d = int((i + 1) * size), min(int((i + 2) * size), n), min(int((i + 3) * size), n)
        mx, my = (sum(r[0] for r in rows[b:d]) / (d - b), sum(r[1] for r in rows[b:d]) / (d - b)) if d > b else rows[-1]
        p = rows[kept[-1]]
        area = [abs((p[0] - mx) * (rows[j][1] - p[1]) - (p[0] - rows[j][0]) * (my - p[1])) for j in range(a, b)]
        kept += [a + area.index(max(area))] if area else []
    return [rows[i] for i in sorted({*kept, n - 1})]


@pytest.mark.parametrize(("points", "stretch"), [(3, 50), (20, 50), (100, 100_000)])
def test_down_sampling_equals_the_plain_way(spark, points, stretch):
    rng = random.Random(2)
    series = {"a": [(rng.randrange(10**6), round(rng.gauss(0, 5), 3)) for _ in range(997)], "b": [(i, float(i % 7)) for i in range(30)], "c": [(5, 1.0)]}
    series |= {"d": [(i // 3, round(rng.random(), 2)) for i in range(400)], "e": [(9, float(i)) for i in range(200)]}
    df = spark.createDataFrame([(k, x, y) for k, v in series.items() for x, y in v], "k string, x long, y double")
    got = {k: [] for k in series}
    for r in sequences.lttb(df, "k", "x", "y", points, stretch).collect():
        got[r.k].append((r.x, r.y))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_lttb(v, points) for k, v in series.items()}


def test_shared_pairs_without_a_cap(spark):
    rng = random.Random(4)
    sets = {i: {rng.randrange(30) for _ in range(rng.randrange(1, 8))} | ({0} if i % 3 else set()) for i in range(120)}
    rows = spark.createDataFrame([(i, k) for i, ks in sets.items() for k in ks], "item long, key long")
    for least in (1, 2, 3):
        want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least}
        for common in (3, 15, 1000):
            assert {(r.a, r.b): r.shared for r in graph.shared_pairs(rows, "item", "key", least, common).collect()} == want


def test_components_of_paths_loops_and_nothing(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200), (None, 5), (5, None), (100, 101)]
    out = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100, 200: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranks_need_no_single_order(spark):
    rng = random.Random(5)
    values = [round(rng.gauss(0, 3), 2) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(values)), "k long, v double")
    got = {r.k: r["rank"] for r in sequences.ranked(rows, -F.floor(F.col("v")), [F.desc("v"), "k"]).collect()}
    assert got == {k: i + 1 for i, (k, _) in enumerate(sorted(enumerate(values), key=lambda x: (-x[1], x[0])))}


def test_admitted_measures_from_the_last_one_let_through(spark):
    rows = spark.createDataFrame([("w", t, i) for i, t in enumerate((0, 50, 100, 150, 251, 300))], "w string, ts_ms long, trade_id long")
    assert [r.ts_ms for r in sequences.admitted(rows, ["w"], ["ts_ms", "trade_id"], 60).orderBy("ts_ms").collect()] == [0, 100, 251]


def test_frames_reach_into_the_chunks_before(spark):
    rows = spark.createDataFrame([("m", i, t, 1.0) for i, t in enumerate((0, 90, 110, 195, 210, 420))], "m string, id long, ts_ms long, usd double")
    out = sequences.rolling(rows, ["m"], "id", "usd", {"w": 100}, 100, 1)
    assert [r.sum_w for r in out.orderBy("ts_ms").collect()] == [1, 2, 2, 2, 3, 1]
    with pytest.raises(ValueError, match="wider"):
        sequences.rolling(rows, ["m"], "id", "usd", {"w": 101}, 100, 1)


@pytest.mark.parametrize("keys,chunk,block", [(["m"], 50, 4), ([], 7, 30), (["m"], 1000, 1)])
def test_frames_equal_a_plain_reading(spark, keys, chunk, block):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, rng.choice([rng.randint(0, 60), rng.randint(0, 3000)]), float(rng.randint(-9, 9))) for i in range(300)]
    out = sequences.rolling(spark.createDataFrame(rows, "m string, id long, ts_ms long, usd double").select(*keys, "id", "ts_ms", "usd"), keys, "id", "usd", {"x": 30, "y": 200, "z": 0}, chunk, block)
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(rows)
    for m, i, t, _ in rows:
        of = sorted((ts, k, u) for n, k, ts, u in rows if not keys or n == m)
        assert got[i]["last"] == [u for ts, _, u in of if ts <= t][-1]
        for name, width in (("x", 30), ("y", 200), ("z", 0)):
            frame = [(ts, u) for ts, _, u in of if t - width <= ts <= t]
            r = got[i]
            assert (r[f"n_{name}"], r[f"sum_{name}"], r[f"first_ms_{name}"], r[f"first_{name}"]) == (len(frame), sum(u for _, u in frame), *frame[0])


@pytest.mark.parametrize("chunk", [10, 100, 100_000])
def test_sessions_go_on_through_chunks(spark, chunk):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), i, rng.randint(0, 2000), 1.0) for i in range(300)]
    want = []
    for m in "ab":
        run = []
        for ts in [*sorted(ts for n, _, ts, _ in rows if n == m), None]:
            if run and (ts is None or ts - run[-1] > 12):
                want += [(m, run[0], run[-1], len(run), float(len(run)))] if len(run) > 1 else []
                run = []
            run.append(ts)
    out = sequences.sessions(spark.createDataFrame(rows, "m string, id long, ts_ms long, usd double"), ["m"], ["ts_ms", "id"], 12, 2, chunk)
    assert sorted(map(tuple, out.select("m", "start", "end", "n", "usd").collect())) == sorted(want)
