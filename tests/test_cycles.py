"""Incremental cycles, states that merge, thresholds that learn, and episodes over several batches of a stream."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import feedback, incremental, profiles
from tidewatch.plans.cycles import hourly
from tidewatch.streaming import episodes

HOUR, DAY = 3_600_000, 86_400_000


def trades(spark, rows):
    return spark.createDataFrame(rows, "trade_id long, market string, ts_ms long, usd double")


def test_cycles_make_what_one_pass_makes(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.randint(0, 6 * DAY), float(rng.randint(1, 9))) for i in range(500)]
    late = {i for i, *_ in rows if rng.random() < 0.1}
    at = str(tmp_path / "s")
    assert incremental.high_water(spark, at) is None
    seen = []
    for upto in (DAY, 2 * DAY + 5 * HOUR, 2 * DAY + 5 * HOUR, 4 * DAY, 6 * DAY + 2 * HOUR):
        there = [r for r in rows if r[2] + (2 * HOUR if r[0] in late else 0) <= upto]
        incremental.cycle(trades(spark, there), at, upto, 2 * HOUR, hourly)
        assert incremental.high_water(spark, at) == upto
        seen.append(sorted(map(tuple, incremental.state(spark, at).select("market", "bucket", "n", "usd", "most").collect())))
    assert seen[1] == seen[2]  # the same cycle again
    assert seen[-1] == sorted(map(tuple, hourly(trades(spark, rows)).collect()))


def test_old_days_are_left_alone(spark, tmp_path):
    at = str(tmp_path / "s")
    rows = [(i, "a", i * HOUR, 1.0) for i in range(24 * 5)]
    incremental.cycle(trades(spark, rows[: 24 * 4]), at, 4 * DAY, HOUR, hourly)
    files = {d.name: {f.name for f in d.iterdir()} for d in (tmp_path / "s" / "state").glob("day=*")}
    incremental.cycle(trades(spark, rows), at, 5 * DAY, HOUR, hourly)
    after = {d.name: {f.name for f in d.iterdir()} for d in (tmp_path / "s" / "state").glob("day=*")}
    assert [after[f"day={k}"] == files.get(f"day={k}") for k in range(5)] == [True, True, True, False, False]


def test_states_merge_to_the_whole(spark):
    rng = random.Random(9)
    rows = [(w, rng.randint(0, 5 * DAY), rng.choice([0.0, 1e9 + rng.random(), rng.expovariate(0.02)]), rng.choice("abcde")) for w in range(6) for _ in range(rng.randint(1, 200))]
    frame = spark.createDataFrame(rows, "wallet long, ts_ms long, usd double, market string").withColumn("day", F.floor(F.col("ts_ms") / DAY))
    whole = {r.wallet: r for r in profiles.states(frame, ["wallet"], "usd", "market").select("*", F.hll_sketch_estimate("seen").alias("k")).collect()}
    parts = profiles.merged(profiles.states(frame, ["wallet", "day"], "usd", "market").drop("day"), ["wallet"])
    for r in parts.select("*", F.hll_sketch_estimate("seen").alias("k"), profiles.quantile(0.5).alias("q")).collect():
        one, values = whole[r.wallet], sorted(u for w, _, u, _ in rows if w == r.wallet)
        assert (r.n, r.low, r.high, r.first_ms, r.last_ms, r.k, r.bins) == (one.n, one.low, one.high, one.first_ms, one.last_ms, one.k, one.bins)
        assert (r.n, r.k) == (len(values), len({m for w, _, _, m in rows if w == r.wallet}))
        assert r.mean == pytest.approx(statistics.fmean(values)) and math.sqrt(r.m2 / r.n) == pytest.approx(statistics.pstdev(values), rel=1e-9, abs=1e-6)
        middle = values[math.ceil(len(values) * 0.5) - 1]
        assert r.q == pytest.approx(middle, rel=0.03) or middle == 0 == r.q


def test_thresholds_move_within_limits_and_rest(spark):
    rules = [feedback.Rule("up", "z", 1.0, 50.0, -30.0, 60.0, 2), feedback.Rule("down", "y", -1.0, -50.0, -30.0, 60.0, 1)]
    days = [("a", 0, 2.0, None), ("a", 1, 2.0, 0.0), ("a", 2, 2.0, 0.0), ("a", 3, 0.0, -3.0), ("a", 4, 5.0, -2.0), ("a", 5, None, -2.0), ("b", 0, 0.0, 0.0)]
    frame = spark.createDataFrame(days, "market string, day long, z double, y double").repartition(3)
    got = sorted((r.market, r.day, r.rule, round(r.before, 6), round(r.after, 6)) for r in feedback.moves(frame, "market", 100.0, rules).collect())
    assert got == [("a", 0, "up", 100.0, 150.0), ("a", 2, "up", 150.0, 160.0), ("a", 3, "down", 160.0, 80.0), ("a", 4, "down", 120.0, 70.0), ("a", 4, "up", 80.0, 120.0)]


def loop_of_episodes(hours):
    """hours: (start, usd) in order."""
    out, seen, open_ = [], [], None
    for at, usd in hours:
        if open_ and at - open_["last"] > episodes.CALM_HOURS * HOUR:
            out.append(("end", open_["last"], open_["start"], open_["peak"], open_["n"]))
            open_ = None
        if len(seen) >= episodes.NEEDED and statistics.pstdev(seen) > 0 and usd >= statistics.fmean(seen) + episodes.DEVIATIONS * statistics.pstdev(seen):
            if not open_:
                open_ = {"start": at, "peak": usd, "n": 0}
                out.append(("begin", at, at, usd, 1))
            elif usd > open_["peak"]:
                open_["peak"] = usd
                out.append(("peak", at, open_["start"], usd, open_["n"] + 1))
            open_ |= {"last": at, "n": open_["n"] + 1}
        seen.append(usd)
    return out, open_


def test_episodes_over_several_batches(spark, tmp_path):
    rng = random.Random(8)
    rows, folder = [], tmp_path / "in"
    for hour in range(60):
        usd = rng.uniform(1, 10) + (60 + hour if hour in (9, 10, 12, 30, 31, 50) else 0)
        rows += [("m", hour * HOUR + k * 1000, usd / 4) for k in range(4)] + ([("k", hour * HOUR, 5.0 + hour % 3)] if hour < 40 else [])
    for i in range(6):  # a file a batch
        part = [r for r in rows if r[1] // (10 * HOUR) == i]
        spark.createDataFrame(part, "market string, ms long, usd double").select("market", F.timestamp_millis("ms").alias("ts"), "usd").coalesce(1).write.parquet(str(folder / f"p{i}"))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("market string, ts timestamp, usd double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
        out = episodes.episodes(stream)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(name, before)
    got = sorted((r.kind, r.at_ms, r.start_ms, round(r.peak, 6), r.hours) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).filter("market = 'm'").collect())
    hours = [(h * HOUR, sum(u for m, ts, u in rows if m == "m" and ts // HOUR == h)) for h in range(58)]
    want, left = loop_of_episodes(hours)
    if left:  # nothing followed for long enough
        want.append(("end", left["last"], left["start"], left["peak"], left["n"]))
    assert got == sorted((k, a, s, round(p, 6), n) for k, a, s, p, n in want)


def test_predictions_leave_out_what_is_missing(spark):
    from tidewatch.operators import prediction
    from tidewatch.operators.prediction import Feature

    features = [Feature("a", 0.5, True, 0.8), Feature("b", 0.3, False, 0.5), Feature("c", 0.2, True, 0.1)]
    rows = [(1, 1.0, 0.0, 0.5), (2, None, 0.9, None), (3, None, None, None), (4, 0.2, 2 / 3, 0.5)]
    got = {r.k: r for r in prediction.judged(spark.createDataFrame(rows, "k long, a double, b double, c double"), "k", features).collect()}
    assert (got[1].raw, got[1].confidence, got[1].standing_out, got[1].factors) == (pytest.approx(0.9), pytest.approx(1.0), 3, ["a", "b", "c"])
    assert (got[2].raw, got[2].confidence, got[2].standing_out, got[2].factors) == (pytest.approx(0.1), pytest.approx((1 / 3 + 0.3) / 2), 0, ["b"])
    assert (got[3].raw, got[3].confidence, got[3].factors) == (0.5, 0.0, [])
    assert got[4].factors == ["a", "b", "c"]  # equal contributions go by name
    one = spark.range(1).select(prediction.platt(F.lit(0.5), -6.0, 3.0).alias("p"), prediction.tempered(F.lit(0.5), 0.7).alias("t"), prediction.outcome_probability({"x": (F.lit(2.0), 0.5)}, F.lit(0.5), -1.0, 2.0).alias("o")).first()
    assert (one.p, one.t, one.o) == (pytest.approx(0.5), pytest.approx(0.5), pytest.approx(0.5))
