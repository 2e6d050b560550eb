"""Streams: what travels to workers without this package, and instants that differ below a millisecond."""

import subprocess
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidewatch.streaming import episodes, trades


def test_the_processor_travels_whole(tmp_path):
    at = tmp_path / "processor"
    at.write_bytes(cloudpickle.dumps(episodes.processor()))
    code = f"import pickle; p = pickle.load(open({str(at)!r}, 'rb')); print([p.handleExpiredTimer.__code__.co_varnames[:4], p.handleInputRows.__code__.co_varnames[:4]])"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env={"PYTHONPATH": ""}, timeout=120, check=True).stdout
    assert out.strip() == "[('self', 'key', 'timerValues', 'expiredTimerInfo'), ('self', 'key', 'rows', 'timerValues')]"


def test_spikes_go_by_milliseconds(spark, tmp_path):
    # 6 and 7 are in one millisecond, the greater id first by microseconds; 8 comes 59,999.1 ms after 6, but in the 60,000th
    rows = [(i, i * 1_000_000, 1.0 + i % 2) for i in range(6)] + [(7, 9_000_100, 60.0), (6, 9_000_900, 50.0), (8, 69_000_000, 900.0)]
    folder = tmp_path / "in"
    spark.createDataFrame(rows, "trade_id long, us long, usd double").select("trade_id", F.timestamp_micros("us").alias("ts"), "usd", F.lit("m").alias("market")).coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema("trade_id long, ts timestamp, usd double, market string").parquet(str(folder))
    out = trades.spikes(stream)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.trade_id for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()) == [6, 8]
