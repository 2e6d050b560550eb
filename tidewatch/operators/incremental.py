"""Cycles that take in what is new: a high-water mark, days worked out anew as far as rows may come late, the rest kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def high_water(spark: SparkSession, folder: str) -> int | None:
    """The time up to which cycles in this folder have taken in rows; None before the first."""
    try:
        return spark.read.schema("mark long").parquet(f"{folder}/mark").agg(F.max("mark")).first()[0]
    except AnalysisException:  # there is none yet
        return None


def cycle(source: DataFrame, folder: str, upto: int, late_ms: int, summed: Callable[[DataFrame], DataFrame]) -> None:
    """Take in the rows of source(ts_ms, ...) up to a time; rows may come `late_ms` after theirs.

    summed(rows) gives rows with a column bucket, the start of a stretch of time within a day. Days from the mark less
    `late_ms` on are read and summed again and replace those that are stored, each day on its own; earlier ones are
    neither read nor written. The mark moves last, so that a cycle that broke off is made good by the next one, and one
    that is run again changes nothing.
    """
    spark = source.sparkSession
    mark = high_water(spark, folder)
    start = None if mark is None else (mark - late_ms) // DAY_MS * DAY_MS
    rows = source.filter(F.col("ts_ms") <= upto) if start is None else source.filter(F.col("ts_ms").between(start, upto))
    days = summed(rows).withColumn("day", F.floor(F.col("bucket") / DAY_MS))
    days.write.partitionBy("day").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{folder}/state")
    spark.range(1).select(F.lit(max(upto, mark or upto)).cast("long").alias("mark")).write.mode("overwrite").parquet(f"{folder}/mark")


def state(spark: SparkSession, folder: str) -> DataFrame:
    """All that cycles have summed."""
    return spark.read.parquet(f"{folder}/state").drop("day")
