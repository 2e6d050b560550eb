"""What the operators share: words, scratch tables and contiguous runs of sorted rows."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java regular expression.
GAP = r"[\x20\x09-\x0D]+"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for a null or empty text."""
    return F.array_remove(F.split(text_or_empty(text), GAP), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, even if the body names it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset (local runs), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: What ``saved`` has written and nothing has deleted yet, by path.
_TABLES: dict[str, DataFrame] = {}
#: The tables of the ``scratch`` block that this thread is in.
_BLOCK: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame as Parquet into the scratch folder and read it back: the lineage ends there.

    Whatever isn't ``dropped`` before goes when the driver ends, with which no frame outlives its tables.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _TABLES[path] = out
    if (block := _BLOCK.get()) is not None:
        block.append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete what ``saved`` wrote, once nothing reads it any more; what is gone already is passed over."""
    for df in tables:
        if _TABLES.pop(df._scratch_path, None) is not None:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """A block whose own tables are listed, those that other threads save meanwhile not among them."""
    tables: list[DataFrame] = []
    token = _BLOCK.set(tables)
    try:
        yield tables
    finally:
        _BLOCK.reset(token)


def table_count() -> int:
    """How many scratch tables there are."""
    return len(_TABLES)


@atexit.register
def _all_dropped() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        dropped(*list(_TABLES.values()))


def sampled(known: DataFrame, most_rows: int) -> DataFrame:
    """The rows of known(doc_id, ...) with the smallest hashes of doc_id, `most_rows` at most.

    A cut at twice the share that is wanted comes first, so that what tasks send to be ordered doesn't grow with them.
    """
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    share = min(1.0, 2 * most_rows / max(1, n))
    return known.filter(draw < F.lit(int(share * (1 << 20)) + 1)).orderBy(draw, F.xxhash64("doc_id"), "doc_id").limit(most_rows)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Column arrays of each run of equal integer keys, from batches in which equal keys stand together."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        held = now if held is None else {n: np.concatenate([held[n], now[n]]) for n in now}
        differs = np.zeros(len(held[keys[0]]) - 1, dtype=bool)
        for k in keys:
            differs |= held[k][1:] != held[k][:-1]
        cuts = np.flatnonzero(differs) + 1
        for a, b in zip(np.r_[0, cuts[:-1]] if len(cuts) else [], cuts, strict=True):
            yield {n: x[a:b] for n, x in held.items()}
        if len(cuts):
            held = {n: x[cuts[-1] :] for n, x in held.items()}
    if held is not None:
        yield held
