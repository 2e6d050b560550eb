"""Order-dependent operators: gaps, runs, rolling frames, folds and down-sampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sessions(rows: DataFrame, keys: Sequence[str], order: Sequence[str], gap_ms: int, least: int, chunk_ms: int = 86_400_000) -> DataFrame:
    """Runs of rows of a key in which no step is longer than the gap: keys, start, end, n, usd; runs below `least` go.

    A key is dealt by chunks of time. The first and the last run of a chunk may go on in the chunks beside it: these two
    a chunk are put together in the order of time, all others are whole.
    """
    dealt = rows.withColumn("_chunk", F.floor(F.col("ts_ms") / chunk_ms))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    new = F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(w) > gap_ms).cast("int"), F.lit(1))
    marked = dealt.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*keys, "_chunk", "_run").agg(F.min("ts_ms").alias("start"), F.max("ts_ms").alias("end"), F.count("*").alias("n"), F.sum("usd").alias("usd"))
    runs = runs.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(Window.partitionBy(*keys, "_chunk"))))
    inner = runs.filter(~F.col("_edge")).select(*keys, "start", "end", "n", "usd")
    at = Window.partitionBy(*keys).orderBy("start")
    apart = F.coalesce((F.col("start") - F.lag("end").over(at) > gap_ms).cast("int"), F.lit(1))
    edges = runs.filter("_edge").withColumn("_new", apart).withColumn("_run", F.sum("_new").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edges.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.sum("usd").alias("usd")).drop("_run")
    return inner.union(joined).filter(F.col("n") >= least)


def streaks(rows: DataFrame, key: str, order: Sequence[str], outcome: str) -> DataFrame:
    """Longest and current runs of equal outcomes of each key: key, longest_true, longest_false, current (negative: false)."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.coalesce((F.col(outcome) != F.lag(outcome).over(w)).cast("int"), F.lit(1))
    runs = rows.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lengths = runs.groupBy(key, "_run", outcome).agg(F.count("*").alias("n"))
    longest = lambda flag: F.coalesce(F.max(F.when(F.col(outcome) == flag, F.col("n"))), F.lit(0))
    return lengths.groupBy(key).agg(longest(True).alias("longest_true"), longest(False).alias("longest_false"), F.max_by(F.when(F.col(outcome), F.col("n")).otherwise(-F.col("n")), "_run").alias("current"))


def largest_gap(rows: DataFrame, key: str, order: Sequence[str], least_ms: int) -> DataFrame:
    """The longest pause of each key over `least_ms`, the earliest of equal ones: key, before, after, gap."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = rows.select(key, F.lag("ts_ms").over(w).alias("before"), F.col("ts_ms").alias("after")).withColumn("gap", F.col("after") - F.col("before")).filter(F.col("gap") > least_ms)
    best = F.max_by(F.struct("before", "after", "gap"), F.struct("gap", -F.col("after")))
    return steps.groupBy(key).agg(best.alias("g")).select(key, "g.*")


def rolling(rows: DataFrame, keys: Sequence[str], ident: str, value: str, widths: dict[str, int], chunk_ms: int = 3_600_000, block: int = 24) -> DataFrame:
    """keys, ident, ts_ms and value of each row with last, the value of the last row of its instant, and for each width
    n_, sum_, first_ms_ and first_ of the rows in [ts_ms - width, ts_ms]: count, sum, and the first row's time and value.

    Rows and the points at which their frames begin are sorted once, dealt by chunks of time; running counts and sums
    within a chunk, and those of the chunks before it in its block, are subtracted at a frame's ends, so that the work
    doesn't grow with the width and a busy key is as many tasks as it has chunks. No width may exceed a block. Of rows
    of one instant that with the smaller ident is first; idents are distinct.
    """
    if max(widths.values()) > chunk_ms * block:
        raise ValueError("a frame must not be wider than a block")
    point = lambda name, at, real: F.struct(F.lit(name).cast("string").alias("_name"), at.alias("_at"), F.lit(real).alias("_real"))
    at = [point(None, F.col("ts_ms"), 1), *(point(name, F.col("ts_ms") - width, 0) for name, width in widths.items())]
    points = rows.select(*keys, ident, "ts_ms", value, F.inline(F.array(*at))).withColumn("_chunk", F.floor(F.col("_at") / chunk_ms))
    real = F.col("_real") == 1
    row = F.when(real, F.struct(F.col("_at").alias("at"), F.col(ident).alias("id"), F.col(value).cast("double").alias("v")))
    amount = F.when(real, F.col(value).cast("double")).otherwise(0.0)
    # a frame's beginning sorts before the rows of its instant, which it takes in; one sort serves both windows
    up = Window.partitionBy(*keys, "_chunk").orderBy("_at", "_real")
    named = ", ".join(f"`{k}`" for k in (*keys, "_chunk"))
    points = points.withColumn("_row", row)
    seen = points.withColumn("_next", F.expr(f"lead(_row) IGNORE NULLS OVER (PARTITION BY {named} ORDER BY _at, _real, `{ident}`)"))
    seen = seen.withColumns({"_n": F.sum(F.col("_real").cast("long")).over(up), "_s": F.sum(amount).over(up), "_last": F.max("_row").over(up)["v"]})
    # the least of structs is found by sorting, so rows alone go there; chunks that only frames begin in have none
    held = rows.select(*keys, F.floor(F.col("ts_ms") / chunk_ms).alias("_chunk"), F.col(value).cast("double").alias("_v"), F.struct(F.col("ts_ms").alias("at"), F.col(ident).alias("id"), F.col(value).cast("double").alias("v")).alias("_row"))
    held = held.groupBy(*keys, "_chunk").agg(F.count("*").alias("_k"), F.sum("_v").alias("_sum"), F.min("_row").alias("first"))
    held = held.select(*[F.col(k).alias(f"_of_{i}") for i, k in enumerate((*keys, "_chunk"))], "_k", "_sum", "first")
    alike = [F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate((*keys, "_chunk"))]
    chunks = points.select(*keys, "_chunk").distinct().join(held, alike, "left")
    chunks = chunks.select(*keys, "_chunk", F.coalesce("_k", F.lit(0)).alias("n"), F.coalesce("_sum", F.lit(0.0)).alias("s"), "first")
    in_block = Window.partitionBy(*keys, F.floor(F.col("_chunk") / block))
    before = in_block.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    sums = {"_n0": F.coalesce(F.sum("n").over(before), F.lit(0)), "_s0": F.coalesce(F.sum("s").over(before), F.lit(0.0)), "_n1": F.sum("n").over(in_block), "_s1": F.sum("s").over(in_block), "_first": F.min("first").over(later)}
    both = seen.join(chunks.select(*keys, "_chunk", *[c.alias(k) for k, c in sums.items()]), [*keys, "_chunk"])
    # what a frame's beginning adds to the sums at its end: less all before it, and the rest of its block if that is another
    other = F.floor(F.col("_chunk") / block) != F.floor(F.floor(F.col("ts_ms") / chunk_ms) / block)
    part = {x: F.when(real, F.col(f"_{x}0") + F.col(f"_{x}")).otherwise(F.when(other, F.col(f"_{x}1")).otherwise(0) - F.col(f"_{x}0") - F.col(f"_{x}")) for x in "ns"}
    first = F.coalesce("_next", "_first")
    flat = both.select(*keys, ident, "ts_ms", value, "_name", part["n"].alias("_n"), part["s"].alias("_s"), F.when(real, F.col("_last")).alias("_last"), first["at"].alias("_ms"), first["v"].alias("_v"))
    out = [F.max("_last").alias("last")]
    for name in widths:
        mine = F.col("_name") == name
        out += [F.sum(F.when(mine | F.col("_name").isNull(), F.col(c))).alias(f"{k}_{name}") for k, c in (("n", "_n"), ("sum", "_s"))]
        out += [F.max(F.when(mine, F.col(c))).alias(f"{k}_{name}") for k, c in (("first_ms", "_ms"), ("first", "_v"))]
    # the points of a row lie in as many chunks: they travel as they are, for sums of each task would only be wider
    return flat.repartition(*keys, ident).groupBy(*keys, ident, "ts_ms", value).agg(*out)


def anchored_windows(rows: DataFrame, keys: Sequence[str], width_ms: int, step_ms: int) -> DataFrame:
    """rows with window_start: closed windows [s, s + width] for s = first row of the key + i * step, each row in all
    that hold it. The number of windows of a row is width / step + 1 at most. First rows come from an aggregation, one a
    key, so that no key is gathered in one task."""
    first = rows.groupBy(*keys).agg(F.min("ts_ms").alias("_first"))
    at = rows.join(first, list(keys)).withColumn("_at", F.col("ts_ms") - F.col("_first"))
    low = F.greatest(F.ceil((F.col("_at") - width_ms) / step_ms), F.lit(0).cast("long"))
    return at.select("*", F.explode(F.sequence(low, F.floor(F.col("_at") / step_ms))).alias("_i")).withColumn("window_start", F.col("_first") + F.col("_i") * step_ms).drop("_at", "_first", "_i")


def anchored_totals(rows: DataFrame, keys: Sequence[str], width_ms: int, step_ms: int) -> DataFrame:
    """keys, window_start, n, wallets, usd and buys of the windows of anchored_windows, without a row for each row and window.

    The windows that hold a row follow each other, and so do those that the rows of one wallet hold together: a row
    brings its wallet to those windows alone that the wallet's row before it doesn't reach. Rows are counted by their
    first and last window and by the first that is new to their wallet, a few cells a step; cells are spread to windows.
    """
    first = rows.groupBy(*keys).agg(F.min("ts_ms").alias("_first"))
    at = rows.join(first, list(keys)).withColumn("_at", F.col("ts_ms") - F.col("_first"))
    low, high = F.greatest(F.ceil((F.col("_at") - width_ms) / step_ms), F.lit(0).cast("long")), F.floor(F.col("_at") / step_ms)
    at = at.withColumns({"_low": low, "_high": high}).filter("_low <= _high")
    reached = F.lag("_high").over(Window.partitionBy(*keys, "wallet").orderBy("ts_ms"))
    new = F.when(F.col("wallet").isNull(), F.col("_high") + 1).otherwise(F.greatest("_low", F.coalesce(reached + 1, F.lit(0).cast("long"))))
    cells = at.withColumn("_new", new).groupBy(*keys, "_first", "_low", "_high", "_new").agg(F.count("*").alias("n"), F.sum("usd").alias("usd"), F.count_if(F.col("side") == "BUY").alias("buys"))
    each = cells.withColumn("_i", F.explode(F.sequence("_low", "_high")))
    sums = each.groupBy(*keys, (F.col("_first") + F.col("_i") * step_ms).alias("window_start")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_i") >= F.col("_new"), F.col("n")).otherwise(0)).alias("wallets"), F.sum("usd").alias("usd"), F.sum("buys").alias("buys"))
    return sums


def admitted(rows: DataFrame, keys: Sequence[str], order: Sequence[str], ttl_ms: int) -> DataFrame:
    """The rows of each key that come more than ttl_ms after the last one admitted; the first one is.

    A fold over a key's instants in order; they are one array, so keys must be bounded (a wallet in a market).
    """
    held = F.array_sort(F.collect_list(F.struct(*order)))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.slice(held, 1, 0).alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        goes = F.coalesce(x["ts_ms"] - acc["last"] <= ttl_ms, F.lit(False))
        return F.when(goes, acc).otherwise(F.struct(x["ts_ms"].alias("last"), F.array_append(acc["rows"], x).alias("rows")))

    return rows.groupBy(*keys).agg(F.aggregate(held, start, step)["rows"].alias("_rows")).select(*keys, F.inline("_rows"))


def ranked(rows: DataFrame, chunk: Column, order: Sequence[Column | str]) -> DataFrame:
    """rows with `rank`, 1 and up in this order over all of them; chunk is a whole number that rises with the order.

    Rows are numbered within their chunk and the counts of the chunks before are added: one task has a chunk, and only
    one row a chunk is ever put in one order.
    """
    named = rows.withColumn("_chunk", chunk)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = named.groupBy("_chunk").agg(F.count("*").alias("_n")).select(F.col("_chunk").alias("_c"), before.alias("_before"))
    at = F.row_number().over(Window.partitionBy("_chunk").orderBy(*order))
    return named.join(starts, F.col("_chunk") == F.col("_c")).withColumn("rank", (F.col("_before") + at).cast("long")).drop("_chunk", "_c", "_before")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], tie: str) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before it, by one sort of both sides.

    Of right rows at one instant, the one with the greatest `tie` counts. Nulls where there is none.
    """
    held = F.struct(*[F.col(v) for v in values])
    a = left.withColumns({"_right": F.lit(None).cast(right.select(held).schema[0].dataType), "_side": F.lit(1), "_tie": F.lit(None).cast(right.schema[tie].dataType)})
    b = right.select(*keys, "ts_ms", held.alias("_right"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("ts_ms", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    return found.select(*left.columns, *[F.col("_found")[v].alias(v) for v in values])


def average_cost(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Position of each key by the average-cost rule: key, size, cost (of what is held), realised.

    Buys add to size and cost; sells realise price minus average cost on their size and may leave a negative size. A
    fold over the key's trades in order; a key's trades are one array, so keys must be bounded (a wallet in a market).
    """
    ordered = F.array_sort(F.collect_list(F.struct(*order, "side", "price", "size")))
    start = F.struct(F.lit(0.0).alias("size"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("realised"))

    def step(acc: Column, x: Column) -> Column:
        mean = F.coalesce(F.try_divide(acc["cost"], acc["size"]), F.lit(0.0))
        buy = F.struct((acc["size"] + x["size"]).alias("size"), (acc["cost"] + x["size"] * x["price"]).alias("cost"), acc["realised"].alias("realised"))
        sell = F.struct((acc["size"] - x["size"]).alias("size"), (acc["cost"] - x["size"] * mean).alias("cost"), (acc["realised"] + x["size"] * (x["price"] - mean)).alias("realised"))
        return F.when(x["side"] == "BUY", buy).otherwise(sell)

    return rows.groupBy(*key).agg(F.aggregate(ordered, start, step).alias("p")).select(*key, "p.*")


def drawdown(rows: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Total and largest fall from a peak of each key's running sum; the peak starts at 0."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select(key, *order, F.sum(value).over(w).alias("_sum"))
    peak = run.withColumn("_peak", F.greatest(F.max("_sum").over(w), F.lit(0.0)))
    return peak.groupBy(key).agg(F.max_by("_sum", F.struct(*order)).alias("total"), F.max(F.col("_peak") - F.col("_sum")).alias("drawdown"))


#: Rows of a series that one task reduces at a time when it is down-sampled.
STRETCH = 100_000


def _hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the corners of the convex hull of points in ascending order of x, then y; of equal points the first."""
    first = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
    at = np.flatnonzero(first)
    if len(at) < 3:
        return at

    def half(order: np.ndarray) -> list[int]:
        out: list[int] = []
        for i in order.tolist():
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (y[i] - y[out[-2]]) <= (y[out[-1]] - y[out[-2]]) * (x[i] - x[out[-2]]):
                out.pop()
            out.append(i)
        return out

    return np.array(sorted({*half(at), *half(at[::-1])}))


def lttb(rows: DataFrame, key: str, x: str, y: str, points: int, stretch: int = STRETCH) -> DataFrame:
    """Largest-triangle down-sampling of each series to `points` rows; first and last always stay.

    Bucket i takes positions (i + 1) * size to (i + 2) * size, so that the rows before the first bucket are no
    candidates; each bucket keeps the row whose triangle with the row kept before and the next bucket's mean is largest.
    The area is linear in the row, so the largest one is at a corner of the bucket's convex hull: buckets are reduced to
    their corners in stretches of `stretch` rows at most, in parallel, and only the corners of a series, a few dozen a
    bucket, meet in one task for the choice, in which each depends on the one before.
    """
    part = rows.select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"))
    # positions without gathering a series: counts of steps of its range before, and a number within the step
    ends = part.groupBy("k").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))
    wide = F.greatest((F.col("high") - F.col("low")) / F.greatest(F.ceil(F.col("n") / stretch), F.lit(1)), F.lit(1e-300))
    placed = part.join(ends, "k").withColumn("step", F.floor((F.col("x") - F.col("low")) / wide))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("k").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("k", "step").agg(F.count("*").alias("m")).select("k", "step", before.alias("before"))
    at = F.col("before") + F.row_number().over(Window.partitionBy("k", "step").orderBy("x", "y")) - 1
    placed = placed.join(starts, ["k", "step"]).select("k", "x", "y", "n", at.cast("long").alias("at"))
    whole = placed.filter(F.col("n") <= points).select("k", "x", "y")
    if points <= 2:
        few = placed.filter((F.col("n") > points) & ((F.col("at") == 0) | (F.col("at") == F.col("n") - 1))).select("k", "x", "y")
        return whole.union(few).select(F.col("k").alias(key), F.col("x").alias(x), F.col("y").alias(y))
    size = (F.col("n") - 2) / (points - 2)
    large = placed.filter(F.col("n") > points).withColumn("bucket", (F.ceil((F.col("at") + 1) / size) - 2).cast("int"))
    means = large.filter("bucket >= 1").groupBy("k", "bucket").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))

    def corners(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at").reset_index(drop=True)
        return group.iloc[_hull(group.x.to_numpy(float), group.y.to_numpy(float))]

    held = large.filter(F.col("bucket").between(0, points - 3)).withColumn("part", F.floor(F.col("at") / stretch))
    one = held.groupBy("k", "bucket", "part").applyInPandas(corners, held.schema)
    two = one.groupBy("k", "bucket").applyInPandas(corners, held.schema)
    first_last = large.filter((F.col("at") == 0) | (F.col("at") == F.col("n") - 1)).withColumn("part", F.lit(-1).cast("long"))
    following = means.select("k", (F.col("bucket") - 1).alias("bucket"), "mx", "my")
    candidates = two.unionByName(first_last).join(following, ["k", "bucket"], "left").select("k", "x", "y", "at", "bucket", "part", "mx", "my")

    def chosen(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values(["part", "at"])
        ends_ = series[series.part < 0]
        kept = [ends_.iloc[0]]
        for _, b in series[series.part >= 0].groupby("bucket", sort=True):
            last, c = kept[-1], b.sort_values("at")
            mx, my = (c.mx.iloc[0], c.my.iloc[0]) if c.mx.notna().iloc[0] else (float(ends_.iloc[-1].x), float(ends_.iloc[-1].y))
            area = abs((last.x - mx) * (c.y.to_numpy(float) - last.y) - (last.x - c.x.to_numpy(float)) * (my - last.y))
            kept.append(c.iloc[int(area.argmax())])
        out = pd.DataFrame([*kept, ends_.iloc[-1]]).drop_duplicates("at")
        return out[["k", "x", "y"]].astype({c: series[c].dtype for c in ("k", "x", "y")})

    found = candidates.groupBy("k").applyInPandas(chosen, part.schema)
    return whole.union(found).select(F.col("k").alias(key), F.col("x").alias(x), F.col("y").alias(y))


def regularity(rows: DataFrame, key: str, intervals: str, tolerance_ms: int) -> DataFrame:
    """Share of each key's intervals in its largest group; groups are made greedily in order, each around its first
    interval, within the tolerance. rows: (key, array of intervals in order)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, values in zip(b[key], b[intervals], strict=True):
                heads: list[list[float]] = []
                for v in values:
                    group = next((h for h in heads if abs(h[0] - v) <= tolerance_ms), None)
                    if group is None:
                        heads.append([v, 1])
                    else:
                        group[1] += 1
                out.append((k, max((h[1] for h in heads), default=0) / max(1, len(values))))
            yield pd.DataFrame(out, columns=[key, "regularity"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, intervals).mapInPandas(each, f"{key} {kind}, regularity double")
