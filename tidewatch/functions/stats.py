"""Column functions for statistics and ladders whose conventions differ from Spark's own."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(value: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first step whose bound the value reaches; steps from the highest bound down."""
    out = None
    for bound, name in steps:
        out = F.when(value >= bound, name) if out is None else out.when(value >= bound, name)
    return out.otherwise(otherwise)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def bucket_ms(ts_ms: Column, width_ms: int) -> Column:
    """Start of the epoch-aligned bucket."""
    return (F.floor(ts_ms / width_ms) * width_ms).cast("long")


def sunday_week_ms(ts_ms: Column) -> Column:
    """Start of the week that begins on Sunday, 00:00 UTC; day 0 of the epoch is a Thursday."""
    day = F.floor(ts_ms / 86_400_000)
    return ((day - F.pmod(day + 4, F.lit(7))) * 86_400_000).cast("long")


def rounded(value: Column | str, places: int) -> Column:
    """Rounded a little above the half, so that exact halves come out alike on every engine."""
    return F.round(F.lit(1e-7) + (F.col(value) if isinstance(value, str) else value), places)


def half_up(value: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(value + 0.5)


def population_z(value: Column, mean: Column, std: Column) -> Column:
    """0 where there is no spread."""
    return F.when(std > 0, F.try_divide(value - mean, std)).otherwise(0.0)


def adjusted_skewness(n: Column, mean: Column, std_pop: Column, cubes: Column, squares: Column, total: Column) -> Column:
    """n / ((n-1)(n-2)) times the sum of cubed z-scores with the population deviation; 0 below three values or spread."""
    third = cubes - 3 * mean * squares + 3 * mean * mean * total - n * mean * mean * mean
    return F.when((n >= 3) & (std_pop > 0), F.try_divide(n * third, (n - 1) * (n - 2) * std_pop * std_pop * std_pop)).otherwise(0.0)


def percentile_rank(value: Column, points: Sequence[tuple[float, Column]]) -> Column:
    """Rank of a value from known percentiles by linear interpolation: 0 at zero, capped at 100.

    points: (percentile, column of its value) in ascending order. Beyond the last point the rest of the scale is used up
    in proportion to how far the value exceeds it.
    """
    (top, last), out = points[-1], None
    low_p, low_v = 0.0, F.lit(0.0)
    for p, v in points:
        inside = low_p + (p - low_p) * F.coalesce(F.try_divide(value - low_v, v - low_v), F.lit(0.0))
        out = F.when(value <= v, inside) if out is None else out.when(value <= v, inside)
        low_p, low_v = p, v
    beyond = top + (100 - top) * F.coalesce(F.try_divide(value - last, last), F.lit(1.0))
    return F.least(out.otherwise(beyond), F.lit(100.0))


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns in an aggregation; 0 without spread, where corr() would divide by zero."""
    n = F.count(F.lit(1))
    cov = n * F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y)
    vx, vy = (n * F.sum(F.col(c) * F.col(c)) - F.sum(c) * F.sum(c) for c in (x, y))
    return F.when((vx > 1e-9) & (vy > 1e-9), cov / F.sqrt(vx * vy)).otherwise(0.0)


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), union))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of equal length; 0 if either has no length."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: (x * y).cast("double")))
    norms = F.sqrt(total(F.transform(a, lambda x: (x * x).cast("double"))) * total(F.transform(b, lambda x: (x * x).cast("double"))))
    return F.when(norms > 0, F.try_divide(dot, norms)).otherwise(0.0)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share; 0 and 1 without observations."""
    p = F.try_divide(hits, n)
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(mid - half, F.lit(0.0))).otherwise(0.0), F.when(n > 0, F.least(mid + half, F.lit(1.0))).otherwise(1.0)


def two_proportion_z(h1: Column, n1: Column, h2: Column, n2: Column) -> Column:
    """z of the difference of two shares with pooled variance; 0 where it is undefined."""
    pool = F.try_divide(h1 + h2, n1 + n2)
    spread = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    return F.when(spread > 0, F.try_divide(F.try_divide(h1, n1) - F.try_divide(h2, n2), spread)).otherwise(0.0)
