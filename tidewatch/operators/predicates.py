"""Stored filters against rows: an inverted index of one condition a filter, the others checked on what it finds.

conditions(filter, field, kind, any, low, high) has a row for each condition of a filter; kinds are
"one" (the row's values of the field meet the list; an empty list meets nothing), "flag" (the same, with one value),
"any" (the same, but an empty list is no condition) and "range" (low to high, both included; null is no bound).
A filter without conditions fits every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a numeric field are told apart in so many levels of halves of its range when a range is looked up.
LEVELS = 10
_SCHEMA = ("filter", "field", "kind", "any", "low", "high")


def merged(conditions: DataFrame, groups: DataFrame) -> DataFrame:
    """The conditions of all filters of a group at once, with the group as filter; groups(group, filter) are distinct.

    Lists of one field are intersected, and so are ranges; of flags the one of the last filter counts. Values are
    counted, not gathered, so that a group may have any number of filters.
    """
    own = conditions.join(groups, "filter").select("group", *_SCHEMA)
    lists = own.filter(F.col("kind").isin("one", "any"))
    size = lists.groupBy("group", "field", "kind").agg(F.countDistinct("filter").alias("filters"))
    held = lists.select("group", "field", "kind", "filter", F.explode(F.array_distinct("any")).alias("value")).groupBy("group", "field", "kind", "value").agg(F.count("*").alias("n"))
    met = held.join(size, ["group", "field", "kind"]).filter("n = filters").groupBy("group", "field", "kind").agg(F.array_sort(F.collect_list("value")).alias("any"))
    none = F.array().cast("array<string>")
    lists = size.join(met, ["group", "field", "kind"], "left").select(F.col("group").alias("filter"), "field", "kind", F.coalesce("any", none).alias("any"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    flags = own.filter("kind = 'flag'").groupBy("group", "field", "kind").agg(F.max_by("any", "filter").alias("any")).select(F.col("group").alias("filter"), "field", "kind", "any", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    ranges = own.filter("kind = 'range'").groupBy("group", "field", "kind").agg(F.max("low").alias("low"), F.min("high").alias("high")).select(F.col("group").alias("filter"), "field", "kind", F.lit(None).cast("array<string>").alias("any"), "low", "high")
    return lists.union(flags).union(ranges)


def _cover(low: Column, high: Column) -> Column:
    """Tokens of the largest halves of halves that make up the places from low to high."""

    def inside(level: int) -> tuple[Column, Column]:
        return F.ceil(low / float(1 << level)), F.floor((high + 1) / float(1 << level)) - 1

    cells = []
    for level in range(LEVELS + 1):
        a, b = inside(level)
        up_a, up_b = inside(level + 1)
        alone = lambda c, up_a=up_a, up_b=up_b: ~F.floor(c / 2).between(up_a, up_b) if level < LEVELS else F.lit(True)  # noqa: B023, E731
        token = lambda c: F.concat(F.lit(f"{level}:"), c.cast("long").cast("string"))  # noqa: B023, E731
        cells += [F.when((a <= b) & alone(a), token(a)), F.when((a < b) & alone(b), token(b))]
    return F.array_compact(F.array(*cells))


def fits(rows: DataFrame, values: dict[str, Column], numbers: dict[str, Column], conditions: DataFrame, filters: DataFrame) -> DataFrame:
    """filter and all columns of rows for each filter of filters(filter) that fits a row.

    values are arrays of strings by field, numbers doubles by field. Each filter is looked up by that of its conditions
    which the fewest rows meet, by counts of values and by the share of a number's range; a row offers its values, and
    for a number the halves of halves of the range in which it lies. What meets is checked against all conditions.
    """
    names = rows.columns
    texts = [x for f, c in values.items() for x in (F.lit(f), c)]
    doubles = [x for f, c in numbers.items() for x in (F.lit(f), c.cast("double"))]
    empty = F.create_map().cast("map<string,array<string>>"), F.create_map().cast("map<string,double>")
    made = rows.withColumns({"_texts": F.create_map(*texts) if texts else empty[0], "_numbers": F.create_map(*doubles) if doubles else empty[1]})
    real = conditions.filter(~((F.col("kind") == "any") & (F.coalesce(F.size("any"), F.lit(0)) <= 0)))

    # how many rows each condition lets through, about
    often = made.select(F.explode("_texts").alias("field", "list")).select("field", F.explode(F.array_distinct("list")).alias("value")).groupBy("field", "value").agg(F.count("*").alias("n"))
    spans = made.select(F.explode("_numbers").alias("field", "x")).groupBy("field").agg(F.min("x").alias("least"), F.max("x").alias("most"), F.count("x").alias("n"))
    by_list = real.filter("kind != 'range'").select("filter", "field", "kind", "any", F.explode_outer(F.array_distinct("any")).alias("value")).join(often, ["field", "value"], "left")
    by_list = by_list.groupBy("filter", "field").agg(F.sum(F.coalesce("n", F.lit(0))).cast("double").alias("cost"), F.first("any").alias("any"))
    by_list = by_list.select("filter", "cost", "field", F.array_distinct("any").alias("tokens"))
    place = lambda x: F.least(F.greatest(F.floor((x - F.col("least")) / F.greatest(F.col("most") - F.col("least"), F.lit(1e-300)) * (1 << LEVELS)), F.lit(0)), F.lit((1 << LEVELS) - 1))
    by_range = real.filter("kind = 'range'").join(F.broadcast(spans), "field")  # a row a field
    ends = by_range.select("filter", "field", "n", place(F.coalesce("low", "least")).alias("a"), place(F.coalesce("high", "most")).alias("b"), (F.coalesce("low", "least") > F.coalesce("high", "most")).alias("never"))
    by_range = ends.select("filter", ((F.col("b") - F.col("a") + 1) / float(1 << LEVELS) * F.col("n")).alias("cost"), "field", F.when(F.col("never"), F.array().cast("array<string>")).otherwise(_cover(F.col("a"), F.col("b"))).alias("tokens"))
    way = by_list.union(by_range).groupBy("filter").agg(F.min(F.struct("cost", "field", "tokens")).alias("way"))
    all_of = real.groupBy("filter").agg(F.collect_list(F.struct("field", "kind", "any", "low", "high")).alias("_all"))  # its fields at most
    index = way.join(all_of, "filter").select("filter", "_all", F.col("way.field").alias("_field"), F.explode("way.tokens").alias("_token"))

    lists = F.transform(F.map_entries("_texts"), lambda e: F.transform(F.array_distinct(e["value"]), lambda v: F.struct(e["key"].alias("f"), v.alias("t"))))
    span = F.broadcast(spans.agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("least", "most")))).alias("_spans")))  # one row
    at = lambda e: F.least(F.greatest(F.floor((e["value"] - F.get(F.array(F.col("_spans")[e["key"]]), F.lit(0))["least"]) / F.greatest(F.col("_spans")[e["key"]]["most"] - F.col("_spans")[e["key"]]["least"], F.lit(1e-300)) * (1 << LEVELS)), F.lit(0)), F.lit((1 << LEVELS) - 1))
    halves = F.transform(F.filter(F.map_entries("_numbers"), lambda e: e["value"].isNotNull()), lambda e: F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(e["key"].alias("f"), F.concat(k.cast("string"), F.lit(":"), F.floor(at(e) / F.pow(F.lit(2.0), k)).cast("long").cast("string")).alias("t"))))
    offered = made.crossJoin(span).select(*names, "_texts", "_numbers", F.explode(F.flatten(F.concat(lists, halves))).alias("_o"))
    met = offered.join(index, (F.col("_o.f") == F.col("_field")) & (F.col("_o.t") == F.col("_token")))

    def holds(c: Column) -> Column:
        x, v = F.col("_numbers")[c["field"]], F.col("_texts")[c["field"]]
        number = x.isNotNull() & F.coalesce(x >= c["low"], F.lit(True)) & F.coalesce(x <= c["high"], F.lit(True))
        return F.coalesce(F.when(c["kind"] == "range", number).otherwise(F.arrays_overlap(v, c["any"])), F.lit(False))

    # a row that offers several values of one list is taken once, by the first of them
    first = F.array_min(F.array_intersect(F.col("_texts")[F.col("_field")], F.get(F.filter("_all", lambda c: c["field"] == F.col("_field")), F.lit(0))["any"]))
    once = F.coalesce(first == F.col("_token"), F.lit(True))
    found = met.filter(once & F.forall("_all", holds)).select("filter", *names)
    free = filters.select("filter").join(real.select("filter").distinct(), "filter", "left_anti")
    return found.union(free.crossJoin(rows).select("filter", *names))


#: Numbers are folded between the bounds of ranges if a field has no more bounds than this; else by equal values.
MOST_BOUNDS = 1_000


def alike(conditions: DataFrame, filters: DataFrame) -> DataFrame:
    """(filter, class): filters(filter) with the same conditions have one class, the smallest of them."""
    parts = F.array_sort(F.collect_list(F.struct("field", "kind", F.array_sort("any").alias("any"), "low", "high")))  # its fields at most
    own = filters.select("filter").join(conditions.groupBy("filter").agg(parts.alias("parts")), "filter", "left")
    lists = own.select("filter", F.coalesce(F.to_json("parts"), F.lit("")).alias("parts"))
    return lists.join(lists.groupBy("parts").agg(F.min("filter").alias("class")), "parts").select("filter", "class")


def _between(x: Column, bounds: list[float], below: int = 0) -> Column:
    """Twice the number of ascending bounds below x, and one more if x is the next of them: a search by halves in plain conditions."""
    if not bounds:
        return F.lit(2 * below)
    half = len(bounds) // 2
    at = F.lit(bounds[half])
    return F.when(x < at, _between(x, bounds[:half], below)).when(x == at, F.lit(2 * (below + half) + 1)).otherwise(_between(x, bounds[half + 1 :], below + half + 1))


def folded(rows: DataFrame, values: list[str], number: str, field: str, conditions: DataFrame) -> DataFrame:
    """rows that no filter can tell apart as one: values, number (one of theirs), n and the sum of the number.

    values are names of columns, number that of a column of doubles, which conditions know as `field`. Numbers that lie
    between the same two neighbouring bounds of all ranges fit the same ranges; a number that is a bound stands alone.
    """
    ranges = conditions.filter((F.col("kind") == "range") & (F.col("field") == field))
    bounds = ranges.select(F.explode(F.array("low", "high")).alias("b")).filter("b is not null").distinct().limit(MOST_BOUNDS + 1)
    found = sorted(r.b for r in bounds.collect())
    place = F.col(number)
    if len(found) <= MOST_BOUNDS:
        place = _between(F.col(number), found).cast("double")
    return rows.groupBy(*values, F.when(F.col(number).isNotNull(), place).alias("_place")).agg(F.count("*").alias("n"), F.sum(number).alias("sum"), F.min(number).alias(number)).drop("_place")
