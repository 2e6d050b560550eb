"""Queries by dictionaries of phrases and by stored filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as t
from ..functions import stats
from ..operators import graph, phrases, predicates
from .dictionaries import ADVANTAGES, BASE, CATEGORIES, OTHER, patterns

r = stats.rounded
LEAST_CATEGORY = 25
ALERT_USD = 60_000
KINDS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
_PATTERN = "tag string, phrase string, weight double, context array<string>, never array<string>"


def _categories(spark, sf):
    """(market, category, score, n): the category with the highest score, of equal ones the first; "other" below 25."""
    m = t.markets(spark, sf).select("market", "title")
    tags = phrases.tagged(m, "market", "title", spark.createDataFrame(patterns(CATEGORIES), _PATTERN))
    best = tags.filter(F.col("score") >= LEAST_CATEGORY).groupBy("market").agg(F.min(F.struct((-F.col("score")).alias("minus"), "tag", "n")).alias("x"))
    return m.join(best, "market", "left").select("market", "title", F.coalesce("x.tag", F.lit("other")).alias("category"), F.coalesce(-F.col("x.minus"), F.lit(0.0)).alias("score"), F.coalesce("x.n", F.lit(0)).cast("long").alias("n"))


def txt_market_categories(spark, sf):
    """Markets by the category whose phrases weigh most in their titles."""
    return _categories(spark, sf).drop("title")


def txt_information_advantage(spark, sf):
    """How much some may know of a market before others: points of its category, of telling phrases and of signs of it,
    and a fifth of the category's own score, 100 at most."""
    c = _categories(spark, sf)
    found = phrases.tagged(c, "market", "title", spark.createDataFrame(patterns(ADVANTAGES), _PATTERN))
    by = found.groupBy(F.col("market").alias("_m")).agg(*[F.sum(F.when(F.col("tag") == k, F.col("score"))).alias(k) for k in ADVANTAGES])
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv])[F.col("category")], F.lit(OTHER))
    points = {k: F.coalesce(k, F.lit(0.0)) for k in ADVANTAGES}
    score = F.least(stats.half_up(base + sum(points.values()) + F.col("score") * 0.2 + 1e-9), F.lit(100)).cast("int")
    out = c.join(by, F.col("market") == F.col("_m"), "left").select("market", "category", *[p.alias(k) for k, p in points.items()], score.alias("advantage"))
    return out.withColumn("level", stats.ladder(F.col("advantage"), [(75, "very_high"), (50, "high"), (30, "medium"), (15, "low")], "very_low"))


def _item_patterns(spark, sf):
    """Two patterns an item of the benchmark with eight words or more: its first three words, and the next three if the
    two after those are there too and the first two of the next item aren't."""
    items = t.table(spark, sf, "benchmark").select("item_id", phrases.spelled(F.col("text")).alias("w")).filter(F.size("w") >= 8)
    join = lambda c, a, n: F.array_join(F.slice(c, a, n), " ")
    following = items.select((F.col("item_id") - 1).alias("item_id"), join("w", 1, 2).alias("next"))
    both = items.join(following, "item_id", "left")
    none = F.array().cast("array<string>")
    first = F.struct(join("w", 1, 3).alias("phrase"), F.lit(40.0).alias("weight"), none.alias("context"), none.alias("never"))
    second = F.struct(join("w", 4, 3).alias("phrase"), F.lit(30.0).alias("weight"), F.array(join("w", 7, 2)).alias("context"), F.array_compact(F.array("next")).alias("never"))
    return both.select(F.concat(F.lit("set-"), (F.col("item_id") % 4).cast("string")).alias("tag"), F.inline(F.array(first, second)))


def txt_phrase_tags(spark, sf):
    """Documents by sets of benchmark items whose phrases they have, with context and exclusions."""
    out = phrases.tagged(t.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", _item_patterns(spark, sf))
    return out.select("doc_id", "tag", "score", "n")


def _conditions(spark, sf):
    """The filters that wallets have stored, by their ids: a side, kinds of market, words of a title, a range of values."""
    w, title = t.wallets(spark, sf).select("wallet"), t.markets(spark, sf).select(F.col("market").alias("wallet"), "title")
    at = w.join(title, "wallet", "left")
    pick = F.array(*[F.lit(k) for k in KINDS])
    kinds = F.array_distinct(F.array(F.get(pick, (F.col("wallet") % 6).cast("int")), F.get(pick, (F.floor(F.col("wallet") / 6) % 6).cast("int"))))
    low = (ALERT_USD + F.col("wallet") % 6 * 5000).cast("double")
    high = F.when(F.col("wallet") % 4 != 0, low + F.col("wallet") % 4 * 9000)
    empty = F.array().cast("array<string>")
    words = F.when(F.col("wallet") % 7 == 0, empty).otherwise(F.split("title", " "))
    row = lambda field, kind, any_of, a=None, b=None: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), (any_of if any_of is not None else F.lit(None).cast("array<string>")).alias("any"), (a if a is not None else F.lit(None).cast("double")).alias("low"), (b if b is not None else F.lit(None).cast("double")).alias("high"))
    side = F.when(F.col("wallet") % 3 == 0, F.array(F.lit("BUY"))).otherwise(F.array(F.lit("SELL")))
    every = F.array_compact(F.array(
        F.when(F.col("wallet") % 3 != 2, row("side", "flag", side)), F.when(F.col("wallet") % 5 != 0, row("kind", "one", kinds)),
        F.when(F.col("title").isNotNull(), row("word", "any", words)), row("usd", "range", None, low, high),
    ))
    return at.select(F.col("wallet").alias("filter"), F.inline(every))


def _alerts(spark, sf):
    m = t.markets(spark, sf).select("market", "category", F.split("title", " ").alias("words"))
    return t.fills(spark, sf).filter(F.col("usd") >= ALERT_USD).join(m, "market").select("side", "category", "words", "usd")


def _matched(alerts, conditions, filters):
    """Filters alike are looked up once, and so are alerts that none of them tells apart: no pair of a filter and an alert is made."""
    graph.shared_checkpoints(alerts.sparkSession)
    conditions = conditions.checkpoint()
    same = predicates.alike(conditions, filters).checkpoint()
    classes = same.filter("filter = class").select("filter")
    few = predicates.folded(alerts.withColumn("words", F.array_sort("words")), ["side", "category", "words"], "usd", "usd", conditions).checkpoint()
    found = predicates.fits(few, {"side": F.array("side"), "kind": F.array("category"), "word": F.col("words")}, {"usd": F.col("usd")}, conditions.join(classes, "filter", "left_semi"), classes)
    sums = found.groupBy(F.col("filter").alias("class")).agg(F.sum("n").alias("n"), r(F.sum("sum"), 2).alias("usd"))
    return same.join(sums, "class").select("filter", "n", "usd")


def set_standing_filters(spark, sf):
    """Alerts that fit each wallet's stored filter: how many, and their value."""
    filters = t.wallets(spark, sf).select(F.col("wallet").alias("filter"))
    return _matched(_alerts(spark, sf), _conditions(spark, sf), filters).select(F.col("filter").alias("wallet"), "n", "usd")


def set_merged_filters(spark, sf):
    """Alerts that fit the filters of two neighbouring wallets at once."""
    groups = t.wallets(spark, sf).select(F.floor(F.col("wallet") / 2).alias("group"), F.col("wallet").alias("filter"))
    graph.shared_checkpoints(spark)
    both = predicates.merged(_conditions(spark, sf).checkpoint(), groups)
    return _matched(_alerts(spark, sf), both, groups.select(F.col("group").alias("filter")).distinct()).select(F.col("filter").alias("pair"), "n", "usd")


QUERIES = {f.__name__: f for f in (txt_market_categories, txt_information_advantage, txt_phrase_tags, set_standing_filters, set_merged_filters)}


def _values(name: str, rows: list[tuple]) -> str:
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]::VARCHAR[]"
    return f"{name}(tag, phrase, weight, context, never) AS (VALUES " + ", ".join(f"('{tag}', '{phrase}', {weight}::DOUBLE, {listed(context)}, {listed(never)})" for tag, phrase, weight, context, never in rows) + ")"


_SPELLED = lambda c: f"' ' || array_to_string(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' '"
_HAS = lambda x: f"contains(s, ' ' || {x} || ' ')"
_ALLOWED = f"{_HAS('phrase')} AND (len(context) = 0 OR len(list_filter(context, lambda x: {_HAS('x')})) > 0) AND len(list_filter(never, lambda x: {_HAS('x')})) = 0"
_CATEGORIES = f"""{_values("p", patterns(CATEGORIES))}, m AS (SELECT market, {_SPELLED("title")} AS s FROM markets),
k AS (SELECT market, tag, least(sum(weight), 100) AS score, count(*) AS n FROM m JOIN p ON {_ALLOWED} GROUP BY ALL HAVING sum(weight) >= {LEAST_CATEGORY}),
b AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY score DESC, tag) AS i FROM k),
c AS (SELECT market, s, coalesce(tag, 'other') AS category, coalesce(score, 0) AS score, coalesce(n, 0) AS n FROM m LEFT JOIN (SELECT * FROM b WHERE i = 1) USING (market))"""
_KINDS = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_FILTERS = f"""a AS (SELECT f.side, f.usd, m.category, string_split(m.title, ' ') AS words FROM fills f JOIN markets m USING (market) WHERE usd >= {ALERT_USD}),
w AS (SELECT wallet, CASE wallet % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' END AS side, CASE WHEN wallet % 5 != 0 THEN list_distinct([{_KINDS}[wallet % 6 + 1], {_KINDS}[wallet // 6 % 6 + 1]]) END AS kinds,
    CASE WHEN title IS NOT NULL THEN CASE WHEN wallet % 7 = 0 THEN []::VARCHAR[] ELSE string_split(title, ' ') END END AS words, {ALERT_USD} + wallet % 6 * 5000 AS low, CASE WHEN wallet % 4 != 0 THEN {ALERT_USD} + wallet % 6 * 5000 + wallet % 4 * 9000 END AS high
    FROM wallets LEFT JOIN (SELECT market AS wallet, title FROM markets) USING (wallet))"""
_FITS = "(w.side IS NULL OR w.side = a.side) AND (w.kinds IS NULL OR list_contains(w.kinds, a.category)) AND (w.words IS NULL OR len(w.words) = 0 OR list_has_any(w.words, a.words)) AND a.usd >= w.low AND (w.high IS NULL OR a.usd <= w.high)"
_JOINED = lambda x, f: f"CASE WHEN x.{x} IS NULL THEN y.{x} WHEN y.{x} IS NULL THEN x.{x} ELSE {f} END AS {x}"

ORACLE_SQL = {
    "txt_market_categories": t.sql("markets", f",{_CATEGORIES} SELECT market, category, score, n FROM c"),
    "txt_information_advantage": t.sql(
        "markets",
        f""",{_CATEGORIES}, {_values("q", patterns(ADVANTAGES))},
        e AS (SELECT market, tag, least(sum(weight), 100) AS points FROM c JOIN q ON {_ALLOWED} GROUP BY ALL),
        g AS (SELECT c.*, coalesce((SELECT points FROM e WHERE e.market = c.market AND tag = 'keyword'), 0) AS keyword, coalesce((SELECT points FROM e WHERE e.market = c.market AND tag = 'asymmetry'), 0) AS asymmetry FROM c),
        h AS (SELECT *, least(floor(CASE category {" ".join(f"WHEN '{k}' THEN {v}" for k, v in BASE.items())} ELSE {OTHER} END + keyword + asymmetry + score * 0.2 + 1e-9 + 0.5), 100)::INT AS advantage FROM g)
        SELECT market, category, keyword, asymmetry, advantage, CASE WHEN advantage >= 75 THEN 'very_high' WHEN advantage >= 50 THEN 'high' WHEN advantage >= 30 THEN 'medium' WHEN advantage >= 15 THEN 'low' ELSE 'very_low' END AS level FROM h""",
    ),
    "txt_phrase_tags": f"""WITH i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark), j AS (SELECT * FROM i WHERE len(w) >= 8),
        p AS (SELECT 'set-' || j.item_id % 4 AS tag, array_to_string(j.w[1:3], ' ') AS phrase, 40.0 AS weight, []::VARCHAR[] AS context, []::VARCHAR[] AS never FROM j
            UNION ALL SELECT 'set-' || j.item_id % 4, array_to_string(j.w[4:6], ' '), 30.0, [array_to_string(j.w[7:8], ' ')], CASE WHEN k.w IS NULL THEN []::VARCHAR[] ELSE [array_to_string(k.w[1:2], ' ')] END FROM j LEFT JOIN j k ON k.item_id = j.item_id + 1),
        d AS (SELECT doc_id, {_SPELLED("text")} AS s FROM documents)
        SELECT doc_id, tag, least(sum(weight), 100)::DOUBLE AS score, count(*) AS n FROM d JOIN p ON {_ALLOWED} GROUP BY ALL""",
    "set_standing_filters": t.sql("fills markets wallets", f",{_FILTERS} SELECT w.wallet, count(*) AS n, round(sum(a.usd), 2) AS usd FROM w JOIN a ON {_FITS} GROUP BY w.wallet"),
    "set_merged_filters": t.sql(
        "fills markets wallets",
        f""",{_FILTERS.replace("w AS (SELECT", "v AS (SELECT")},
        w AS (SELECT coalesce(x.wallet, y.wallet) // 2 AS pair, coalesce(y.side, x.side) AS side, {_JOINED("kinds", "list_intersect(x.kinds, y.kinds)")}, {_JOINED("words", "list_intersect(x.words, y.words)")},
            coalesce(greatest(x.low, y.low), x.low, y.low) AS low, least(coalesce(x.high, y.high), coalesce(y.high, x.high)) AS high
            FROM (SELECT * FROM v WHERE wallet % 2 = 0) x FULL JOIN (SELECT * FROM v WHERE wallet % 2 = 1) y ON y.wallet = x.wallet + 1)
        SELECT pair, count(*) AS n, round(sum(a.usd), 2) AS usd FROM w JOIN a ON {_FITS} GROUP BY pair""",
    ),
}
