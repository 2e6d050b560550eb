"""A quality classifier: a sparse rule ensemble over text statistics, compiled into Spark columns.

Shallow trees are grown on labelled rows; every path from a root to a node is a conjunctive rule. A logistic regression
with a lasso penalty then weighs the rules and drops most of them. What is left is a short list of rules, which becomes
one column expression.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, let, sampled, saved, text_or_empty

#: Labelled rows that may train the rules, by the smallest hashes; trees, their depth, the lasso's weight.
MOST_ROWS, TREES, DEPTH, LASSO, SEED = 20_000, 20, 3, 0.002, 7
Condition = tuple[str, str, float]


@dataclass(frozen=True)
class Rules:
    """log-odds = bias + the sum of the weights of the rules that hold; a rule is a conjunction of conditions."""

    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def to_json(self) -> str:
        return json.dumps({"bias": self.bias, "rules": [[[list(c) for c in cs], w] for cs, w in self.rules]})

    @classmethod
    def from_json(cls, text: str) -> Rules:
        x = json.loads(text)
        return cls(x["bias"], tuple((tuple((a, b, float(c)) for a, b, c in cs), float(w)) for cs, w in x["rules"]))


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, 0 where there is nothing to count."""
    t = text_or_empty(text)
    n_chars = F.greatest(F.length(t), F.lit(1))
    words = F.array_remove(F.split(t, GAP), "")
    n_words = F.greatest(F.size(words), F.lit(1))
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    count = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    distinct = let(words, lambda w: F.size(F.array_distinct(w)))
    return {
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_chars": F.length(F.regexp_replace(t, GAP, "")) / n_words,
        "symbols": count(r"[#*$%&|<>@^~_{}\\\[\]=+]") / n_chars,
        "marks": count(r"[!?]") / n_chars,
        "stops": count(r"[.,;:]") / n_chars,
        "digits": count(r"[0-9]") / n_chars,
        "capitals": count(r"\p{Lu}") / n_chars,
        "other": count(r"[\p{L}\s.,]") / n_chars,
        "distinct": distinct / n_words,
        "line_words": F.size(words) / F.greatest(F.size(lines), F.lit(1)),
        "repeated_lines": (F.size(lines) - let(lines, lambda x: F.size(F.array_distinct(x)))) / F.greatest(F.size(lines), F.lit(1)),
    }


STATISTICS = ("log_words", "word_chars", "symbols", "marks", "stops", "digits", "capitals", "other", "distinct", "line_words", "repeated_lines")


def holds(conditions: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for name, sign, bound in conditions:
        out = out & (F.col(name) <= bound if sign == "<=" else F.col(name) > bound)
    return out


def paths(model) -> set[tuple[Condition, ...]]:
    """Every path of a forest model from a root to a node below it, with one bound a statistic and direction."""
    found: set[tuple[Condition, ...]] = set()

    def walk(node, so_far: dict[tuple[str, str], float]) -> None:
        if so_far:
            found.add(tuple((n, s, b) for (n, s), b in sorted(so_far.items())))
        if node.numDescendants() == 0:
            return
        split = node.split()
        name, bound = STATISTICS[split.featureIndex()], round(float(split.threshold()), 6)
        for sign, child, pick in (("<=", node.leftChild(), min), (">", node.rightChild(), max)):
            walk(child, so_far | {(name, sign): pick(bound, so_far.get((name, sign), bound))})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return found


def trained(docs: DataFrame, known: DataFrame, most_rows: int = MOST_ROWS) -> Rules:
    """Rules from docs(doc_id, text) and known(doc_id, quality) with quality 0 or 1; other rows are left out.

    At most `most_rows` labels train, those with the smallest hashes of their doc_id, each class weighing the same; their
    ids are broadcast to the documents, so that no text is shuffled. With one class only, or none, there are no rules
    and the score is near that class, or one half.
    """
    known = known.filter("quality in (0, 1)").select("doc_id", F.col("quality").cast("double").alias("label"))
    few = F.broadcast(saved(sampled(known, most_rows), "chosen"))  # most_rows rows of two numbers
    rows = docs.join(few, "doc_id")
    rows = saved(rows.select("label", *[c.alias(n) for n, c in statistics(F.col("text")).items()]), "training")
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(n) < 2:
        return Rules(0.0 if not n else (4.0 if 1.0 in n else -4.0), ())
    weight = F.when(F.col("label") == 1, sum(n.values()) / (2 * n[1.0])).otherwise(sum(n.values()) / (2 * n[0.0]))
    ready = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows.coalesce(2).withColumn("w", weight))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, weightCol="w", subsamplingRate=1.0, featureSubsetStrategy="onethird").fit(ready)
    found = sorted(paths(forest))
    flags = rows.coalesce(2).select("label", weight.alias("w"), F.array(*[holds(p).cast("double") for p in found]).alias("flags"))
    from pyspark.ml.functions import array_to_vector

    fitted = LogisticRegression(featuresCol="rules", weightCol="w", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=100).fit(flags.select("label", "w", array_to_vector("flags").alias("rules")))
    return Rules(float(fitted.intercept), tuple((p, float(c)) for p, c in zip(found, fitted.coefficients.toArray().tolist(), strict=True) if c))


def score_column(rules: Rules) -> Column:
    """The score from columns named as the statistics: the logistic function of the summed weights."""
    total = F.lit(rules.bias)
    for conditions, weight in rules.rules:
        total = total + F.when(holds(conditions), weight).otherwise(0.0)
    return F.round(1 / (1 + F.exp(-total)), 9)


def scored(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id and score, 0 to 1, of every row of docs(doc_id, text); other columns are ignored.

    A null or empty text has zero statistics and its score; null doc_ids and repeated rows each get their row; an empty
    table gives none.
    """
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.cast("double").alias(n) for n, c in statistics(F.col("text")).items()])
    return counted.select("doc_id", score_column(rules).alias("score"))


def held_out(doc_id: Column) -> Column:
    """Whether a document never trains: CRC-32 of its doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs, by rules learned from the labels not held out.

    Labels that are not 0 or 1 and labels without a document are left out; a null doc_id is never held out nor trains.
    """
    known = labels.filter(~held_out(F.col("doc_id"))).filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rules = trained(docs.select("doc_id", "text"), known, most_rows)
    return scored(docs, rules).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
