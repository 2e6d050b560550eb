"""Predictions from weighted features: scores that leave out what is missing, their calibration, and what decided them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Feature(NamedTuple):
    """A feature from 0 to 1, its weight, whether more of it counts for the score, and from where on it stands out."""

    name: str
    weight: float
    more: bool
    stands_out: float


def platt(score: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(a * score + b))


def tempered(score: Column, temperature: float) -> Column:
    """The score with its logit divided by a temperature."""
    return 1 / (1 + F.exp(-F.ln(score / (1 - score + 1e-10)) / temperature))


def judged(rows: DataFrame, key: str, features: list[Feature]) -> DataFrame:
    """key, raw, confidence, standing_out and factors of rows(key, a column a feature).

    raw is the weighted mean of the features that are there, 0.5 if there are none; confidence the mean of the shares of
    features and of weight that are there; standing_out counts features that reach their mark; factors are the names by
    contribution, the largest first, of equal ones by name.
    """
    value = {f.name: F.col(f.name) if f.more else 1 - F.col(f.name) for f in features}
    there = lambda f: F.col(f.name).isNotNull()
    total = sum((F.when(there(f), f.weight).otherwise(0.0) for f in features), F.lit(0.0))
    points = sum((F.when(there(f), value[f.name] * f.weight).otherwise(0.0) for f in features), F.lit(0.0))
    n = sum((there(f).cast("int") for f in features), F.lit(0))
    out = sum((F.coalesce(value[f.name] >= f.stands_out, F.lit(False)).cast("int") for f in features), F.lit(0))
    each = F.array_compact(F.array(*[F.when(there(f), F.struct((-F.round(value[f.name] * f.weight, 9)).alias("minus"), F.lit(f.name).alias("name"))) for f in features]))
    confidence = (n / len(features) + total / sum(f.weight for f in features)) / 2
    return rows.select(key, F.when(total > 0, points / total).otherwise(0.5).alias("raw"), confidence.alias("confidence"), out.alias("standing_out"), F.transform(F.array_sort(each), lambda x: x["name"]).alias("factors"))


def outcome_probability(features: dict[str, tuple[Column, float]], prior: Column, bias: float, temperature: float) -> Column:
    """The logistic function of bias, weighted features and the logit of a prior, over a temperature."""
    total = sum((c * w for c, w in features.values()), F.lit(bias))
    return 1 / (1 + F.exp(-(total + F.ln(prior / (1 - prior + 1e-10))) / temperature))
