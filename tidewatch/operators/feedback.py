"""Thresholds that rules move from day to day, within limits and with a rest after each move."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame


class Rule(NamedTuple):
    """When a metric's z reaches `trigger` (from above if that is negative) the threshold moves by `percent`; it stays
    between low and high per cent of its first value away from that, and the rule rests for `rest` days."""

    name: str
    metric: str
    trigger: float
    percent: float
    low: float
    high: float
    rest: int


def moves(days: DataFrame, key: str, first: float, rules: list[Rule]) -> DataFrame:
    """(key, day, rule, before, after): each move of a key's threshold, rules in their order on days in theirs.

    days(key, day, metrics...) has a row a day, in which a metric may be null; a key's days are one group, which is
    as long as the calendar and no longer.
    """
    metrics = sorted({r.metric for r in rules})

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        value, last, out = first, {}, []
        for row in group.sort_values("day").itertuples(index=False):
            for rule in rules:
                z, day = getattr(row, rule.metric), int(row.day)
                fires = not pd.isna(z) and (z >= rule.trigger if rule.trigger >= 0 else z <= rule.trigger)
                if not fires or day - last.get(rule.name, day - rule.rest) < rule.rest:
                    continue
                after = min(max(value * (1 + rule.percent / 100), first * (1 + rule.low / 100)), first * (1 + rule.high / 100))
                if after != value:
                    out.append((getattr(row, key), day, rule.name, value, after))
                    value, last[rule.name] = after, day
        return pd.DataFrame(out, columns=[key, "day", "rule", "before", "after"])

    kind = days.schema[key].dataType.simpleString()
    return days.select(key, "day", *metrics).groupBy(key).applyInPandas(fold, f"{key} {kind}, day long, rule string, before double, after double")
