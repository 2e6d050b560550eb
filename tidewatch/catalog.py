"""Every query of the library by name, with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import aggregates, behaviour, clusters, cycles, detectors, feeds, measures, models, outcomes, predictions, relations, sequences, tagging

#: Modules with queries; each has QUERIES and ORACLE_SQL.
MODULES = (aggregates, sequences, relations, detectors, behaviour, measures, outcomes, models, clusters, tagging, cycles, predictions, feeds)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
