"""The registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.plans import documents, layout, operations, outlines, rewriting, rules

PARTS = [operations, documents, rules, outlines, rewriting, layout]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to function of (spark, sf_dir)."""
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to SQL, for the queries that SQL can express."""
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
