"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import benefits, documents, exchange, extras, more, operations, reviews

_ALL = benefits.QUERIES | documents.QUERIES | operations.QUERIES | reviews.QUERIES | extras.QUERIES | more.QUERIES | exchange.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    """SQL of those queries that SQL can express."""
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
