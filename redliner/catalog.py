"""Registry of the engine's queries and of the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from redliner.queries import compare, documents, grounding, reports, search

AREAS = [compare, search, reports, documents, grounding]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: duty shifts of all changed clauses of all contracts."""
    return compare.deontic_shift(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for area in AREAS for name, f in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.SQL.items()}
