"""Registry of the engine's own queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from irloom.plans import engine_queries, ir_queries, program_queries, triage_queries  # noqa: F401  the others add to the first

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_queries.QUERIES["unreleased_at_boundary"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(engine_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(engine_queries.SQL)
