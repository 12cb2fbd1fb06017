"""All queries of the engine and the SQL that DuckDB answers them with.

Each module of ``quarry.plans`` holds a group of queries: QUERIES maps names to
functions of (spark, sf_dir), SQL the names that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import chunks, evaluation, primitives, search, storage, synthetic

GROUPS = (primitives, chunks, search, evaluation, synthetic, storage)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for group in GROUPS for name, f in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.SQL.items()}
