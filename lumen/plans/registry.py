"""Registry of named queries: each is ``fn(spark, sf_dir) -> DataFrame`` plus, where the
result is expressible in SQL, an equivalent DuckDB statement over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    # importing the modules fills the registry
    from lumen.plans import (  # noqa: F401
        q_finance,
        q_profile,
        q_combine,
        q_model,
        q_neighbours,
        q_rules,
        q_runlog,
        q_sources,
        q_streaming,
        q_trees,
    )
