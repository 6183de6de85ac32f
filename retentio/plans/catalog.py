"""Registry of named queries: Spark plan + independent DuckDB oracle SQL.

Every query reads the given tables (through the subscriber / score / log
derivations) so its work grows with the data. Floating outputs are rounded
to 6 decimals in both engines (sums differ in the last bit across engines).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import (  # noqa: F401
        q_reports, q_quality, q_features, q_eval, q_models, q_stream, q_io, q_jobs, q_sources,
    )
