"""Registry of named queries: ``name -> (spark, sf_dir) -> DataFrame`` plus
the matching DuckDB oracle SQL (absent for non-SQL operators)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
OPS: dict[str, str] = {}


def query(name: str, ops: str, sql: str | None = None):
    """Register a query function under ``name`` with its operator ids."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        OPS[name] = ops
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


MODULES = ["corpus_queries", "quality_queries", "vector_queries", "policy_queries", "metric_queries",
           "reply_queries", "model_queries", "stream_queries", "assist_queries"]


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    import importlib.util
    for m in MODULES:
        name = f"casewright.plans.{m}"
        if importlib.util.find_spec(name) is not None:
            importlib.import_module(name)
