"""Queries of the training-data operators: ``name -> (spark, sf_dir) -> DataFrame`` and their DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

MODULES = ["toxicity", "quality", "language", "bpe", "token_counts", "exact_dedup", "warc", "license_scan", "near_dedup", "decontaminate",
           "hard_negatives", "line_dedup", "collocations"]


def query(name: str, sql: str | None = None):
    """Register a query function, with its oracle where SQL can express it."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"casewright.llm.{m}")
