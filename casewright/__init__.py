"""casewright: support-case analytics as Spark DataFrame jobs.

Sub-packages
------------
sources    table scans, derived fixture views, sinks
functions  column-expression helpers (text, vectors, numbers)
operators  the batch operators (corpus ETL, graph roots, quality checks,
           kNN retrieval, rule policy, metrics, replies, judge, models)
plans      the query registry and the DuckDB oracle SQL
streaming  Structured Streaming assist and running statistics
"""

__all__ = ["session"]
