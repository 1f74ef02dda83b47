"""Readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TWEET_SCHEMA = ("tweet_id long, author_id string, inbound boolean, created_at string, text string, "
                "response_tweet_id string, in_response_to_tweet_id long")
GOLDEN_SCHEMA = "tweet_id long, text string, intent string, notes string"
CASE_SCHEMA = ("case_id string, customer_tweet_id long, support_tweet_id string, customer_text string, "
               "support_text string, created_at string, intent string, conversation_id long, "
               "customer_author_id string")
DOC_CASE_SCHEMA = "customer_tweet_id long, customer_text string, support_text string"

# Quoted texts may hold line ends, so a CSV file is read by one task: write many files, and turn
# raw CSV into Parquet as the first step of a large job.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}


def read_tweets_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw tweets CSV with quoted multi-line text, explicit schema."""
    return spark.read.schema(TWEET_SCHEMA).options(**CSV_OPTIONS).csv(path)


def read_golden_csv(spark: SparkSession, path: str) -> DataFrame:
    """Golden set."""
    return spark.read.schema(GOLDEN_SCHEMA).options(**CSV_OPTIONS).csv(path)


def read_cases_csv(spark: SparkSession, path: str, schema: str = CASE_SCHEMA) -> DataFrame:
    """Any review/case table written by ``write_cases``."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def write_cases(df: DataFrame, parquet_path: str, csv_path: str | None = None) -> None:
    """Corpus as Parquet (primary) and optionally CSV."""
    df.write.mode("overwrite").parquet(parquet_path)
    if csv_path:
        df.write.mode("overwrite").options(**CSV_OPTIONS).csv(csv_path)


def write_csv(df: DataFrame, path: str) -> None:
    """A table as quoted multi-line CSV, one file per partition."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_metrics_csv(df: DataFrame, path: str) -> None:
    """Small metric tables as one CSV file (they are one row per metric/class)."""
    df.coalesce(1).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_json_report(report: DataFrame, path: str) -> None:
    """Nested report rows as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)


def assert_same_count(a: DataFrame, b: DataFrame) -> None:
    na, nb = a.count(), b.count()
    if na != nb:
        raise ValueError(f"round trip changed the row count: {na} != {nb}")
