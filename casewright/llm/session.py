"""Settings and folders that every operator of this subpackage needs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from casewright.session import ensure_checkpoint_dir

#: Bytes of one Arrow batch handed to a Python worker, so that long texts do not pile up in it.
ARROW_BATCH_BYTES = "16m"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by bytes and make sure that a checkpoint folder is set."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)
    ensure_checkpoint_dir(spark)
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return df.select(*columns) if columns else df
