"""Shared plan helpers: size-checked broadcast, reliable checkpoints."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.session import ensure_checkpoint_dir, scratch_dir

# Default row bound for sides we are willing to broadcast by hint.
BROADCAST_MAX_ROWS = 2_000_000
#: Parquet files of rows that may be long: bytes of a row group, and after how many rows first a page's and a group's size are looked at.
LONG_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "10", "parquet.block.size.row.check.min": "10"}


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only if it provably holds at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows (``limit`` stops early).
    Beyond the bound the frame is returned unhinted and AQE chooses the
    join strategy from runtime statistics (sort-merge for big sides).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes too: ten thousand whole texts are too many for a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in spark.checkpoint.dir."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Free memory of this Python worker goes back to the system: a worker waits for its next task beside the executor's
    heap, and its allocators would keep what their largest block took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by compressed Parquet in a fresh folder under spark.checkpoint.dir.

    A writer holds one row group, and a reader at most that of each column, so that long rows take no more memory than short ones."""
    path = scratch_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.options(**LONG_ROWS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def safe_ratio(num, den):
    """Undefined ratio -> 0.0 (``zero_division=0``)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))
