"""Spark session and checkpoint-directory helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "casewright") -> SparkSession:
    """Create (or reuse) a session with the settings every job relies on.

    On a cluster the master and most sizing come from spark-submit; the
    defaults here only apply when nothing else set them.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def suggest_shuffle_partitions(input_bytes: int, target_bytes: int = 256 << 20, minimum: int = 1) -> int:
    """Shuffle partitions sized so each holds about ``target_bytes`` of input
    (e.g. 100 TB -> ~400k partitions at 256 MB); AQE then coalesces small ones."""
    return max(minimum, -(-int(input_bytes) // target_bytes))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...)
    and is used as is. Only when nothing is configured (local tests) do we
    fall back to a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="casewright-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint directory for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name
