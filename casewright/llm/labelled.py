"""Labelled rows for the trained classifiers: the training fold and its bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str | Column, k: int) -> Column:
    """crc32(doc_id as text) mod k; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(k)


def training_labels(labels: DataFrame, target: str, k: int) -> DataFrame:
    """(doc_id, label) of the training fold: remainder not 0, label 0 or 1.

    Rows with a null id or label are left out. A document labelled more than
    once gets its largest label.
    """
    return (labels.select(F.col("doc_id").alias("doc_id"), F.col(target).cast("int").alias("label"))
            .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold("doc_id", k) != 0))
            .groupBy("doc_id").agg(F.max("label").alias("label")))


def bounded_sample(rows: DataFrame, max_rows: int) -> DataFrame:
    """All training rows, or of more than ``max_rows`` those with the smallest hash of their
    id: a uniform sample that does not depend on the order of rows. Only (doc_id, label) is moved."""
    n = rows.count()
    if n <= max_rows:
        return rows
    share = min(1.0, 1.2 * max_rows / n + 100 / n)  # leaves a few more rows than the limit takes
    place = F.xxhash64(F.col("doc_id"), F.lit(7)) / 2.0 ** 64 + 0.5
    return rows.withColumn("_h", place).where(F.col("_h") <= share).orderBy("_h", "doc_id").limit(max_rows).drop("_h")


def with_text(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Texts of the sampled rows: the sample is bounded, so it is broadcast and no text is shuffled."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
