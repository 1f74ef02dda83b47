"""Exact dedup: tree-merge of sorted digest runs.

Texts are equal when identical after white space ([\\x20\\x09-\\x0D]) is
deleted; null counts as empty. Every input partition becomes a run of (SHA-256
digest, best row, count), sorted by digest, with one entry for each text it
holds. Runs are then merged in binomial rounds: in each round ``FAN_IN``
neighbouring runs become one, sharded by digest over all tasks, by a sorted
merge that keeps one verified entry for each text: entries are taken as equal
only if digest, a second independent hash and the normalised length all agree.
Of equal texts the row with the most code points in the original text stays,
then the smallest doc_id, then the first row read.

A text that a third of all rows share is one entry of each run, so a merge
task reads at most ``FAN_IN`` entries of it in a round; only digests are ever
shuffled. The digests of all rows (no texts) are cut off by a reliable
checkpoint, so a lost executor costs no second read of the texts. The last join, of
the rows with the texts that occur more than once, has fixed-width rows, and
adaptive execution splits a hot digest there.

Edge cases: null and empty texts are one group. A null doc_id comes after all
others. Of repeated rows (same id and text) exactly one is kept, the first read. An
empty table gives no rows. ``mark`` returns its own columns only, so further
columns of the input cannot clash; ``keep`` returns the input's columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import registry
from casewright.llm.session import prepare, read, shared_folder
from casewright.operators.common import bounded_broadcast, reliable_checkpoint

#: Runs that one round merges into one.
FAN_IN = 8

#: Deleted before texts are compared: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"

_KEY = ["run", "digest", "second", "length"]
_RUN = "run int, digest binary, second long, length int, n_chars int, keep_id long, keep_row long, group_size long"


def digest_rows(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(doc_id, row, run, digest, second, length, n_chars) of every row; texts end here.
    ``row`` is a number of each row, by default its place in the scan."""
    row = F.monotonically_increasing_id() if row is None else row
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.translate(text, SPACES, "")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), F.length(text).alias("n_chars"), bare.alias("bare"))
            .select("doc_id", "row", F.spark_partition_id().alias("run"),
                    F.unhex(F.sha2("bare", 256)).alias("digest"), F.xxhash64("bare").alias("second"), F.length("bare").alias("length"), "n_chars"))


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapse equal neighbours of a sorted stream to the first of them, summing group_size.
    The last entry is held back until the next batch shows whether it goes on."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        words = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint64).reshape(-1, 4)
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = (words[1:] != words[:-1]).any(axis=1)
        for name in ("run", "second", "length"):
            column = batch.column(name).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        first = np.flatnonzero(new)
        sizes = np.add.reduceat(batch.column("group_size").to_numpy(), first)
        merged = batch.take(pa.array(first)).set_column(batch.schema.get_field_index("group_size"), pa.field("group_size", pa.int64()), pa.array(sizes))
        yield merged.slice(0, len(first) - 1)
        held = merged.slice(len(first) - 1)
    if held is not None:
        yield held


def _merged(runs: DataFrame) -> DataFrame:
    order = [*_KEY, F.col("n_chars").desc(), F.col("keep_id").asc_nulls_last(), "keep_row"]
    return runs.sortWithinPartitions(*order).mapInArrow(merge_runs, _RUN)


def groups(rows: DataFrame) -> DataFrame:
    """One row for each text: digest, second, length, keep_id, keep_row, group_size.
    ``rows`` is a checkpointed ``digest_rows``."""
    runs = _merged(rows.select("run", "digest", "second", "length", "n_chars", F.col("doc_id").alias("keep_id"),
                               F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size")))
    n = 1 + (rows.agg(F.max("run")).first()[0] or 0)
    while n > 1:
        runs = _merged(runs.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int")).repartition("run", "digest"))
        n = -(-n // FAN_IN)
    return runs.drop("run", "n_chars")


def _marked(rows: DataFrame) -> DataFrame:
    many = groups(rows).where(F.col("group_size") > 1)
    same = [rows[c] == many[c] for c in ("digest", "second", "length")]
    return rows.join(many, same, "left").select(
        rows["doc_id"], rows["row"],
        F.when(F.col("group_size").isNull(), rows["doc_id"]).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_row") == rows["row"], F.lit(True)).alias("kept"),
        F.lower(F.hex(rows["digest"])).alias("text_sha256"))


def mark(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    prepare(docs.sparkSession)
    return _marked(reliable_checkpoint(digest_rows(docs))).drop("row")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. ``docs`` is written once with a number
    for each row: a second scan could be split in another way and number its rows otherwise."""
    spark = prepare(docs.sparkSession)
    path = shared_folder(spark, "exact-dedup")
    docs.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    docs = spark.read.parquet(path)
    gone = _marked(reliable_checkpoint(digest_rows(docs, F.col("_row")))).where(~F.col("kept")).select("row").withColumnRenamed("row", "_row")
    return docs.join(bounded_broadcast(reliable_checkpoint(gone)), "_row", "left_anti").drop("_row")


@registry.query("op7_exact_dedup", sql=r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM w""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(read(spark, sf_dir, "documents", "doc_id", "text"))
