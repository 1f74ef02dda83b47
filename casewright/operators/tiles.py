"""Blocks of rows as single values, and tiles: every block of one side with every block of the other.

``packed`` deals rows into blocks by a hash of ``row`` and writes each block as one value, an Arrow stream with compressed
buffers, in a partition of its own. ``crossed`` pairs blocks by Spark's Cartesian product, which reads the written blocks
anew for each tile. Pairs therefore take no disk, whatever their number, and a task and an Arrow batch hold one tile.
``runs`` pairs a block with many others in one task, which reads these one after another, so that it can answer for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators.common import give_back, reliable_checkpoint


def to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def to_table(body: bytes | pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(body).read_all().combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    """The column as one array."""
    found = table.column(name).combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)


def packed(df: DataFrame, n: int) -> DataFrame:
    """(block, body) of ``df``, which has a column ``row``: one partition and at most one row for each of ``n`` blocks."""
    dealt = df.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).repartitionById(n, "block")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if kept:
            no, table = kept[0].column("block")[:1], pa.Table.from_batches(kept).drop_columns(["block"])
            kept.clear()
            yield pa.RecordBatch.from_arrays([no, pa.array([to_bytes(table.combine_chunks())], pa.binary())], names=["block", "body"])
            del table
        give_back()

    return reliable_checkpoint(dealt.mapInArrow(pack, "block int, body binary"))


def runs(q: DataFrame, c: DataFrame, n: int) -> DataFrame:
    """(no, q, c): every block of ``q`` (no, body) with every block of ``c``, in at most ``n`` tasks for each of ``q``; a task
    holds its block of ``q`` and streams those of ``c``."""
    right = q.select(F.col("no"), F.col("body").alias("q"))
    return c.coalesce(n).select(F.col("body").alias("c")).hint("shuffle_replicate_nl").crossJoin(right)


def crossed(q: DataFrame, c: DataFrame) -> DataFrame:
    """(q, c) bodies of every pair of blocks; one partition for every pair of partitions."""
    return q.select(F.col("body").alias("q")).hint("shuffle_replicate_nl").crossJoin(c.select(F.col("body").alias("c")))


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """The blocks of each tile."""
    for batch in batches:
        for q, c in zip(batch.column("q"), batch.column("c")):
            yield to_table(q.as_buffer()), to_table(c.as_buffer())
