"""X1/X2 on an event stream: replays, late and bad rows, and running statistics per session.

Messages arrive as files of JSON lines (msg_id, session_id, event_time, text). A line that is no such object goes to the
error sink with the reason and its text; the others carry their event time, behind which the watermark follows by
``delay``. A message that comes again within the delay is dropped by Spark's
``dropDuplicatesWithinWatermark`` (state: one id for each message of the last ``delay``), a line that is later than the watermark
is dropped and counted in the query's progress.

Each micro-batch is admitted, assisted and written to ``<sink>/epoch=<id>`` with overwrite, so an epoch that is run again after
a failure rewrites its own output. When a batch fails, its rows are halved by a hash of the id until the failing ones stand alone: these
go to the error sink with the error, the others are written. Batches are bounded by ``files_per_batch``.

Statistics (X2) are a streaming aggregate keyed by (day window, session) in update mode: Spark keeps one row of
state for each key and drops it when the watermark passes the window. The sink upserts: an epoch writes the
version of the table that follows the one before it, so a repeated epoch gives the same version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from casewright.operators import policy as P
from casewright.operators.admission import flag_messages

MESSAGE = "msg_id long, session_id long, event_time timestamp, text string"
ERRORS = "msg_id long, reason string, line string"
#: Halvings of a failing batch; 2^20 rows stand alone after as many.
HALVINGS = 24


def parsed(lines: DataFrame) -> DataFrame:
    """Message columns and ``reason``, null for a whole message, of every line (``value``). Blank lines are no rows."""
    one = F.from_json("value", MESSAGE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(F.trim("value") != "").select("value", one.alias("m"))
    reason = (F.when(F.col("m").isNull() | F.col("m._bad").isNotNull(), "malformed")
              .when(F.col("m.msg_id").isNull(), "no msg_id").when(F.col("m.event_time").isNull(), "no event_time"))
    return rows.select("m.msg_id", "m.session_id", "m.event_time", "m.text", reason.alias("reason"), F.col("value").alias("line"))


def _write_apart(rows: DataFrame, work: Callable[[DataFrame], DataFrame], sink: str, errors: str, part: str = "all", left: int = HALVINGS) -> None:
    """Write ``work(rows)``; where it fails, do so for halves, down to the failing rows."""
    try:
        work(rows).write.mode("overwrite").parquet(f"{sink}/part={part}")
    except Exception as e:  # whatever fails in a row must not end the stream
        ids = rows.select("msg_id").distinct()
        if left == 0 or ids.limit(2).count() < 2:
            reason = F.lit(f"failed: {type(e).__name__}")
            (rows.select("msg_id", reason.alias("reason"), F.lit(None).cast("string").alias("line"))
             .write.mode("overwrite").parquet(f"{errors}/part={part}"))
            return
        half = F.pmod(F.xxhash64("msg_id", F.lit(left)), F.lit(2))
        for k in (0, 1):
            _write_apart(rows.where(half == k), work, sink, errors, f"{part}{k}", left - 1)


def lines_of(spark: SparkSession, source: str, files_per_batch: int) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)


def run_messages(spark: SparkSession, source: str, assist: Callable[[DataFrame], DataFrame], sink: str, errors: str, checkpoint: str,
                 delay: str = "1 hour", files_per_batch: int = 1) -> list[StreamingQuery]:
    """Process what has arrived, then end. ``assist`` maps (msg_id, text) rows to result rows."""
    rows = parsed(lines_of(spark, source, files_per_batch))

    def bad(batch: DataFrame, epoch: int) -> None:
        batch.select("msg_id", "reason", "line").write.mode("overwrite").parquet(f"{errors}/lines/epoch={epoch}")

    def good(batch: DataFrame, epoch: int) -> None:
        batch = batch.select("msg_id", "text").checkpoint()  # read again for every half
        flagged = flag_messages(batch, "text")
        # Overwriting the epoch's folders takes away all that an earlier try of it has left.
        (flagged.where(~F.col("accepted")).select("msg_id", F.col("reject_reason").alias("reason"), F.lit(None).cast("string").alias("line"))
         .write.mode("overwrite").parquet(f"{errors}/rows/epoch={epoch}"))
        batch.limit(0).select("msg_id").write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
        ok = flagged.where("accepted").select("msg_id", "text")
        if not ok.isEmpty():
            _write_apart(ok, assist, f"{sink}/epoch={epoch}", f"{errors}/rows/epoch={epoch}")

    fresh = rows.where("reason IS NULL").withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["msg_id"])
    queries = [df.writeStream.foreachBatch(fn).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
               for df, fn, name in ((rows.where("reason IS NOT NULL"), bad, "bad"), (fresh, good, "good"))]
    for q in queries:
        q.awaitTermination()
    return queries


def results(spark: SparkSession, sink: str, schema: str) -> DataFrame:
    """All rows of a sink or of the errors (part files of all epochs)."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(sink)


# --- X2 ------------------------------------------------------------------------------------

def session_stats(decided: DataFrame) -> DataFrame:
    """Statistics of each (day, session): a streaming or a batch DataFrame. Confidence is summed in ten-thousandths, so
    that the mean does not depend on the order of rows."""
    part = F.round(F.col("intent_confidence") * 10_000).cast("long")
    return (decided.groupBy(F.window("event_time", "1 day"), "session_id").agg(
        F.count(F.lit(1)).alias("analysed"), F.count_if(F.col("decision") == "auto_handle").alias("auto_handled"),
        F.count_if(F.col("decision") == "escalate").alias("escalated"), F.sum(part).alias("confidence"))
        .select(F.col("window.start").alias("day"), "session_id", "analysed", "auto_handled", "escalated",
                F.round(F.col("confidence") / F.col("analysed") / 10_000, 4).alias("mean_confidence")))


STATS = "day timestamp, session_id long, analysed long, auto_handled long, escalated long, mean_confidence double"


def _version(spark: SparkSession, sink: str, epoch: int) -> DataFrame:
    return spark.read.schema(STATS).parquet(f"{sink}/version={epoch}") if epoch >= 0 else spark.createDataFrame([], STATS)


def run_session_stats(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, delay: str = "2 days",
                      files_per_batch: int = 1) -> StreamingQuery:
    """Update-mode statistics of decided messages; every epoch writes the next version of the table."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stats = session_stats(P.decide(stream.withWatermark("event_time", delay)))

    def upsert(batch: DataFrame, epoch: int) -> None:
        changed = batch.checkpoint()
        same = [F.col("o.day") == F.col("c.day"), F.col("o.session_id").eqNullSafe(F.col("c.session_id"))]
        kept = _version(spark, sink, epoch - 1).alias("o").join(changed.alias("c"), same, "left_anti")
        kept.unionByName(changed).write.mode("overwrite").parquet(f"{sink}/version={epoch}")

    q = (stats.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def latest(spark: SparkSession, sink: str) -> DataFrame:
    """The last version of the statistics."""
    rows = spark.read.schema(f"{STATS}, version int").parquet(sink)
    last = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == F.lit(last)).drop("version")
