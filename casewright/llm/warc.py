"""WARC archives: monolithic gzip normaliser with a sidecar offset index.

``write_monolithic`` turns pages into WARC records with DataFrame expressions
and writes them with Spark's text sink, gzip-compressed, so that every archive
is one gzip stream (the record separator CR LF CR LF is the sink's line end).
``normalise`` inflates each archive once, as a stream, writes every record again
as a gzip member of its own and a sidecar ``.idx`` (JSON lines: archive, offset,
length, type) beside the archive. ``read_records`` reads the sidecars and
fetches each member by its offset, so one archive can be read by many tasks.

Of records with equal payloads (SHA-1) of at least ``MIN_REVISIT_BYTES`` bytes,
that with the largest page_id is the response and the others are revisits of
it; smaller ones are all responses. The groups of equal payloads are fixed-width
rows and are broadcast up to ``BROADCAST_ROWS``; beyond, the join is shuffled
and adaptive execution splits a hot payload.

Memory: a task holds one record and one buffer of ``BLOCK`` bytes. Files are
written under a name of the task attempt and then renamed, and their content
depends on the records only, so a task that runs again does no harm. Files are
opened through ``pyarrow.fs``, that is in the shared folder, never a local one.

Edge cases: null html is an empty payload; a null url is written as
``urn:page``; line ends in a url become blanks. A null page_id is read back as
null, is a response and is never referred to. Rows that repeat the largest
page_id of a group are all responses. An empty table gives no rows. Columns other
than page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import registry
from casewright.llm.session import prepare, read, shared_folder
from casewright.operators.common import bounded_broadcast, reliable_checkpoint

MIN_REVISIT_BYTES = 1000
BROADCAST_ROWS = 500_000
#: Bytes read from an archive at a time.
BLOCK = 1 << 20
#: Span of an archive that one task reads back, in bytes.
READ_SPAN = 32 << 20
RECORD_END = "\r\n\r\n"
#: Default of the WARC-Date header: pages have no date of their own.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "archive string, offset long, length long, type string"
_RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page-"), page_id.cast("string")))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def records(pages: DataFrame) -> DataFrame:
    """(value) one WARC record of each page, without its closing separator."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
                        F.octet_length(html).alias("bytes"), F.sha1(html).alias("digest"))
    equal = (page.where((F.col("bytes") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull())
             .groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("digest", "response"))
    page = page.join(bounded_broadcast(reliable_checkpoint(equal), BROADCAST_ROWS), "digest", "left")
    revisit = F.col("response") > F.col("page_id")
    line = lambda name, value, when=None: F.when(F.lit(True) if when is None else when, F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")))
    urn = lambda page_id: F.concat(F.lit("<urn:uuid:"), _record_id(page_id), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(RECORD_END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    return page.withColumn("block", block).select(F.concat(
        F.lit("WARC/1.1\r\n"),
        *[F.coalesce(x, F.lit("")) for x in (
            line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", urn(F.coalesce(F.col("page_id").cast("string"), F.col("digest")))),
            line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("urn:page")), r"[\r\n]", " ")),
            line("WARC-Date", F.lit(DATE)),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            line("WARC-Profile", F.lit(REVISIT_PROFILE), revisit),
            line("WARC-Refers-To", urn(F.col("response")), revisit),
            line("X-Refers-To-Page", F.col("response"), revisit),
            line("X-Page-ID", F.col("page_id")),
            line("X-Payload-Length", F.col("bytes")),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", F.octet_length("block")))],
        F.lit("\r\n"), F.col("block")).alias("value"))


def write_monolithic(pages: DataFrame, folder: str) -> None:
    """One gzip stream for each partition of ``pages``."""
    records(pages).write.option("compression", "gzip").option("lineSep", RECORD_END).text(folder)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", uri)))


def split_records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, each with its closing separator, of a stream of archive bytes."""
    buffer, need = bytearray(), 0
    for block in blocks:
        buffer += block
        at = 0
        while len(buffer) - at >= max(need, 1):
            head = buffer.find(b"\r\n\r\n", at)
            if head < 0:
                break
            size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", bytes(buffer[at:head + 2]))[1])
            need = head + 8 + size - at
            if len(buffer) - at < need:
                break
            yield bytes(buffer[at:at + need])
            at, need = at + need, 0
        del buffer[:at]
    if buffer:
        raise ValueError("the archive ends within a record")


def inflated(stream, block: int = BLOCK) -> Iterator[bytes]:
    """Inflated blocks of a gzip file of one or more members, in one pass."""
    inflate = zlib.decompressobj(31)
    while data := stream.read(block):
        while data:
            yield inflate.decompress(data, block)
            data = inflate.unconsumed_tail
            if inflate.eof:
                data, inflate = inflate.unused_data, zlib.decompressobj(31)
    yield inflate.flush()


def header(record: bytes, name: str) -> str | None:
    found = re.search(rb"(?i)\r\n" + name.encode() + rb":[ \t]*([^\r\n]*)", record[:record.index(b"\r\n\r\n")])
    return found[1].decode() if found else None


def _normalise_one(source: str, folder: str, name: str, attempt: str) -> tuple[int, int]:
    """Rewrite one archive; returns its records and bytes. The index appears after the archive."""
    files, path = _open(source)
    out, base = _open(folder)
    out.create_dir(base, recursive=True)
    target, offset, n = f"{base}/{name}", 0, 0
    with files.open_input_stream(path, compression=None) as stream, out.open_output_stream(f"{target}.{attempt}", compression=None) as archive, \
            out.open_output_stream(f"{target}.idx.{attempt}", compression=None) as index:
        for record in split_records(inflated(stream)):
            gz = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = gz.compress(record) + gz.flush()
            archive.write(member)
            index.write(json.dumps({"archive": name, "offset": offset, "length": len(member), "type": header(record, "WARC-Type")}).encode() + b"\n")
            offset, n = offset + len(member), n + 1
    for end in ("", ".idx"):
        try:
            out.move(f"{target}{end}.{attempt}", f"{target}{end}")
        except OSError:  # some stores do not rename over a file, which another attempt has finished
            out.delete_file(f"{target}{end}")
            out.move(f"{target}{end}.{attempt}", f"{target}{end}")
    return n, offset


def normalise(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """Rewrite all archives of ``source`` to ``folder``; returns (archive, records, bytes) of each."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    n = max(1, found.count())

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = str(TaskContext.get().taskAttemptId())
        for batch in batches:
            for path in batch["path"]:
                name = re.sub(r"(\.txt)?\.gz$", ".warc.gz", path.rsplit("/", 1)[1])
                yield pd.DataFrame([(name, *_normalise_one(path, folder, name, attempt))], columns=["archive", "records", "bytes"])

    return reliable_checkpoint(found.repartition(n).mapInPandas(rewrite, "archive string, records long, bytes long"))


def parse(record: bytes) -> tuple:
    """Fields of one record; a revisit has no payload, its length and digest are those of the full one."""
    kind = header(record, "WARC-Type")
    digest, size = header(record, "WARC-Payload-Digest").removeprefix("sha1:"), int(header(record, "X-Payload-Length"))
    payload = None
    if kind == "response":
        block = record[record.index(b"\r\n\r\n") + 4:-4]
        payload = block[block.index(b"\r\n\r\n") + 4:]
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError("a payload does not agree with its record's digest")
    page, refers = header(record, "X-Page-ID"), header(record, "X-Refers-To-Page")
    return page and int(page), header(record, "WARC-Target-URI"), payload, size, digest, kind, refers and int(refers)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, offset, length, type) of every record, from the sidecars."""
    return spark.read.schema(_INDEX).option("pathGlobFilter", "*.idx").json(folder)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the normalised archives, each fetched by its offset, in tasks of about ``READ_SPAN`` bytes."""
    index = read_index(spark, folder)
    tasks = 1 + (index.agg(F.sum("length")).first()[0] or 0) // READ_SPAN
    spans = (index.repartition(max(tasks, spark.sparkContext.defaultParallelism), "archive", F.floor(F.col("offset") / READ_SPAN))
             .sortWithinPartitions("archive", "offset").select("archive", "offset", "length"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _open(folder)
        for batch in batches:
            for name, rows in batch.groupby("archive", sort=False):
                with files.open_input_file(f"{base}/{name}") as archive:
                    out, held = [], 0
                    for offset, length in zip(rows["offset"], rows["length"], strict=True):
                        out.append(parse(zlib.decompress(archive.read_at(int(length), int(offset)), 31)))
                        held += out[-1][3]
                        if held >= BLOCK:
                            yield _frame(out)
                            out, held = [], 0
                    if out:
                        yield _frame(out)

    return spans.mapInPandas(fetch, _RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back; archives stay in the shared checkpoint folder."""
    spark = prepare(pages.sparkSession)
    folder = shared_folder(spark, "warc")
    write_monolithic(pages, f"{folder}/monolithic")
    if normalise(spark, f"{folder}/monolithic", f"{folder}/records").agg(F.sum("records")).first()[0]:
        return read_records(spark, f"{folder}/records")
    return spark.createDataFrame([], _RECORD)


@registry.query("op8_warc", sql="""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < response THEN response END AS refers_to
FROM k""")
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "pages", "page_id", "url", "html")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
