"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without white space ([\\x20\\x09-\\x0D]) at both ends, A-Z
lower-cased; keys of ``Settings.min_chars`` code points or more are tracked, by SHA-256.
A key found in ``Settings.min_docs`` documents loses all its lines except those of the
largest doc_id that holds it.

The store is kept in a folder and changes by whole versions, so that inserting
documents can be undone by deleting them:

* ``refs``: one row for each (key, document), the exact references;
* ``counts``: for each key its number of documents and its largest doc_id;
* ``filters``: for each shard (a hash of the key) a cuckoo filter of 16-bit fingerprints,
  four to a bucket, holding one fingerprint for each key of ``counts``.

``insert`` asks the filters first. A key that its shard's filter does not hold is new
for certain and goes to ``counts`` without a look-up; only the others are joined with the
exact table, which settles false positives. ``delete`` recounts the keys of the documents from
``refs`` and takes the fingerprints of keys that nobody holds any more out of the filters. An
insert that overfills a filter rebuilds all of them from ``counts`` with twice the buckets, and more
shards are made when the keys of a shard pass ``Settings.shard_keys``.

Filters and counts work on one row for each key, pre-aggregated before every shuffle, so a
line that a third of all documents share is one row there. The rows (key, document) of such
a line are joined with the few repeated keys, broadcast by a checked bound, else in a join that
adaptive execution can split. Texts are shuffled only of documents that lose a line. Every table is
written once in the shared folder; a lost executor repeats tasks, and an update that fails leaves the
version before it.

Edge cases: null and empty texts are one empty line. Rows without a doc_id are not
counted and keep all lines. Rows with one doc_id are one document. Inserting a doc_id that the
store holds is an error (delete it first), deleting an unknown one does nothing. ``clean`` leaves
documents alone that were not inserted. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import kernels as K
from casewright.llm import registry
from casewright.llm.session import prepare, read, shared_folder
from casewright.operators.common import bounded_broadcast, reliable_checkpoint

SLOTS = 4
#: Repeated keys that are broadcast at most (48 bytes each).
REPEATED_MAX = 200_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Settings:
    """``shard_keys`` and ``buckets``: keys of a shard, and buckets of its filter at first (a power of two)."""

    min_chars: int = 20
    min_docs: int = 3
    shard_keys: int = 200_000
    buckets: int = 1 << 16


# --- lines ---------------------------------------------------------------------------------

def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every line; a document without \\n is one line."""
    breaks = np.flatnonzero(data == 10)
    n = len(off) - 1
    start = np.concatenate([off[:-1], breaks + 1])
    doc = np.concatenate([np.arange(n), np.searchsorted(off, breaks, side="right") - 1])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end = off[doc + 1].copy()
    more = np.flatnonzero(doc[1:] == doc[:-1])
    end[more] = start[more + 1] - 1
    return start, end, doc


def line_keys(data: np.ndarray, off: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """(start, end, document, key) of every line; the key is None where it is too short."""
    start, end, doc = line_spans(data, off)
    solid = np.flatnonzero(~K.SPACE[data])
    at, last = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = last > at
    first, after = start.copy(), start.copy()
    first[some], after[some] = solid[at[some]], solid[last[some] - 1] + 1
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    long = points[after] - points[first] >= min_chars
    low = _LOWER[data].tobytes()
    keys = [hashlib.sha256(low[a:b]).digest() if x else None for a, b, x in zip(first.tolist(), after.tolist(), long.tolist())]
    return start, end, doc, keys


def _references(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for lo, _, data, off in K.chunks(batch.column("text")):
            _, _, doc, keys = line_keys(data, off, s.min_chars)
            found = dict.fromkeys((d, k) for d, k in zip(doc.tolist(), keys) if k is not None)
            yield pa.RecordBatch.from_pydict({"key": pa.array([k for _, k in found], pa.binary()),
                                              "doc_id": pa.array(ids[[lo + d for d, _ in found]] if found else [], pa.int64())})


def references(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The distinct (key, doc_id) of all documents with an id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    return rows.mapInArrow(lambda b: _references(b, s), "key binary, doc_id long").distinct()


# --- cuckoo filters ------------------------------------------------------------------------

class Filter:
    """Cuckoo filter over 32-byte keys; many keys at a time."""

    def __init__(self, buckets: int, table: bytes | None = None):
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy()
        self.mask = np.uint64(len(self.table) - 1)

    def _places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 4)
        prints = (words[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        return (words[:, 0] & self.mask).astype(np.int64), np.where(prints == 0, np.uint16(1), prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (K.mix(prints.astype(np.uint64)) & self.mask).astype(np.int64)

    def contains(self, keys: list[bytes]) -> np.ndarray:
        bucket, prints = self._places(keys)
        return ((self.table[bucket] == prints[:, None]) | (self.table[self._other(bucket, prints)] == prints[:, None])).any(axis=1)

    def insert(self, keys: list[bytes], rounds: int = 400) -> bool:
        """Whether all keys found a place. In each round every homeless fingerprint tries its bucket, then its
        other one; one of those left over in a bucket throws out a fingerprint that was there."""
        bucket, prints = self._places(keys)
        for turn in range(rounds):
            for _ in range(2):
                if not len(bucket):
                    return True
                left = ~self._settle(bucket, prints)
                bucket, prints = bucket[left], prints[left]
                bucket = self._other(bucket, prints)
            if len(bucket):
                _, one = np.unique(bucket, return_index=True)
                slot = (prints[one].astype(np.int64) + turn) % SLOTS
                thrown = self.table[bucket[one], slot]
                self.table[bucket[one], slot] = prints[one]
                prints[one] = thrown
                bucket[one] = self._other(bucket[one], thrown)
        return not len(bucket)

    def _settle(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; which of them fitted."""
        order = np.argsort(bucket, kind="stable")
        own, first, where = np.unique(bucket[order], return_index=True, return_inverse=True)
        rank = np.arange(len(order)) - first[where]
        taken = self.table[own] != 0
        free = np.argsort(taken, axis=1, kind="stable")
        fits = rank < SLOTS - taken.sum(axis=1)[where]
        at = order[fits]
        self.table[bucket[at], free[where[fits], rank[fits]]] = prints[at]
        out = np.zeros(len(bucket), dtype=bool)
        out[at] = True
        return out

    def remove(self, keys: list[bytes]) -> None:
        """Take one fingerprint out for each key. The keys must have been inserted."""
        bucket, prints = self._places(keys)
        while len(bucket):
            for _ in range(2):
                hit = self.table[bucket] == prints[:, None]
                cell = np.where(hit.any(axis=1), bucket * SLOTS + hit.argmax(axis=1), -1)
                _, one = np.unique(cell, return_index=True)
                one = one[cell[one] >= 0]
                self.table.reshape(-1)[cell[one]] = 0
                left = np.ones(len(bucket), dtype=bool)
                left[one] = False
                if not len(one) and not (self.table[self._other(bucket, prints)] == prints[:, None]).any():
                    raise ValueError("a key to remove is not in the filter")
                bucket, prints = bucket[left], prints[left]
                bucket = self._other(bucket, prints)
                if not len(bucket):
                    return


def _probe(touched: pa.Table, filters: pa.Table) -> pa.Table:
    keys = touched.column("key").to_pylist()
    known = Filter(0, filters.column("cells")[0].as_py()).contains(keys) if filters.num_rows and keys else np.zeros(len(keys), bool)
    return pa.table({"key": touched.column("key"), "known": pa.array(known)})


def _changed(filters: pa.Table, keys: pa.Table, buckets: int) -> pa.Table:
    """The filter of one shard after its keys with ``gone`` are out and the others in; cells are null when it is overfull."""
    shard = (keys if keys.num_rows else filters).column("shard")[0].as_py()
    own = Filter(buckets, filters.column("cells")[0].as_py() if filters.num_rows else None)
    gone = keys.filter(keys.column("gone")).column("key").to_pylist()
    new = keys.filter(pc.invert(keys.column("gone"))).column("key").to_pylist()
    if gone:
        own.remove(gone)
    full = bool(new) and not own.insert(new)
    return pa.table({"shard": pa.array([shard], pa.int32()), "cells": pa.array([None if full else own.table.tobytes()], pa.binary())})


# --- store ---------------------------------------------------------------------------------

@dataclass(frozen=True)
class Store:
    """One version of the store. ``runs`` are the folders of refs; null paths stand for empty tables."""

    folder: str
    settings: Settings
    version: int = 0
    runs: tuple[str, ...] = ()
    counts: str | None = None
    filters: str | None = None
    shards: int = 1
    buckets: int = 0


_REFS, _COUNTS, _FILTERS = "key binary, doc_id long", "key binary, docs long, last long", "shard int, cells binary"
_MANIFEST = "version int, runs array<string>, counts string, filters string, shards int, buckets int"


def empty(folder: str, s: Settings = Settings()) -> Store:
    return Store(folder, s, buckets=s.buckets)


def reopen(spark: SparkSession, folder: str, s: Settings = Settings()) -> Store:
    """The last version that was finished."""
    r = spark.read.schema(_MANIFEST).json(f"{folder}/manifest").orderBy(F.desc("version")).first()
    return Store(folder, s, r.version, tuple(r.runs), r.counts, r.filters, r.shards, r.buckets)


def _save(spark: SparkSession, store: Store) -> Store:
    row = (store.version, list(store.runs), store.counts, store.filters, store.shards, store.buckets)
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").json(f"{store.folder}/manifest")
    return store


def _table(spark: SparkSession, schema: str, *paths: str | None) -> DataFrame:
    paths = [p for p in paths if p is not None]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def refs(spark: SparkSession, store: Store) -> DataFrame:
    """Every (key, doc_id) that the store holds."""
    return _table(spark, _REFS, *store.runs)


def counts(spark: SparkSession, store: Store) -> DataFrame:
    """(key, docs, last): documents that hold the key, and the largest of them."""
    return _table(spark, _COUNTS, store.counts)


def _written(df: DataFrame, path: str) -> str:
    df.write.parquet(path)
    return path


def _shard(store: Store) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(store.shards)).cast("int").alias("shard")


def _next(spark: SparkSession, store: Store, runs: tuple[str, ...], touched: DataFrame, changes: DataFrame) -> Store:
    """The version after ``touched`` (key, docs, last) replaced its keys' counts and ``changes`` (key, gone)
    came into or left the table."""
    base = f"{store.folder}/v{store.version + 1}-{uuid.uuid4().hex[:8]}"
    old = counts(spark, store).join(touched.select("key"), "key", "left_anti")
    path = _written(old.unionByName(touched.where("docs > 0")), f"{base}/counts")
    new = replace(store, version=store.version + 1, runs=runs, counts=path)
    n = counts(spark, new).count()
    if n > new.shards * store.settings.shard_keys:
        new = replace(new, shards=2 * math.ceil(n / store.settings.shard_keys) - 1, filters=None)
    while True:  # without filters, they are made anew from the exact table
        due = counts(spark, new).select("key", F.lit(False).alias("gone")) if new.filters is None else changes
        buckets = new.buckets
        made = (_table(spark, _FILTERS, new.filters).groupBy("shard").cogroup(due.select(_shard(new), "key", "gone").groupBy("shard"))
                .applyInArrow(lambda f, k: _changed(f, k, buckets), _FILTERS))
        path = _written(made, f"{base}/filters-{buckets}")
        if _table(spark, _FILTERS, path).where("cells IS NULL").isEmpty():
            return _save(spark, replace(new, filters=path))
        new = replace(new, buckets=2 * buckets, filters=None)


def _known(spark: SparkSession, store: Store, touched: DataFrame) -> DataFrame:
    """(key, known): whether the filter of the key's shard holds it. A shard's keys are split, so that a batch
    much larger than the store makes no large group."""
    if store.filters is None:
        return touched.select("key", F.lit(False).alias("known"))
    parts = math.ceil(touched.count() / (store.shards * store.settings.shard_keys)) or 1
    part = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(parts)).cast("int").alias("part")
    filters = _table(spark, _FILTERS, store.filters).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return (touched.select(_shard(store), part, "key").groupBy("shard", "part").cogroup(filters.groupBy("shard", "part"))
            .applyInArrow(_probe, "key binary, known boolean"))


def insert(spark: SparkSession, store: Store, new_refs: DataFrame) -> Store:
    """The store with the documents of ``new_refs`` (see ``references``) added."""
    prepare(spark)
    path = shared_folder(spark, "line-refs")
    new_refs = spark.read.schema(_REFS).parquet(_written(new_refs, path))
    if store.runs and not new_refs.join(refs(spark, store).select("doc_id").distinct(), "doc_id", "left_semi").isEmpty():
        raise ValueError("a document is in the store already; delete it first")
    touched = reliable_checkpoint(new_refs.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")))
    asked = reliable_checkpoint(_known(spark, store, touched))
    fresh = asked.where("NOT known").select("key").join(touched, "key")
    known = asked.where("known").select("key").join(touched, "key")
    exact = counts(spark, store).select("key", F.col("docs").alias("had"), F.col("last").alias("had_last"))
    merged = known.join(exact, "key", "left").select(
        "key", (F.col("docs") + F.coalesce("had", F.lit(0))).alias("docs"), F.greatest("last", "had_last").alias("last"),
        F.col("had").isNull().alias("new"))
    after = reliable_checkpoint(merged.unionByName(fresh.withColumn("new", F.lit(True))))
    return _next(spark, store, (*store.runs, path), after.select("key", "docs", "last"),
                 after.where("new").select("key", F.lit(False).alias("gone")))


def delete(spark: SparkSession, store: Store, ids: DataFrame) -> Store:
    """The store without the documents of ``ids`` (doc_id)."""
    prepare(spark)
    ids = reliable_checkpoint(ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct())
    held = refs(spark, store)
    keys = reliable_checkpoint(held.join(bounded_broadcast(ids), "doc_id", "left_semi").select("key").distinct())
    path = _written(held.join(bounded_broadcast(ids), "doc_id", "left_anti"), shared_folder(spark, "line-refs"))
    rest = spark.read.schema(_REFS).parquet(path).groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
    after = reliable_checkpoint(keys.join(rest, "key", "left").select("key", F.coalesce("docs", F.lit(0)).alias("docs"), "last"))
    return _next(spark, store, (path,), after, after.where("docs = 0").select("key", F.lit(True).alias("gone")))


def ingest(docs: DataFrame, batches: int = 2, s: Settings = Settings()) -> Store:
    """A new store of all documents, inserted in batches by a hash of their id."""
    spark = prepare(docs.sparkSession)
    found = spark.read.schema(_REFS).parquet(_written(references(docs, s), shared_folder(spark, "line-keys")))
    store = empty(shared_folder(spark, "line-store"), s)
    for k in range(batches):
        store = insert(spark, store, found.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    return store


# --- cleaning ------------------------------------------------------------------------------

def dropped(spark: SparkSession, store: Store) -> DataFrame:
    """(doc_id, keys): the keys whose lines each document loses."""
    repeated = reliable_checkpoint(counts(spark, store).where(F.col("docs") >= store.settings.min_docs).select("key", "last"))
    return (refs(spark, store).join(bounded_broadcast(repeated, REPEATED_MAX), "key").where("doc_id <> last")
            .groupBy("doc_id").agg(F.collect_list("key").alias("keys")))


def _kept(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lost = [set(x) for x in batch.column("keys").to_pylist()]
        for lo, hi, data, off in K.chunks(batch.column("text")):
            start, end, doc, keys = line_keys(data, off, s.min_chars)
            raw, bounds = data.tobytes(), np.searchsorted(doc, np.arange(hi - lo + 1))
            texts, gone = [], []
            for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                stay = [i for i in range(a, b) if keys[i] not in lost[lo + d]]
                texts.append(b"\n".join(raw[start[i]:end[i]] for i in stay).decode())
                gone.append(int(b - a) - len(stay))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(bounds), pa.int64()), pa.array(gone, pa.int64()),
                pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])


def clean(docs: DataFrame, store: Store) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of every row; text is what stays of it."""
    spark = prepare(docs.sparkSession)
    s = store.settings
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lost = reliable_checkpoint(dropped(spark, store))
    ids = bounded_broadcast(lost.select("doc_id"))
    cut = rows.join(ids, "doc_id", "left_semi").join(lost, "doc_id").mapInArrow(
        lambda b: _kept(b, s), "doc_id long, n_lines long, n_dropped long, text string")
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    whole = rows.join(ids, "doc_id", "left_anti").select("doc_id", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), "text")
    return whole.unionByName(cut)


@registry.query("op13_line_dedup", sql=r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.last IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c USING (key))
SELECT min(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r""")
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return clean(docs, ingest(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
