"""Near-duplicate documents by HyperMinHash sketches.

A document is its set of distinct w-word shingles (words are runs of bytes other
than [\\x20\\x09-\\x0D], A-Z lower-cased; a text with fewer words is one shingle).
Its 64-bit shingle hashes fall into 256 buckets; the smallest hash of each is
stored as a 16-bit register: its count of leading zeros and the ten mantissa bits
after the leading one. ``BANDS`` bands of ``ROWS`` registers are hashed to band
keys; an empty register borrows from the first filled bucket of its own fixed random
order, which keeps the chance of agreement at the Jaccard similarity for short
texts too. A pair of documents with similarity 0.8 shares no band with
probability (1 - 0.8^5)^40, about 1e-7.

Documents with equal sets form a class, represented by its smallest doc_id. Among
representatives, links are found in two steps that never list all pairs of a group:

1. Each document is paired with one pivot, the smallest id of a band bucket (the
   pivot it shares most bands with). Pairs are estimated from their registers, corrected
   for chance collisions of registers, and those not clearly below the
   threshold are verified on the full shingle sets. Confirmed links are merged.
2. A bucket whose members now have one component needs no more. In the others, the
   members outside the bucket's largest component are compared with all members
   of other components: small buckets by a join on the bucket key, large ones in tiles
   of about ``TILE`` x ``TILE`` documents, which return at most one verified link from a
   document to a component. Pairs are verified if their estimate passes.

So every pair that shares a band is either in one component or was compared, and no
candidate is dropped. Confirmed links are merged by distributed connected
components. Only ids and sketches are shuffled, and the texts of documents in
pairs; a pivot with many partners is salted. Intermediate tables are reliable
checkpoints.

Edge cases: null text, empty text and text without words have an empty set and are
linked with nothing. A null doc_id cannot be linked: its component_id is null
and it is kept. Rows with the same doc_id are one document, linked if any of them is;
they share component and flag. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import kernels as K
from casewright.llm import registry
from casewright.llm.components import components
from casewright.llm.session import prepare, read
from casewright.operators.common import bounded_broadcast, reliable_checkpoint

REGISTERS = 256
BANDS, ROWS = 40, 5
MANTISSA = 10
#: Members of a bucket that are compared by a plain join; larger ones go through tiles of TILE documents.
SMALL, TILE = 32, 256
#: Partners of a pivot that one task verifies.
PARTNERS = 256
_SKETCH = "doc_id long, n_shingles long, cls binary, bands array<long>, registers binary"


@dataclass(frozen=True)
class Settings:
    """``percent``: link when 100 * intersection >= percent * union. ``sigmas``: standard errors that
    an estimate may lie below the threshold before a pair is given up."""

    width: int = 5
    percent: int = 80
    sigmas: float = 6.0


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of each document one after another, bounds)."""
    words, doc = K.word_hashes(data, off)
    n_docs = len(off) - 1
    counts = np.bincount(doc, minlength=n_docs)
    h, d = K.ngram_hashes(words, doc, width)
    parts = [(h, d)]
    for n in range(1, width):  # texts of n < width words are one shingle
        if (counts == n).any():
            short = counts[doc] == n
            parts.append(K.ngram_hashes(words[short], doc[short], n))
    if len(parts) > 1:
        h, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    bounds = np.searchsorted(d, np.arange(n_docs + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        h[a:b].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.searchsorted(d[new], np.arange(n_docs + 1))


def registers(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """(document, bucket) registers of sorted hashes; 0 is empty."""
    bucket = (h >> np.uint64(56)).astype(np.int64)
    first = np.ones(len(h), dtype=bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])
    rest = (h[first] >> np.uint64(24)).astype(np.uint32)
    zeros = (32 - np.frexp(rest.astype(np.float64))[1]).astype(np.uint32)
    after = (rest.astype(np.uint64) << zeros.astype(np.uint64)) & np.uint64(0x7FFFFFFF)
    out = np.zeros((n_docs, REGISTERS), np.uint16)
    out[doc[first], bucket[first]] = ((zeros + 1) << MANTISSA) | (after >> np.uint64(31 - MANTISSA)).astype(np.uint32)
    return out


@lru_cache(maxsize=1)
def _donors() -> np.ndarray:
    """Row j: the fixed random order in which register j looks for a filled bucket, itself first."""
    cell = np.arange(BANDS * ROWS * REGISTERS, dtype=np.uint64).reshape(-1, REGISTERS)
    key = K.mix(cell + np.uint64(1 << 50)) >> np.uint64(1)
    key[np.arange(len(key)), np.arange(len(key))] = 0
    return np.argsort(key, axis=1, kind="stable")


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(document, band) keys; rows of documents with an empty set mean nothing."""
    used, donors = BANDS * ROWS, _donors()
    value = np.zeros((len(regs), used), np.uint64)
    some = np.flatnonzero(regs.any(axis=1))
    row, col = np.repeat(some, used), np.tile(np.arange(used), len(some))
    for t in range(REGISTERS):
        if not len(row):
            break
        donor = donors[col, t]
        found = regs[row, donor]
        hit = found > 0
        value[row[hit], col[hit]] = found[hit].astype(np.uint64) | donor[hit].astype(np.uint64) << np.uint64(16)
        row, col = row[~hit], col[~hit]
    keys = np.zeros((len(regs), BANDS), np.uint64)
    for r in range(ROWS):
        keys = K.mix(keys * np.uint64(0x9FB21C651E98DF25) + value[:, r::ROWS])
    return K.mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, off in K.chunks(batch.column("text")):
            h, bounds = shingle_sets(data, off, width)
            n = np.diff(bounds)
            doc = np.repeat(np.arange(hi - lo), n)
            regs = registers(h, doc, hi - lo)
            total = np.append(np.uint64(0), np.cumsum(h))
            other = np.append(np.uint64(0), np.cumsum(K.mix(h ^ np.uint64(0x5851F42D4C957F2D))))
            cls = np.stack([K.mix((total[bounds[1:]] - total[bounds[:-1]]) + n.astype(np.uint64)), other[bounds[1:]] - other[bounds[:-1]]], axis=1)
            empty = n == 0
            keys = band_keys(regs)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()),
                pa.array([None if e else c.tobytes() for e, c in zip(empty, cls)], pa.binary()),
                pa.array([[] if e else k for e, k in zip(empty, keys)], pa.list_(pa.int64())),
                pa.array([r.tobytes() for r in regs], pa.binary())], names=["doc_id", "n_shingles", "cls", "bands", "registers"])


def collision_chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that the registers of a bucket agree though the smallest hashes differ, for sets of
    n and m shingles: the sum over register cells of the chance that both minima fall in one."""
    a, b = np.maximum(n, 1) / REGISTERS, np.maximum(m, 1) / REGISTERS
    level = np.arange(1, 33)[:, None]
    lo, width = 2.0 ** -level, 2.0 ** -level / (1 << MANTISSA)
    both = (a * b / (a + b) * width * (np.exp(-(a + b) * lo) - np.exp(-(a + b) * 2 * lo))).sum(axis=0)
    return both / ((1 - np.exp(-a)) * (1 - np.exp(-b)))


def passes(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, not clearly below the threshold) of pairs of register rows."""
    filled = ((x > 0) | (y > 0)).sum(axis=1)
    agree = ((x == y) & (x > 0)).sum(axis=1) / np.maximum(filled, 1)
    chance = collision_chance(n, m)
    estimate = np.clip((agree - chance) / (1 - chance), 0, 1)
    t = s.percent / 100
    return estimate, estimate >= t - s.sigmas * np.sqrt(t * (1 - t) / np.maximum(filled, 1))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _estimated(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            _, ok = passes(_matrix(batch.column("ra")), _matrix(batch.column("rb")), batch.column("na").to_numpy(), batch.column("nb").to_numpy(), s)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])


def estimated(pairs: DataFrame, sketches: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose corrected estimate is not clearly below the threshold."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    own = sketches.join(bounded_broadcast(ids), "doc_id", "left_semi")
    of = lambda c: own.select(F.col("doc_id").alias(c), F.col("registers").alias(f"r{c}"), F.col("n_shingles").alias(f"n{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(lambda x: K.freed(_estimated(x, s)), "a long, b long")


def _verified(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, salt, is partner): the sets of a, then those of its partners."""
    key, sets = None, []
    for batch in batches:
        a, salt, partner, b = (batch.column(c).to_numpy() for c in ("a", "salt", "partner", "b"))
        out = []
        for lo, hi, data, off in K.chunks(batch.column("text")):
            h, bounds = shingle_sets(data, off, s.width)
            for i in range(lo, hi):
                own = h[bounds[i - lo]:bounds[i - lo + 1]]
                if (a[i], salt[i]) != key:
                    key, sets = (a[i], salt[i]), []
                if not partner[i]:
                    sets.append(own.copy())
                    continue
                if any(_linked(own, other, s) for other in sets):
                    out.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(a[out]), pa.array(b[out])], names=["a", "b"])


def verified(pairs: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) that hold on the full shingle sets. ``pairs`` is a checkpoint."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = docs.join(bounded_broadcast(ids), "doc_id", "left_semi").select("doc_id", "text")
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts"))
    salted = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
    pivots = (salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(texts, F.col("a") == F.col("doc_id"))
              .select("a", "salt", F.lit(0).alias("partner"), F.col("a").alias("b"), "text"))
    partners = salted.join(texts, F.col("b") == F.col("doc_id")).select("a", "salt", F.lit(1).alias("partner"), "b", "text")
    return (pivots.union(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", "partner", "b")
            .mapInArrow(lambda x: K.freed(_verified(x, s)), "a long, b long").distinct())


def _linked(x: np.ndarray, y: np.ndarray, s: Settings) -> bool:
    """Whether two sorted shingle sets are similar enough."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= s.percent * (len(x) + len(y) - both)


def _tile(rows: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """Links of one tile: its minor members against all members of other components that share a
    band, best estimate first. One link from a document to a component is enough to join the two."""
    sets, regs = [], []
    for lo, hi, data, off in K.chunks(pa.array(rows["text"], pa.string())):
        h, bounds = shingle_sets(data, off, s.width)
        sets += [h[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        regs.append(registers(h, np.repeat(np.arange(hi - lo), np.diff(bounds)), hi - lo))
    regs = np.concatenate(regs)
    keys, n = band_keys(regs), np.array([len(x) for x in sets])
    ids, labels, minor, side = (rows[c].to_numpy() for c in ("doc_id", "label", "minor", "side"))
    right, out = np.flatnonzero(side == 1), []
    for i in np.flatnonzero(side == 0):
        due = right[(labels[right] != labels[i]) & (~minor[right] | (ids[right] > ids[i]))]
        due = due[(keys[due] == keys[i]).any(axis=1)]
        if not len(due):
            continue
        estimate, ok = passes(np.broadcast_to(regs[i], (len(due), REGISTERS)), regs[due], np.full(len(due), n[i]), n[due], s)
        joined: set[int] = set()
        for j in due[ok][np.argsort(-estimate[ok], kind="stable")]:
            if labels[j] not in joined and _linked(sets[i], sets[j], s):
                joined.add(labels[j])
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _tiles(rows: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Links in large buckets. ``rows``: key, doc_id, label, major, minor. Buckets with the same largest
    component are compared as one group, so a document is sent once for all its bands."""
    members = reliable_checkpoint(rows.groupBy("major", "doc_id", "label").agg(F.max("minor").alias("minor")))
    sizes = members.groupBy("major").agg(F.count("*").alias("n"), F.count_if("minor").alias("n_minor"))
    rows = members.join(sizes, "major")
    blocks = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    block = lambda c: F.pmod(F.xxhash64("doc_id"), blocks(c)).cast("int")
    other = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    cols = ["major", "doc_id", "label", "minor"]
    left = rows.where("minor").select(*cols, F.lit(0).alias("side"), block("n_minor").alias("i"), other("n").alias("j"))
    right = rows.select(*cols, F.lit(1).alias("side"), block("n").alias("j"), other("n_minor").alias("i")).select(left.columns)
    texts = docs.join(bounded_broadcast(members.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "text")
    return left.union(right).join(texts, "doc_id").groupBy("major", "i", "j").applyInPandas(lambda t: _tile(t, s), "a long, b long")


def _second_step(members: DataFrame, labels: DataFrame, tried: DataFrame, sketches: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Verified links in buckets of several components, across components."""
    rows = reliable_checkpoint(members.join(labels, members["doc_id"] == labels["node"], "left")
                               .select("key", "doc_id", F.coalesce("label", "doc_id").alias("label")))
    sizes = (rows.groupBy("key", "label").agg(F.count("*").alias("n"))
             .groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("largest")))
    mixed = sizes.where("labels > 1").select("key", "n", F.col("largest.label").alias("major"))
    rows = reliable_checkpoint(rows.join(mixed, "key").withColumn("minor", F.col("label") != F.col("major")))
    small, large = rows.where(F.col("n") <= SMALL), rows.where(F.col("n") > SMALL)
    x, y = small.alias("x"), small.alias("y")
    near = (x.join(y, F.col("x.key") == F.col("y.key")).where(
        F.col("x.minor") & (F.col("x.label") != F.col("y.label")) & (~F.col("y.minor") | (F.col("x.doc_id") < F.col("y.doc_id"))))
        .select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct())
    pairs = estimated(reliable_checkpoint(near.join(tried, ["a", "b"], "left_anti")), sketches, s)
    links = verified(reliable_checkpoint(pairs), docs, s)
    return links if large.isEmpty() else links.union(_tiles(large, docs, s))


def link(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = reliable_checkpoint(docs.mapInArrow(lambda b: K.freed(_sketch(b, s.width)), _SKETCH))
    linkable = sketches.where(F.col("cls").isNotNull() & F.col("doc_id").isNotNull())
    # Equal sets: one representative for each.
    # (Written out, so that the join has its own exchange on both sides and a hot class can be split.)
    classes = reliable_checkpoint(linkable.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
                                  .where("rep < last").select("cls", "rep"))
    rows = reliable_checkpoint(sketches.select("doc_id", "n_shingles", "cls").join(classes, "cls", "left")
                               .select("doc_id", "n_shingles", "cls", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("node")))
    # A document is left out for one text only: a repeated id may have another text of its own.
    copies = rows.where(F.col("doc_id") != F.col("node")).select("doc_id", "cls")
    reps = linkable.join(bounded_broadcast(copies), ["doc_id", "cls"], "left_anti")
    # Texts of one id are one document: their classes are linked through the id.
    several = rows.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("doc_id")
    same_id = rows.where(F.col("doc_id") != F.col("node")).join(bounded_broadcast(several), "doc_id", "left_semi").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct()
    keys = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = reliable_checkpoint(keys.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last"))
                                  .where("pivot < last").select("key", "pivot"))
    members = reliable_checkpoint(keys.join(buckets, "key"))
    # Step 1: one pivot for each member.
    shared = members.where(F.col("doc_id") != F.col("pivot")).groupBy("doc_id", "pivot").agg(F.count("*").alias("n"))
    tried = reliable_checkpoint(shared.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("pivot")).alias("p"))).alias("best"))
                                .select((-F.col("best.p")).alias("a"), F.col("doc_id").alias("b")))
    found = verified(reliable_checkpoint(estimated(tried, sketches, s)), docs, s)
    labels = components(found.union(same_id))
    # Step 2: what is left between components; links there join whole components.
    more = _second_step(members.select("key", "doc_id"), labels, tried, sketches, docs, s)
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    joined = reliable_checkpoint(more.join(of("a"), "a", "left").join(of("b"), "b", "left")
                                 .select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).distinct())
    if not joined.isEmpty():
        merged = components(joined).select(F.col("node").alias("label"), F.col("label").alias("merged"))
        ends = joined.select(F.col("a").alias("node")).union(joined.select("b")).distinct()
        known = labels.union(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
        labels = reliable_checkpoint(known.join(merged, "label", "left").select("node", F.coalesce("merged", "label").alias("label")))
    component = F.coalesce(F.col("label"), rows["node"])
    return rows.join(labels, "node", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns."""
    gone = reliable_checkpoint(link(docs, s).where(~F.col("kept")).select("doc_id").distinct())
    return docs.join(bounded_broadcast(gone), "doc_id", "left_anti").select(docs.columns)


@registry.query("op3_near_dedup", sql=r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS root FROM g UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, coalesce(c.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""")
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents", "doc_id", "text"), Settings(width=2))
