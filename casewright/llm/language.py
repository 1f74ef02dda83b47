"""Language identification: nearest of several clustered centroids per language.

A text is the vector of its byte n-grams (n = 1 to 3, A-Z lower-cased, other
ASCII than letters as one blank), hashed to ``Settings.buckets``, weighted (1 + log tf) * idf and scaled to length 1.
The idf is counted over *all* training texts. Per language, spherical k-means
over at most ``Settings.sample_rows`` training texts (a documented bound) gives
``Settings.clusters`` unit centroids. A text gets the language of the centroid
with the largest cosine; its distance to that centroid rejects it where the
cosine is below the centroid's own floor (a low quantile of its members'
cosines, times a margin).

Learned are only text and lang of training rows; prediction reads text alone.
The model is (languages x clusters x buckets) floats, which bounds the
broadcast. Scoring is one scan of whole texts without a shuffle.

Edge cases: a null text or one without a letter is ``und`` with score 0 and
rejected. Equal cosines go to the language, then cluster, that sorts first.
Without any training row everything is ``und``. A null lang is never learned.
Repeated rows are treated alike. Extra columns pass through; a column that has
the name of an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm import kernels as K
from casewright.llm import labelled as L
from casewright.llm import registry
from casewright.llm.session import prepare, read
from casewright.operators.common import bounded_broadcast, reliable_checkpoint

UNKNOWN = "und"
#: Languages whose counts are broadcast at most.
LANGUAGES_MAX = 10_000


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the texts per language for the clusters; ``buckets`` the vector."""

    sample_rows: int = 1500
    buckets: int = 4096
    clusters: int = 4
    iterations: int = 15
    folds: int = 3
    held_out: int = 1
    floor_quantile: float = 0.001
    floor_margin: float = 0.8


# Letters stay (A-Z lower-cased, bytes of other scripts as they are); any other ASCII byte is a blank.
_LETTERS = np.array([ord(chr(b).lower()) if b > 0x7F or chr(b).isalpha() else 0x20 for b in range(256)], dtype=np.uint32)
_LETTERS[128:] = np.arange(128, 256)


def counts(data: np.ndarray, off: np.ndarray, buckets: int) -> np.ndarray:
    """(document, bucket) counts of byte n-grams of one chunk."""
    n_docs = len(off) - 1
    at, low = np.repeat(np.arange(n_docs, dtype=np.int64) * buckets, np.diff(off)), _LETTERS[data]
    word = (low != 0x20) | np.concatenate([[True], low[:-1] != 0x20])  # one blank at most between words
    at, low = at[word], low[word]
    found = np.zeros(n_docs * buckets, dtype=np.int64)
    gram = np.zeros(len(low), dtype=np.uint32)
    for n in (1, 2, 3):
        if len(low) < n:
            break
        gram = gram[:len(low) - n + 1] * np.uint32(257) + low[n - 1:] + np.uint32(1)
        inside = at[:len(gram)] == at[n - 1:]
        cell = ((gram * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(buckets)
        found += np.bincount((at[:len(gram)] + cell)[inside], minlength=len(found))
    return found.reshape(n_docs, buckets)


def unit_vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (np.log1p(found) * idf).astype(np.float32)
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, length, out=x, where=length > 0)


def _document_frequency(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    have, n = np.zeros(s.buckets, np.int64), 0
    for batch in batches:
        for lo, hi, data, off in K.chunks(batch.column("text")):
            have += (counts(data, off, s.buckets) > 0).sum(axis=0)
            n += hi - lo
    yield pa.RecordBatch.from_pydict({"bucket": pa.array([None, *range(s.buckets)], pa.int32()), "n": pa.array([n, *have.tolist()], pa.int64())})


def spherical_kmeans(x: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and each centroid's cosine floor."""
    # Seeds at even quantiles of the cosine to the mean: odd texts do not become clusters of their own.
    spread = np.argsort(x @ x.mean(axis=0), kind="stable")
    k = min(s.clusters, len(x))
    seeds = spread[((np.arange(k) + 0.5) * len(x) / k).astype(int)]
    centroids = x[seeds].copy()
    for _ in range(s.iterations):
        own = np.argmax(x @ centroids.T, axis=1)
        for k in range(len(centroids)):
            if (own == k).any():
                total = x[own == k].sum(axis=0)
                centroids[k] = total / max(np.sqrt(total @ total), 1e-12)
    cosine = x @ centroids.T
    own, best = np.argmax(cosine, axis=1), cosine.max(axis=1)
    floors = [np.quantile(best[own == k], s.floor_quantile) * s.floor_margin if (own == k).any() else 0.0 for k in range(len(centroids))]
    return centroids, np.array(floors)


def _cluster(rows: pd.DataFrame, idf: np.ndarray, s: Settings) -> pd.DataFrame:
    """Centroids of one language from its bounded sample."""
    column = pa.array(rows.sort_values(["rank", "text"])["text"], pa.string())
    x = np.concatenate([unit_vectors(counts(data, off, s.buckets), idf) for _, _, data, off in K.chunks(column)])
    centroids, floors = spherical_kmeans(x[(x != 0).any(axis=1)] if (x != 0).any() else x, s)
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "vector": [c.tolist() for c in centroids], "floor": floors})


@dataclass(frozen=True)
class Model:
    """Unit centroids, sorted by language, with their floors; idf by bucket."""

    languages: list[str]
    centroids: np.ndarray
    floors: np.ndarray
    idf: np.ndarray

    def nearest(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, cosine) of every text."""
        best, cosine = np.zeros(len(column), np.int64), np.zeros(len(column))
        for lo, hi, data, off in K.chunks(column):
            c = unit_vectors(counts(data, off, len(self.idf)), self.idf) @ self.centroids.T
            best[lo:hi], cosine[lo:hi] = np.argmax(c, axis=1), c.max(axis=1)
        return best, np.clip(cosine, 0.0, 1.0)


def fit(train: DataFrame, s: Settings = Settings()) -> Model | None:
    """Learn from ``train`` (doc_id, text, lang); rows with a null lang or text are left out."""
    train = (train.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
             .where(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    found = (train.select("text").mapInArrow(lambda b: _document_frequency(b, s), "bucket int, n long")
             .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    n = {r.bucket: r.n for r in found}
    if not n.get(None):
        return None
    idf = np.log((1 + n[None]) / (1 + np.array([n[b] for b in range(s.buckets)]))) + 1
    # A share of each language by the hash of the id leaves little more than the bound to be ranked.
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    sizes = bounded_broadcast(reliable_checkpoint(train.groupBy("lang").agg(F.count("*").alias("n"))), LANGUAGES_MAX)
    place = F.xxhash64(F.col("doc_id"), F.lit(7)) / 2.0 ** 64 + 0.5
    sample = (train.select("doc_id", "lang").join(sizes, "lang").withColumn("place", place)
              .where(F.col("place") <= (1.2 * s.sample_rows + 100) / F.col("n"))
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.sample_rows).select("doc_id", "lang", "rank"))
    # Bounded: sample_rows ids for each language.
    texts = train.join(F.broadcast(sample), ["doc_id", "lang"])
    rows = texts.groupBy("lang").applyInPandas(lambda x: _cluster(x, idf, s), "lang string, vector array<float>, floor double").collect()
    rows.sort(key=lambda r: (r.lang, r.vector))
    return Model([r.lang for r in rows], np.array([r.vector for r in rows], dtype=np.float32), np.array([r.floor for r in rows]), idf)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred, score (cosine, 0 to 1) and rejected."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True)})
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def predict(column: pa.Array) -> pa.Array:
        m = shipped.value
        best, cosine = m.nearest(column)
        return pa.StructArray.from_arrays([pa.array(np.array(m.languages, dtype=object)[best], pa.string()), pa.array(cosine), pa.array(cosine < m.floors[best])], ["lang", "score", "rejected"])

    text = F.col("text").cast("string")
    has_letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return (docs.withColumn("_found", predict(text))
            .withColumns({"lang_pred": F.when(has_letter, F.col("_found.lang")).otherwise(F.lit(UNKNOWN)),
                          "score": F.when(has_letter, F.col("_found.score")).otherwise(F.lit(0.0)),
                          "rejected": ~has_letter | F.col("_found.rejected")}).drop("_found"))


@registry.query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Settings()
    docs = read(prepare(spark), sf_dir, "documents", "doc_id", "text", "lang")
    held_out = L.fold("doc_id", s.folds) == s.held_out
    model = fit(docs.where(~held_out), s)
    return (identify(docs.select("doc_id", "text"), model).withColumn("held_out", held_out)
            .select("doc_id", "held_out", "lang_pred", "score", "rejected"))
