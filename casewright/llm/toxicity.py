"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its words (A-Z lower-cased, cut at white space and ASCII
punctuation), its word pairs and its pairs that skip one word, hashed to
2^``Settings.bits`` coordinates, each distinct one with value 1. Training is FTRL-proximal with
a learning rate per coordinate; the L1 term sets most weights to exactly 0,
so the model is a short sorted table that is broadcast by its known bound. The
fit holds two numbers for each coordinate and the sample's coordinates as
32-bit numbers (about 64 MB and 7 KB a row of usual length), whatever the corpus.

Training reads at most ``Settings.sample_rows`` labelled rows of the training
fold (a documented bound; the sample is chosen by a hash of the id). Scoring
reads every whole text in one scan without a shuffle.

Edge cases: null text, empty text and text without words have no feature and
score sigmoid(bias). With no labelled row, or one class only, the model is
the smoothed log odds of the labels seen (0.0 with none) and no weights.
Repeated rows are scored alike. Extra columns pass through; a column that has
the name of an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import kernels as K
from casewright.llm import labelled as L
from casewright.llm import registry
from casewright.llm.session import prepare, read

#: Word ends: white space, control characters and ASCII punctuation.
SEPARATORS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows used to fit; the rest are FTRL's own parameters.
    ``l1`` holds for a full sample and shrinks with the root of the share that there is."""

    sample_rows: int = 16000
    bits: int = 22
    folds: int = 5
    threshold: float = 0.5
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.0
    epochs: int = 3


def features(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, document) of words, word pairs and pairs with one word between; repeats included."""
    words, doc = K.word_hashes(data, off, SEPARATORS)
    parts = [(words, doc), K.ngram_hashes(words, doc, 2), K.ngram_hashes(words, doc, 2, skip=1)]
    fold = K.U64(64 - bits)
    return np.concatenate([(p[0] >> fold).astype(np.int32) for p in parts]), np.concatenate([p[1] for p in parts])


def _feature_rows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(label, features) of each sampled text, features distinct and sorted."""
    for batch in batches:
        for lo, hi, data, off in K.chunks(batch.column("text")):
            feats, doc = features(data, off, bits)
            order = np.argsort(doc, kind="stable")
            feats, ends = feats[order], np.searchsorted(doc[order], np.arange(1, hi - lo))
            lists = [np.unique(x) for x in np.split(feats, ends)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(lo, hi - lo), "label": batch.column("label").slice(lo, hi - lo),
                "features": pa.array(lists, pa.list_(pa.int32()))})


def ftrl(rows: list[np.ndarray], labels: np.ndarray, n_features: int, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias after ``s.epochs`` passes in the given order of rows."""
    z, n = np.zeros(n_features), np.zeros(n_features)
    l1 = s.l1 * min(1.0, len(rows) / s.sample_rows) ** 0.5
    positive = labels.mean()
    bias, bias_n = float(np.log(positive / (1 - positive))), 0.0

    def weight(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for idx, y in zip(rows, labels, strict=True):
            zi, ni = z[idx], n[idx]
            w = weight(zi, ni)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha
            z[idx], n[idx] = zi + g - sigma * w, ni + g * g
            bias_n += g * g
            bias -= s.alpha * g / (s.beta + np.sqrt(bias_n))
    return weight(z, n), bias


def _fit(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """One task over the bounded sample: rows (feature, weight); the bias has no feature."""
    ids, labels, rows = [], [], []
    for batch in batches:
        column = batch.column("features")
        flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
        rows += [flat[a:b] for a, b in zip(ends, ends[1:])]
        ids.append(batch.column("doc_id").to_numpy().copy())
        labels.append(batch.column("label").to_numpy().copy())
    if not rows or len(set(np.concatenate(labels))) < 2:
        toxic, n = (np.concatenate(labels).sum(), len(rows)) if rows else (0, 0)
        weights, bias = np.zeros(0), float(np.log((toxic + 1) / (n - toxic + 1)))
    else:
        order = np.argsort(K.mix(np.concatenate(ids).view(np.uint64)), kind="stable")
        weights, bias = ftrl([rows[i] for i in order], np.concatenate(labels)[order].astype(float), 1 << s.bits, s)
    used = np.flatnonzero(weights)
    yield pa.RecordBatch.from_pydict({
        "feature": pa.array([None, *used.tolist()], pa.int32()), "weight": pa.array([bias, *weights[used].tolist()], pa.float64())})


@dataclass(frozen=True)
class Model:
    """Sorted coordinates with their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int

    def margins(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        if not len(self.features):
            return out
        weighted = np.zeros(1 << self.bits, dtype=bool)
        weighted[self.features] = True
        for lo, _, data, off in K.chunks(column):
            feats, doc = features(data, off, self.bits)
            hit = np.flatnonzero(weighted[feats])
            at = np.searchsorted(self.features, feats[hit])
            pairs = np.unique(doc[hit].astype(np.int64) * len(self.features) + at)
            np.add.at(out, lo + pairs // len(self.features), self.weights[pairs % len(self.features)])
        return out


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Train on the bounded sample of ``labels`` (doc_id, label); the model is at most the
    features of that sample, in practice a few hundred weights."""
    sample = L.bounded_sample(labels, s.sample_rows)
    rows = (L.with_text(docs, sample).select(F.col("doc_id").cast("long"), "label", F.col("text").cast("string"))
            .mapInArrow(lambda b: K.freed(_feature_rows(b, s.bits)), "doc_id long, label int, features array<int>"))
    weights = rows.repartition(1).mapInArrow(lambda b: K.freed(_fit(b, s)), "feature int, weight double").collect()
    table = sorted((r.feature, r.weight) for r in weights if r.feature is not None)
    bias = next((r.weight for r in weights if r.feature is None), 0.0)
    return Model(np.array([f for f, _ in table], dtype=np.int64), np.array([w for _, w in table]), bias, s.bits)


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """Probability between 0 and 1 that a text is toxic."""
    shipped = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from K.freed(pa.array(1.0 / (1.0 + np.exp(-np.clip(shipped.value.margins(x), -35, 35)))) for x in columns)

    return probability(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), train_docs: DataFrame | None = None) -> DataFrame:
    """``docs`` with (held_out, score, predicted). ``labels`` has doc_id and toxic; the training
    texts come from ``train_docs`` where given, else from ``docs``."""
    spark = prepare(docs.sparkSession)
    model = fit(docs if train_docs is None else train_docs, L.training_labels(labels, "toxic", s.folds), s)
    return (docs.withColumn("score", score(spark, model, F.col("text")))
            .withColumn("held_out", L.fold("doc_id", s.folds) == 0)
            .withColumn("predicted", (F.col("score") >= s.threshold).cast("int")))


@registry.query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return classify(docs, read(spark, sf_dir, "labels", "doc_id", "toxic")).select("doc_id", "held_out", "score", "predicted")
