"""Quality classifier: naive-Bayes support vectors.

A text is the set of its n-grams (words cut at white space and word pairs, A-Z
lower-cased; one word two to eight times in a row as a typed n-gram whatever
the word; runs of three bytes), hashed to ``Settings.buckets`` indicators. Each indicator is scaled by
the class log-count ratio r = log((a + pos) / |pos|) - log((a + neg) / |neg|),
with the document counts taken over the labelled rows of the training fold: all
of them up to ``Settings.count_rows``, beyond that a uniform sample of so many (a
documented bound, so that the labels can be broadcast and no text is shuffled).
The scaled vector has length 1. A linear hinge-loss model is then fitted by
dual coordinate descent on at most ``Settings.sample_rows`` rows of that fold
(a documented bound), and its margins become probabilities by a sigmoid whose
two parameters are fitted on margins of rows left out of the fit.

The counts are one aggregate with at most ``buckets`` rows, so the model is
a fixed-size array that is broadcast. Scoring reads every whole text in one
scan without a shuffle; a task holds one chunk of texts.

Edge cases: null text, empty text and text without words have no indicator
and get the score of a zero margin. With no labelled row or one class only
every score is the smoothed share of label 1 (0.5 with no row). Repeated rows
are scored alike. Extra columns pass through; a column that has the name of an
added one is replaced.
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

#: Typed n-grams of a repeated word go up to this n.
LONGEST_REPEAT = 8


@dataclass(frozen=True)
class Settings:
    """``count_rows`` bounds the rows of the class counts, ``sample_rows`` those of the margin
    fit; ``buckets`` is the number of indicators."""

    count_rows: int = 500_000
    sample_rows: int = 10000
    buckets: int = 1 << 16
    folds: int = 5
    threshold: float = 0.3
    smoothing: float = 1.0
    cost: float = 1.0
    epochs: int = 10


def indicators(data: np.ndarray, off: np.ndarray, buckets: int) -> np.ndarray:
    """Boolean matrix (document, indicator) of one chunk."""
    words, doc = K.word_hashes(data, off)
    parts = [(words, doc), K.ngram_hashes(words, doc, 2)]
    if len(words) > 1:
        again = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        at = doc[1:]
        for n in range(2, LONGEST_REPEAT + 1):  # one word n times in a row, whatever the word
            parts.append((np.full(again.sum(), n << 16, np.uint64), at[again]))
            again, at = again[:-1] & again[1:][:len(again) - 1], at[1:]
    if len(data) > 2:
        three = data[:-2].astype(np.uint64) << np.uint64(16) | data[1:-1].astype(np.uint64) << np.uint64(8) | data[2:]
        at = np.repeat(np.arange(len(off) - 1), np.diff(off))
        inside = at[:-2] == at[2:]
        parts.append((K.mix(three[inside] + np.uint64(1 << 40)), at[:-2][inside]))
    out = np.zeros((len(off) - 1) * buckets, dtype=bool)
    for h, d in parts:
        out[d * buckets + (h >> np.uint64(16)).astype(np.int64) % buckets] = True
    return out.reshape(-1, buckets)


def _count(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have each indicator, and (bucket null) documents of each class."""
    have, n = np.zeros((2, s.buckets), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        labels = batch.column("label").to_numpy()
        for lo, hi, data, off in K.chunks(batch.column("text")):
            found, y = indicators(data, off, s.buckets), labels[lo:hi]
            for k in (0, 1):
                have[k] += found[y == k].sum(axis=0)
                n[k] += (y == k).sum()
    used = np.flatnonzero(have.sum(axis=0))
    yield pa.RecordBatch.from_pydict({"bucket": pa.array([None, *used.tolist()], pa.int32()),
                                      "neg": pa.array([n[0], *have[0, used]], pa.int64()),
                                      "pos": pa.array([n[1], *have[1, used]], pa.int64())})


def _sample_rows(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, off in K.chunks(batch.column("text")):
            found = indicators(data, off, s.buckets)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(lo, hi - lo), "label": batch.column("label").slice(lo, hi - lo),
                "used": pa.array([np.flatnonzero(x).astype(np.int32) for x in found], pa.list_(pa.int32()))})


def _unit(used: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    x = ratio[used]
    length = np.sqrt((x * x).sum())
    return x / length if length else x


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Weights (over unit vectors) and bias of min |w|^2 / 2 + C sum max(0, 1 - y (wx + b))."""
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    values = [_unit(u, ratio) for u in rows]
    # Each class has the same total cost, so that a rare label still counts.
    cost = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9)) * s.cost
    rng = np.random.default_rng(7)
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            u, x = rows[i], values[i]
            gradient = y[i] * (w[u] @ x + bias) - 1
            step = min(max(alpha[i] - gradient / (x @ x + 1), 0.0), cost[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[u] += step * y[i] * x
                bias += step * y[i]
    return w, bias


def sigmoid_fit(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(a, b) of sigmoid(a m + b) by Newton steps on the log loss, targets smoothed."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([margin, np.ones_like(margin)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        hessian = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(hessian, x.T @ (p - target))
        beta -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _fit(batches: Iterator[pa.RecordBatch], ratio: np.ndarray, s: Settings) -> Iterator[pa.RecordBatch]:
    """One task over the bounded sample: (weights, bias, slope, offset)."""
    rows, labels, ids = [], [], []
    for batch in batches:
        column = batch.column("used")
        flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
        rows += [flat[a:b] for a, b in zip(ends, ends[1:])]
        labels.append(batch.column("label").to_numpy())
        ids.append(batch.column("doc_id").to_numpy())
    label = np.concatenate(labels) if rows else np.zeros(0, int)
    if len(set(label)) < 2:
        share = (label.sum() + 1) / (len(label) + 2)
        w, bias, slope, offset = np.zeros(len(ratio)), 0.0, 0.0, float(np.log(share / (1 - share)))
    else:
        order = np.argsort(K.mix(np.concatenate(ids).view(np.uint64)), kind="stable")
        rows, label = [rows[i] for i in order], label[order].astype(float)
        y, margin = 2 * label - 1, np.zeros(len(rows))
        for part in (0, 1, 2):  # margins of each third by a fit on the others
            out = np.arange(len(rows)) % 3 == part
            keep = np.flatnonzero(~out)
            wk, bk = dual_coordinate_descent([rows[i] for i in keep], y[keep], ratio, s)
            for i in np.flatnonzero(out):
                margin[i] = wk[rows[i]] @ _unit(rows[i], ratio) + bk
        slope, offset = sigmoid_fit(margin, label)
        w, bias = dual_coordinate_descent(rows, y, ratio, s)
    yield pa.RecordBatch.from_pydict({"weights": pa.array([w], pa.list_(pa.float64())), "bias": [bias], "slope": [slope], "offset": [offset]})


@dataclass(frozen=True)
class Model:
    """Log-count ratios and weights by bucket, and the sigmoid of the margin."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, column: pa.Array) -> np.ndarray:
        margin = np.full(len(column), self.bias)
        both = np.stack([self.ratio * self.weights, self.ratio ** 2], axis=1)
        for lo, _, data, off in K.chunks(column):
            for i, found in enumerate(indicators(data, off, len(self.ratio))):
                dot, square = both[np.flatnonzero(found)].sum(axis=0)
                margin[lo + i] += dot / np.sqrt(square) if square else 0.0
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Class counts, then the margin fit on the bounded sample."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = (L.with_text(texts, L.bounded_sample(labels, s.count_rows)).select("label", "text")
              .mapInArrow(lambda b: _count(b, s), "bucket int, neg long, pos long")
              .groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).collect())
    have, n = np.zeros((2, s.buckets)), np.zeros(2)
    for r in counts:
        if r.bucket is None:
            n[:] = r.neg, r.pos
        else:
            have[:, r.bucket] = r.neg, r.pos
    ratio = np.log((have[1] + s.smoothing) / (n[1] + 2 * s.smoothing)) - np.log((have[0] + s.smoothing) / (n[0] + 2 * s.smoothing))
    ratio[have.sum(axis=0) == 0] = 0.0
    sample = L.with_text(texts, L.bounded_sample(labels, s.sample_rows))
    fitted = (sample.mapInArrow(lambda b: _sample_rows(b, s), "doc_id long, label int, used array<int>")
              .repartition(1).mapInArrow(lambda b: _fit(b, ratio, s), "weights array<double>, bias double, slope double, offset double").first())
    return Model(ratio, np.array(fitted.weights), fitted.bias, fitted.slope, fitted.offset)


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """Probability between 0 and 1 that a text has label 1."""
    shipped = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(column: pa.Array) -> pa.Array:
        return pa.array(shipped.value.scores(column))

    return probability(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), train_docs: DataFrame | None = None) -> DataFrame:
    """``docs`` with (held_out, score, predicted). ``labels`` has doc_id and quality; the training
    texts come from ``train_docs`` where given, else from ``docs``."""
    spark = prepare(docs.sparkSession)
    model = fit(docs if train_docs is None else train_docs, L.training_labels(labels, "quality", s.folds), s)
    return (docs.withColumn("score", score(spark, model, F.col("text")))
            .withColumn("held_out", L.fold("doc_id", s.folds) == 0)
            .withColumn("predicted", (F.col("score") >= s.threshold).cast("int")))


@registry.query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return classify(docs, read(spark, sf_dir, "labels", "doc_id", "quality")).select("doc_id", "held_out", "score", "predicted")
