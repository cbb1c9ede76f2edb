"""Operator 10: toxicity by a character n-gram linear classifier with naive Bayes feature scales.

Each distinct character 4- and 5-gram of a text is a feature. Its scale is the log ratio of its
smoothed document shares in toxic and in other labelled texts; a logistic regression with a
squared penalty is fitted on the scaled features.

The ratios count the labelled texts of the training folds, up to ``count_rows`` of them, and all n-grams are
features. The weights are fitted on at most ``fit_rows`` of these rows with ``fit_grams`` n-grams together. Both
are chosen by hashed id, and bounded so that labels go to the texts: texts are not shuffled.
Every text is scored whole. Rows without label, with a null label or a null text don't
train. Without both classes the score is the share of toxic labels (0 without labels). An empty
or null text gets the score of a text without known n-grams. A row repeated in ``labels`` or with
several labels counts once, as its largest label. Other columns of the tables don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmeter.llm.chargrams import bounded_sample, grams, in_fold
from dialogmeter.llm.store import ship, stored, worker_cache

SIZES, BITS = (4, 5), 20
#: Texts taken out of an Arrow batch at a time, and n-gram counts in a row.
ROWS, COUNTS = 100, 1 << 16
#: Steps that a regression makes at least.
STEPS = 800
#: Kinds of rows of the training pass: a sampled text, and n-gram counts of the other and of the toxic texts.
_TEXT, _OTHER, _TOXIC = 0, 1, 2


@dataclass(frozen=True)
class ToxicityModel:
    """The weight of each n-gram number, and the constant."""

    weights: np.ndarray
    constant: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(np.array([self.weights[grams(t, SIZES, BITS)[0]].sum() for t in texts]) + self.constant)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(starts: np.ndarray, columns: np.ndarray, scale: np.ndarray, y: np.ndarray, penalty: float, epochs: int | None = None,
                 batch: int = 128, seed: int = 10) -> tuple[np.ndarray, float]:
    """Weights (by column) and constant of a logistic regression on sparse rows, whose values are their columns' ``scale``.

    Row i has the columns ``columns[starts[i]:starts[i + 1]]``. A batch of rows at a time moves its columns
    by the gradient, each by the steps it has made before (Adagrad). ``penalty`` is on the squared weights.
    There are ``epochs`` passes, by default 12 or as many as make ``STEPS`` steps.
    """
    epochs = epochs or max(12, -(-STEPS * batch // max(1, len(y))))
    w, g = np.zeros(len(scale)), np.full(len(scale), 1e-8)
    c, gc = 0.0, 1e-8
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        order = random.permutation(len(y))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            sizes = starts[rows + 1] - starts[rows]
            own = columns[np.repeat(starts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            of = np.repeat(np.arange(len(rows)), sizes)
            error = (_sigmoid(np.bincount(of, scale[own] * w[own], len(rows)) + c) - y[rows]) / len(rows)
            touched, which = np.unique(own, return_inverse=True)
            grad = np.bincount(which, scale[own] * error[of], len(touched)) + penalty * w[touched]
            g[touched] += grad**2
            w[touched] -= 0.1 * grad / np.sqrt(g[touched])
            gc += error.sum() ** 2
            c -= 0.1 * error.sum() / np.sqrt(gc)
    return w, float(c)


def _training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int, seed: int, count_rows: int = 200_000) -> DataFrame:
    """kind, g, n, y, at: n-gram counts by class of the labelled training texts, and the n-grams of sampled ones in the order of ``at``."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    marks = stored(bounded_sample(marks.where(~in_fold(F.col("doc_id"))), "doc_id", count_rows, seed), "toxic-marks", narrow=True)
    # count_rows and fit_rows ids are proven bounds for the broadcasts.
    chosen = F.broadcast(bounded_sample(marks.select("doc_id"), "doc_id", fit_rows, seed).select(F.col("doc_id").alias("c_id")))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    texts = texts.join(chosen, texts["doc_id"] == chosen["c_id"], "left")
    names = ["kind", "g", "n", "y", "at"]
    kinds = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        counts, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                text, y, at = (c.to_pylist() for c in batch.slice(first, ROWS).columns)
                picked = []
                for t, toxic, place in zip(text, y, at, strict=True):
                    found = grams(t, SIZES, BITS)[0]
                    counts[int(toxic == 1)][found] += 1
                    rows[int(toxic == 1)] += 1
                    if place is not None:
                        picked.append((_TEXT, found.astype(np.int32), None, int(toxic == 1), place))
                if picked:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*picked, strict=True), kinds, strict=True)], names)
        for toxic, kind in enumerate((_OTHER, _TOXIC)):
            # The number of texts comes under the number -1.
            found = np.flatnonzero(counts[toxic])
            g, n = np.append(-1, found).astype(np.int32), np.append(rows[toxic], counts[toxic][found])
            for first in range(0, len(g) if rows[toxic] else 0, COUNTS):
                row = (kind, g[first : first + COUNTS], n[first : first + COUNTS], None, None)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    order = F.when(F.col("c_id").isNotNull(), F.xxhash64("doc_id", F.lit(seed)))
    made = texts.select("text", "y", order.alias("at")).mapInArrow(run, "kind int, g array<int>, n array<bigint>, y int, at bigint")
    return stored(made, "toxic-grams")


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, fit_grams: int = 12_000_000,
        count_rows: int = 200_000, smoothing: float = 1.0, penalty: float = 1e-3, seed: int = 10) -> ToxicityModel:
    """Train on labelled rows outside the held-out fold."""
    ship(spark)
    rows = _training_rows(docs, labels, fit_rows, seed, count_rows)
    pairs = rows.where(F.col("kind") > _TEXT).select("kind", F.explode(F.arrays_zip("g", "n")).alias("x"))
    toxic = F.col("kind") == _TOXIC
    # At most 2**BITS + 1 rows of three numbers.
    counts = pairs.groupBy(F.col("x.g").alias("g")).agg(
        F.coalesce(F.sum(F.when(~toxic, F.col("x.n"))), F.lit(0)).alias("other"), F.coalesce(F.sum(F.when(toxic, F.col("x.n"))), F.lit(0)).alias("toxic")).toArrow()
    g, other, bad = (counts.column(c).to_numpy() for c in ("g", "other", "toxic"))
    negative, positive = (int(n[g == -1].sum()) for n in (other, bad))
    weights = np.zeros(1 << BITS)
    if not positive or not negative:
        share = positive / max(1, positive + negative)
        return ToxicityModel(weights, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    known = g >= 0
    scale = np.zeros(1 << BITS)
    scale[g[known]] = np.log((bad[known] + smoothing) / (positive + 2 * smoothing)) - np.log((other[known] + smoothing) / (negative + 2 * smoothing))
    # A row of two numbers per sampled text tells how many of them are within the bound.
    sizes = sorted((r.at, r.n) for r in rows.where(F.col("kind") == _TEXT).select("at", F.size("g").alias("n")).collect())
    total, last = 0, None
    for at, n in sizes[:fit_rows]:
        total += n
        if last is not None and total > fit_grams:
            break
        last = at
    if last is None:
        return ToxicityModel(weights, float(np.log(positive / negative)))
    sample = rows.where((F.col("kind") == _TEXT) & (F.col("at") <= last)).select("at", "y", "g").toArrow().combine_chunks()
    listed = sample.column("g").combine_chunks()
    order = np.lexsort((listed.value_lengths().to_numpy(), sample.column("at").to_numpy()))  # whatever the tasks' order
    listed, y = listed.take(pa.array(order)), sample.column("y").to_numpy()[order].astype(float)
    starts = np.append(0, np.cumsum(listed.value_lengths().to_numpy())).astype(np.int64)
    w, c = fit_logistic(starts, listed.flatten().to_numpy(), scale, y, penalty)
    return ToxicityModel(w * scale, c)


def scored_by(spark: SparkSession, model: ToxicityModel) -> Callable[[str], Column]:
    """The score of a text column: only texts go to Python, and a number comes back."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_cache("toxicity")
        for texts in batches:
            parts = [shared.value.scores(texts.slice(at, ROWS).to_pylist()) for at in range(0, len(texts), ROWS)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return run


def predict(spark: SparkSession, docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    score = scored_by(spark, fit(spark, docs, labels, fit_rows))
    scored = docs.select("doc_id", score("text").alias("score"))
    return scored.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, source: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``limit``; the model learns from ``source`` and ``labels``."""
    return docs.where(scored_by(spark, fit(spark, source, labels))("text") < limit)
