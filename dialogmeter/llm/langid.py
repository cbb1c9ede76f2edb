"""Operator 2: language identification.

Sparse multinomial logistic regression on TF-IDF weighted character 1- to 3-grams, trained with
follow-the-regularised-leader and elastic-net penalties, then calibrated by one temperature.

Document frequencies cover all training rows; the weights are fitted on at most ``fit_rows`` of
them, a fifth of which is kept for the temperature. Every text is predicted from all its
characters. A null text or one without a letter is ``und`` with score 1. Rows with a null
language or null text don't train; without any training row every text is ``und`` with score 0.
A training id that stands for so many rows that they reach beyond the bound is left out of the fit.
Texts of any length are read whole. Other columns of the table don't matter; repeated rows are
predicted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialogmeter.llm.chargrams import grams, in_fold, map_texts
from dialogmeter.llm.store import ship, stored

SIZES, BITS = (1, 2, 3), 16
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x n-grams
    constants: np.ndarray
    temperature: float


def tf_idf(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram numbers and unit-length weights (1 + log count) * idf."""
    found, counts = grams(text, SIZES, BITS)
    values = (1 + np.log(counts)) * idf[found]
    return found, values / max(np.sqrt((values**2).sum()), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, n_columns: int, alpha: float = 0.5,
               beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and constants after ``epochs`` passes of per-coordinate FTRL-proximal steps."""
    z, n = np.zeros((classes, n_columns + 1)), np.zeros((classes, n_columns + 1))

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for found, values, y in rows:
            at, x = np.append(found, n_columns), np.append(values, 1.0)
            part_z, part_n = z[:, at], n[:, at]
            w = weight(part_z, part_n)
            error = softmax(w @ x)
            error[y] -= 1
            g = error[:, None] * x
            grown = part_n + g * g
            z[:, at] = part_z + g - (np.sqrt(grown) - np.sqrt(part_n)) / alpha * w
            n[:, at] = grown
    w = weight(z, n)
    return w[:, :-1], w[:, -1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by bracketing on a log scale."""
    def loss(log_t: float) -> float:
        z = logits / math.exp(log_t)
        z = z - z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]))

    low, high = math.log(0.02), math.log(20)
    for _ in range(60):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, documents with each n-gram) over all rows; at most 2**BITS counts reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                total[grams(t.as_py(), SIZES, BITS)[0]] += 1
            rows += batch.num_rows
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(total[found], rows))], ["g", "n"])

    ship(texts.sparkSession)
    got = texts.select("text").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << BITS)
    known = got[got.g >= 0]
    counts[known.g.to_numpy()] = known.n.to_numpy()
    return int(got[got.g < 0].n.sum()), counts


def fit(spark: SparkSession, docs: DataFrame, fit_rows: int = 3000, seed: int = 2) -> LanguageModel | None:
    """Train on the rows outside the held-out fold; None when there are none."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~in_fold(F.col("doc_id")))
    n, frequency = document_frequencies(usable)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + frequency)) + 1
    # The same number of rows of each language, fit_rows in all, so rare languages are learned too.
    languages = sorted(r.lang for r in usable.select("lang").distinct().collect())
    each = max(1, fit_rows // len(languages))
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    # One pass: each task keeps the first rows of each language only. An id whose rows reach beyond the
    # bound is left out with all of them, so the ids chosen stand for fit_rows rows at most.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    first = usable.select("doc_id", "lang").withColumn("place", place).where(F.col("place") <= each + 1)
    first = stored(first, "language-sample", narrow=True)
    beyond = first.where(F.col("place") > each).select("doc_id", "lang")
    chosen = first.select("doc_id", "lang").distinct().join(beyond, ["doc_id", "lang"], "left_anti")
    texts = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    sent = spark.sparkContext.broadcast(idf)

    def features(text: str | None) -> tuple:
        found, values = tf_idf(text, sent.value)
        return found.astype(np.int32), values.astype(np.float32)

    schema = T.StructType([
        T.StructField("o", T.LongType()), T.StructField("lang", T.StringType()),
        T.StructField("g", T.ArrayType(T.IntegerType())), T.StructField("v", T.ArrayType(T.FloatType())),
    ])
    got = map_texts(texts.withColumn("o", order), schema, features, ["o", "lang"]).toArrow()
    number = {v: i for i, v in enumerate(languages)}
    taken = np.argsort(got["o"].to_numpy(), kind="stable")
    rows = [(np.asarray(got["g"][int(i)].values), np.asarray(got["v"][int(i)].values, float), number[got["lang"][int(i)].as_py()])
            for i in taken]
    check = rows[::5] if len(rows) >= 10 * len(languages) else rows
    train = [r for i, r in enumerate(rows) if i % 5] if check is not rows else rows
    weights, constants = train_ftrl(train, len(languages), 1 << BITS)
    logits = np.array([weights[:, g] @ v + constants for g, v, _ in check])
    temperature = fit_temperature(logits, np.array([y for *_, y in check]))
    return LanguageModel(languages, idf, weights, constants, temperature)


def predict(spark: SparkSession, docs: DataFrame, fit_rows: int = 3000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    model = fit(spark, docs, fit_rows)
    shared = spark.sparkContext.broadcast(model)

    def each(text: str | None) -> tuple[str, float]:
        m = shared.value
        if not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 1.0
        if m is None:
            return UNKNOWN, 0.0
        found, values = tf_idf(text, m.idf)
        p = softmax((m.weights[:, found] @ values + m.constants) / m.temperature)
        best = int(p.argmax())
        return m.languages[best], float(p[best])

    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    ])
    return map_texts(docs.withColumn("held_out", in_fold(F.col("doc_id"))), schema, each, ["doc_id", "held_out"])
