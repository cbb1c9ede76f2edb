"""A corpus from raw documents: toxic ones out, copies out, near copies out, sources mixed, texts encoded.

Each stage takes (spark, docs, sf_dir) and, but for the last, returns the columns of ``docs``.
Null texts are empty texts, an empty table gives an empty result, and columns beyond those of
``documents`` pass through all stages but the last. Texts of any length stay whole in every stage. Of
rows repeated with their id one stays; of equal texts the largest id, of near copies the smallest,
and a tie at a source's end is decided by size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialogmeter.llm import bpe_codec, exact_dedup, mixing, near_dedup, toxicity
from dialogmeter.llm.store import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below 0.5 by a classifier that learns from the labelled documents outside its held-out fold."""
    return toxicity.drop_toxic(spark, docs, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the smallest id, of each class of near copies."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out so that the sources meet their target weights."""
    return mixing.mix_documents(docs, _table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids, the text they decode to, and digests of both."""
    return bpe_codec.encode_texts(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe_encoding", encode),
]
#: The classifier, the similarity classes and the encoding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again by the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
