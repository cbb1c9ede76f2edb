"""The operators' registered queries and, where SQL can express them, the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmeter.llm import (
    bpe_codec,
    exact_dedup,
    html_sst,
    langid,
    license_scan,
    lm_scoring,
    mixing,
    near_dedup,
    token_counts,
    topk,
    toxicity,
    turn_repair,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.withColumn("target", F.round("target", 6))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(spark, table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_sst.main_text(table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_texts(table(spark, sf_dir, "documents"), with_ids=False)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licences(spark, table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(spark, table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.damage_and_repair(table(spark, sf_dir, "conversations"))


LLM_QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_language_id, op3_topk, op4_html_main_text, op5_exact_dedup, op6_near_dedup, op7_bpe_codec,
        op8_license_scan, op9_token_counts, op10_toxicity, op11_lm_scoring, op12_whitening, op13_turn_repair,
    )
}
LLM_ORACLES: dict[str, str] = {"op1_mixing": mixing.SQL, "op3_topk": topk.SQL, "op5_exact_dedup": exact_dedup.SQL}
