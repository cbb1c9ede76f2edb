"""Scores of a slow model kept by key, so that a run that was interrupted goes on where it stopped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmeter.functions.combine import COMBINERS
from dialogmeter.operators.references import TextColumns
from dialogmeter.operators.scoring import key_digest, score, scorer, unused_name
from dialogmeter.session import landed

KEY = "score_key"


def _kept(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def score_stored(
    df: DataFrame, metric: str, path: str, mode: str = "ref", key: Sequence[str] = ("context", "model"),
    texts: TextColumns = TextColumns(), score_col: str = "score", steps: int = 16,
) -> DataFrame:
    """``df`` with its scores, those found below ``path`` and those that had to be computed.

    Rows are dealt by a digest of their key into ``steps`` steps. A step scores the keys that
    ``path`` has no score of and adds them in one commit, so what was committed before a run ended
    is never scored again, nor are the keys of an earlier, smaller table. ``path`` belongs to one
    metric and mode. Each key stands for one row; two rows with one key are an error.
    """
    spark = df.sparkSession
    columns = [c for c in scorer(metric).components if c in _components(mode)] + [score_col]
    step = F.pmod(F.xxhash64(KEY), F.lit(steps))
    keyed = df.withColumn(KEY, key_digest(key))
    known = _kept(spark, path)
    todo = keyed if known is None else keyed.join(known.select(KEY), KEY, "left_anti")
    # Written once by step, so that a step reads its own rows only.
    waiting = landed(todo.withColumn("score_step", step), "unscored", by="score_step")
    for at in [r.score_step for r in waiting.select("score_step").distinct().orderBy("score_step").collect()]:  # at most ``steps``
        rows = waiting.where(F.col("score_step") == at).drop("score_step")
        score(rows, metric, mode, texts, score_col).select(KEY, *columns).write.mode("append").parquet(path)
    known = _kept(spark, path)
    if known is None:
        return score(df, metric, mode, texts, score_col)  # no rows: only the columns
    copies = unused_name(df, "_copies")
    once = known.groupBy(KEY).agg(F.count(F.lit(1)).alias(copies), *[F.max(c).alias(c) for c in columns])
    single = F.when(F.col(copies) == 1, F.col(score_col)).otherwise(F.raise_error(F.lit("two rows share one key")).cast("double"))
    once = landed(once.withColumn(score_col, single).drop(copies), "scores")
    return keyed.drop(*columns).join(once, KEY, "left").drop(KEY)


def _components(mode: str) -> tuple[str, ...]:
    return ("ref_score", "context_score", "empty_score") if mode in COMBINERS else ()
