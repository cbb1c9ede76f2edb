"""The steps a user runs, from source files to reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmeter.operators import compare, pairwise, regression, ridge
from dialogmeter.operators.annotations import long_form, median_table, quality_columns
from dialogmeter.operators.correlation import correlation_matrix
from dialogmeter.operators.references import VOTE_TEXTS, TextColumns
from dialogmeter.operators.scoring import key_digest, score
from dialogmeter.sinks.tables import write_tsv
from dialogmeter.session import landed
from dialogmeter.sources.dialog_json import read_examples


def preprocess(spark: SparkSession, dataset: str, path: str, out: str | None = None, lines: bool = True) -> DataFrame:
    """Nested dialogue file to flat examples, optionally written."""
    return write_tsv(read_examples(spark, dataset, path, lines), out)


def score_examples(
    examples: DataFrame, metric: str, mode: str = "ref", texts: TextColumns = TextColumns(), out: str | None = None
) -> DataFrame:
    return write_tsv(score(examples, metric, mode, texts), out)


def correlate(
    scored: DataFrame, qualities: Sequence[str] | None = None, score_col: str = "score", nulls: str = "skip"
) -> DataFrame:
    """Regression of every rating's median on the score: one job for all ratings."""
    qualities = quality_columns(scored.columns) if qualities is None else qualities
    medians = median_table(scored, qualities, keep=[score_col])
    return regression.linear_regression(
        long_form(medians, qualities, keep=[score_col]), score_col, "rating", ["quality"], nulls
    )


def rating_correlation(scored: DataFrame, qualities: Sequence[str] | None = None) -> DataFrame:
    """Correlation of the median ratings with each other."""
    qualities = quality_columns(scored.columns) if qualities is None else qualities
    return correlation_matrix(median_table(scored, qualities), qualities)


def rating_lines(scored: DataFrame, qualities: Sequence[str] | None = None, score_col: str = "score") -> DataFrame:
    """Points and fitted line of every rating."""
    qualities = quality_columns(scored.columns) if qualities is None else qualities
    medians = median_table(scored, qualities, keep=[score_col])
    return regression.fitted_line(long_form(medians, qualities, keep=[score_col]), score_col, "rating", ["quality"])


def explain_overall(medians: DataFrame, key: Sequence[str], target: str = "overall", exact: bool = False) -> DataFrame:
    """Ridge fit of the overall rating on all the others; ``exact`` tests on exactly a quarter of the rows."""
    features = [c for c in medians.columns if c != target and c not in key]
    return ridge.ridge_parameters(medians, features, target, key, exact=exact)


def evaluate(
    examples: DataFrame, metric: str, mode: str = "ref", texts: TextColumns = TextColumns(),
    key: Sequence[str] = ("context", "model"), target: str = "overall", out: str | None = None,
) -> dict[str, DataFrame]:
    """Score examples and report on them: fits per rating, rating matrix, ridge parameters.

    Scores and median ratings are computed once into the shared folder; the three reports read
    that narrow table.
    """
    scored = score_examples(examples, metric, mode, texts, out)
    qualities = quality_columns(scored.columns)
    keyed = scored.withColumn("example_key", key_digest(key))
    medians = landed(median_table(keyed, qualities, keep=["example_key", "score"]), "medians")
    fits = regression.linear_regression(long_form(medians, qualities, keep=["score"]), "score", "rating", ["quality"])
    return {
        "fits": fits,
        "matrix": correlation_matrix(medians, qualities),
        "ridge": explain_overall(medians.drop("score"), ["example_key"], target),
    }


def vote_table(
    cat: pairwise.Catalog, dataset: str, ref_id: int | None = None, zero_wins: str = "null", out: str | None = None
) -> DataFrame:
    return write_tsv(pairwise.win_ratio_table(cat, dataset, ref_id, zero_wins), out)


def score_votes(votes: DataFrame, metric: str, mode: str = "ref", out: str | None = None) -> DataFrame:
    return write_tsv(score(votes, metric, mode, VOTE_TEXTS), out)


def correlate_votes(scored: DataFrame) -> DataFrame:
    """Win ratio regressed on the score, over rows that have both."""
    return regression.linear_regression(pairwise.scored_votes(scored), "score", "win_ratio")


def win_ratio_line(scored: DataFrame) -> DataFrame:
    """Points and fitted line of the win ratio against the score, over rows that have both."""
    return regression.fitted_line(pairwise.scored_votes(scored), "score", "win_ratio")


def compare_components(scored: DataFrame, components: Sequence[str]) -> DataFrame:
    """Each component score regressed on the combined score, for rows with a win ratio."""
    long = long_form(pairwise.scored_votes(scored), components, keep=["score"], name="component", value="part")
    return regression.linear_regression(long, "score", "part", ["component"])


def compare_metrics(
    tables: dict[str, DataFrame], pairs: Sequence[tuple[str, str]], key: Sequence[str] = ("context", "model"),
    text_key: Sequence[str] = ("context",), score_col: str | dict[str, str] = "score",
) -> DataFrame:
    """Metrics regressed on each other, over all rows and without the human answers."""
    wide = compare.metrics_side_by_side(tables, key, score_col, text_key)
    named = [(f"{x}_score", f"{y}_score") for x, y in pairs]
    scopes = {"all": None, "excl_human": compare.not_human()}
    return regression.pair_regressions(wide, named, scopes).withColumns(
        {c: F.regexp_replace(c, "_score$", "") for c in ("x_name", "y_name")}
    )


def metric_pair_lines(
    tables: dict[str, DataFrame], pairs: Sequence[tuple[str, str]], key: Sequence[str] = ("context", "model"),
    text_key: Sequence[str] = ("context",), score_col: str | dict[str, str] = "score",
) -> DataFrame:
    """Points and fitted lines of metrics against each other, with the model that gave the answer."""
    wide = compare.metrics_side_by_side(tables, key, score_col, text_key)
    named = [(f"{x}_score", f"{y}_score") for x, y in pairs]
    scopes = {"all": None, "excl_human": compare.not_human()}
    return regression.pair_lines(wide, named, scopes, keep=["model"]).withColumns(
        {c: F.regexp_replace(c, "_score$", "") for c in ("x_name", "y_name")}
    )
