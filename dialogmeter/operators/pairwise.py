"""A/B votes: catalogue queries and the win-ratio table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmeter.functions.text import trim_prompt
from dialogmeter.operators.joins import pair_with_all
from dialogmeter.session import landed


@dataclass(frozen=True)
class Catalog:
    """The relational source.

    =====================  ==========================================================
    ``evaluation_dataset``  evalset_id, name
    ``dataset_text``        prompt_id, prompt_text, evaluationdataset_id
    ``model``               model_id, name, is_baseline
    ``baselines``           model_id, evaluationdataset_id
    ``model_response``      prompt_id, model_id, evaluationdataset_id, response_text
    ``ab_comparison``       prompt_id, model_1, model_2, value, mturk_run_id_id
    ``evaluation_run``      mturk_run_id
    =====================  ==========================================================
    """

    evaluation_dataset: DataFrame
    dataset_text: DataFrame
    model: DataFrame
    baselines: DataFrame
    model_response: DataFrame
    ab_comparison: DataFrame
    evaluation_run: DataFrame


def named_set(cat: Catalog, dataset: str) -> DataFrame:
    return cat.evaluation_dataset.where(F.col("name") == F.lit(dataset)).select("evalset_id")


def contexts(cat: Catalog, dataset: str) -> DataFrame:
    """Prompts of one evaluation set."""
    rows = cat.dataset_text.withColumnRenamed("evaluationdataset_id", "evalset_id")
    return rows.join(named_set(cat, dataset), "evalset_id").select("prompt_id", "prompt_text")


def prompt_ids(cat: Catalog, dataset: str) -> DataFrame:
    return contexts(cat, dataset).select("prompt_id")


def _reference_models(cat: Catalog, dataset: str) -> DataFrame:
    """Baseline models that belong to the set."""
    baselines = cat.baselines.withColumnRenamed("evaluationdataset_id", "evalset_id")
    chosen = baselines.join(named_set(cat, dataset), "evalset_id").select("model_id")
    models = cat.model.where("is_baseline < 3").select("model_id", F.col("name").alias("reference_name"))
    return models.join(chosen, "model_id")


def reference_answers(cat: Catalog, dataset: str) -> DataFrame:
    """Answers of the baseline models that belong to the set."""
    answers = cat.model_response.select("prompt_id", "model_id", "response_text")
    return answers.join(_reference_models(cat, dataset), "model_id").select(
        "prompt_id", F.col("model_id").alias("ref_id"), "reference_name", F.col("response_text").alias("reference_text")
    )


def first_reference_id(cat: Catalog, dataset: str) -> DataFrame:
    """The reference model used when none is named: the smallest id with an answer."""
    answering = cat.model_response.select("model_id").distinct()
    return answering.join(_reference_models(cat, dataset), "model_id").agg(F.min("model_id").alias("ref_id"))


def model_responses(cat: Catalog, dataset: str) -> DataFrame:
    """Distinct candidate answers given for the set by the models under test.

    The source query lists the baselines without joining them; behind its DISTINCT that only
    asks whether the table has a row at all, which is what is tested here.
    """
    models = cat.model.where("is_baseline > 2 or is_baseline = 0").select(
        "model_id", F.col("name").alias("model_name")
    )
    answers = cat.model_response.withColumnRenamed("evaluationdataset_id", "evalset_id")
    return (
        answers.join(named_set(cat, dataset), "evalset_id", "left_semi")
        .join(models, "model_id")
        .where(cat.baselines.select(F.lit(1)).exists())
        .select("prompt_id", "model_id", "model_name", F.col("response_text").alias("candidate_text"))
        .distinct()
    )


def answered_contexts(cat: Catalog, dataset: str) -> DataFrame:
    """Prompts that have a candidate answer at all."""
    answered = model_responses(cat, dataset).select("prompt_id").distinct()
    return contexts(cat, dataset).join(answered, "prompt_id", "left_semi")


def _votes_of_runs(cat: Catalog) -> DataFrame:
    runs = cat.evaluation_run.select(F.col("mturk_run_id").alias("mturk_run_id_id"), "mturk_run_id")
    return cat.ab_comparison.join(runs, "mturk_run_id_id")


def evaluations(cat: Catalog, dataset: str) -> DataFrame:
    """Votes of known runs on prompts of the set."""
    on_prompts = _votes_of_runs(cat).join(prompt_ids(cat, dataset), "prompt_id", "left_semi")
    return on_prompts.select("value", "model_1", "model_2", "prompt_id", "mturk_run_id")


def vote_counts(votes: DataFrame) -> DataFrame:
    """Equal votes as one row with their number ``n``.

    Combined map-side; a prompt keeps at most one row per pair of models and outcome.
    """
    return votes.groupBy("prompt_id", "model_1", "model_2", "value").agg(F.count(F.lit(1)).alias("n"))


def vote_sides(votes: DataFrame) -> DataFrame:
    """One row per counted vote and participating model, with ``won``; a model against itself counts once."""
    sides = votes.select(
        "prompt_id", "model_1", "model_2", "value", "n",
        F.explode(F.array_distinct(F.array("model_1", "model_2"))).alias("model_id"),
    ).where(F.col("model_id").isNotNull())
    first = F.col("model_1").eqNullSafe(F.col("model_id")) & (F.col("value") == 0)
    second = F.col("model_2").eqNullSafe(F.col("model_id")) & (F.col("value") == 1)
    return sides.select("prompt_id", "model_id", "value", "n", F.coalesce(first | second, F.lit(False)).alias("won"))


def win_ratio(votes: DataFrame, zero_wins: str = "null") -> DataFrame:
    """Wins, votes and their ratio per prompt and model.

    Every vote with a value counts, ties too. A model that never won has a null ratio by
    default; ``zero_wins="zero"`` gives 0 instead. Votes may come with their number ``n``.
    """
    if zero_wins not in ("null", "zero"):
        raise ValueError("zero_wins must be 'null' or 'zero'")
    counted = votes if "n" in votes.columns else votes.withColumn("n", F.lit(1).cast("bigint"))
    totals = vote_sides(counted).groupBy("prompt_id", "model_id").agg(
        F.sum(F.when(F.col("won"), F.col("n")).otherwise(0)).alias("wins"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("counts"),
    )
    wins = F.nullif(F.col("wins"), F.lit(0)) if zero_wins == "null" else F.col("wins")
    return totals.withColumn("win_ratio", wins / F.nullif(F.col("counts"), F.lit(0)))


def win_ratio_table(
    cat: Catalog, dataset: str, ref_id: int | None = None, zero_wins: str = "null"
) -> DataFrame:
    """Prompt, reference, candidate and win ratio for every prompt and model of a set.

    A prompt appears once per model even without an answer or a vote; several answers of one
    model to one prompt give several rows. The set's answers, references and counted votes are
    landed once; everything else is joined from those copies, so each table of the source is
    read once, and adaptive execution sees the copies' sizes and splits their skewed prompts.
    """
    # Answers of the models under test and of the references come from one reading of the answers.
    models = cat.model.select("model_id", "name", "is_baseline")
    chosen_sets = named_set(cat, dataset).withColumn("_in_set", F.lit(True))
    references = _reference_models(cat, dataset).groupBy(F.col("model_id").alias("_ref_model")).agg(F.count(F.lit(1)).cast("int").alias("times"))
    answers = (
        cat.model_response.withColumnRenamed("evaluationdataset_id", "evalset_id")
        .join(chosen_sets, "evalset_id", "left").join(models, "model_id")
        .join(references, F.col("model_id") == F.col("_ref_model"), "left")
    )
    tested = F.col("_in_set").isNotNull() & ((F.col("is_baseline") > 2) | (F.col("is_baseline") == 0))
    answers = landed(
        answers.select(
            "prompt_id", "model_id", "name", "response_text", tested.alias("tested"), F.coalesce("times", F.lit(0)).alias("times")
        ).where("tested or times > 0"),
        "answers",
    )
    responses = answers.where("tested").where(cat.baselines.select(F.lit(1)).exists()).select(
        "prompt_id", "model_id", F.col("name").alias("model_name"), F.col("response_text").alias("candidate_text")
    )
    responses = landed(responses.distinct(), "responses")
    wanted: Column
    if ref_id is None:
        wanted = answers.where("times > 0").agg(F.min("model_id")).scalar()
    else:
        wanted = F.lit(ref_id)
    # A model listed several times as the set's baseline is so often a reference.
    chosen = answers.where((F.col("times") > 0) & (F.col("model_id") == wanted))
    chosen = chosen.withColumn("_time", F.explode(F.sequence(F.lit(1), "times"))).select(
        "prompt_id", F.col("model_id").alias("ref_id"), F.col("name").alias("reference_name"), F.col("response_text").alias("reference_text")
    )
    answered = responses.select("prompt_id").distinct()
    prompts = contexts(cat, dataset).join(answered, "prompt_id", "left_semi")
    prompts = landed(prompts.withColumn("prompt_text", trim_prompt(F.col("prompt_text"), dataset)), "prompts")
    votes = vote_counts(_votes_of_runs(cat)).join(prompts.select("prompt_id"), "prompt_id", "left_semi")
    ratios = landed(win_ratio(votes, zero_wins), "ratios")
    # The grid holds ids only; the texts are joined to the finished rows.
    pair = ["prompt_id", "model_id"]
    grid = pair_with_all(prompts.select("prompt_id").distinct(), responses.select("model_id").distinct(), spread_by=["prompt_id"])
    silent = grid.join(responses.select(*pair), pair, "left_anti")
    # A model without an answer to a prompt has no name and text, and no id in the table either.
    rows = responses.withColumn("_answered", F.col("model_id")).unionByName(silent, allowMissingColumns=True)
    rows = rows.join(ratios, pair, "left")
    return rows.join(prompts.join(chosen, "prompt_id", "left"), "prompt_id").select(
        "prompt_id", "prompt_text", "ref_id", "reference_name", "reference_text",
        F.col("_answered").alias("model_id"), "model_name", "candidate_text", "win_ratio", "counts",
    )


def scored_votes(scored: DataFrame) -> DataFrame:
    """Rows that have both a score and a win ratio."""
    return scored.na.drop(subset=["score", "win_ratio"])
