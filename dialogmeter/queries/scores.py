"""Scoring: token counts, brevity penalty in all reference modes, batch scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmeter.functions.tokens import penalty_from_counts, token_count
from dialogmeter.operators.dialogs import prompt_lengths
from dialogmeter.operators.references import MODES, SINGLE_MODES, TextColumns, with_references
from dialogmeter.operators.scoring import attach_scores, score
from dialogmeter.operators.stored_scores import score_stored
from dialogmeter.queries import overlap, sqltext
from dialogmeter.queries.registry import query
from dialogmeter.queries.views import EXAMPLES_SQL, KEY, examples, last_examples
from dialogmeter.session import landed, new_scratch_path

COUNTS_SQL = EXAMPLES_SQL + f""",
cnt as (select *, {sqltext.token_count('cand')} as c, {sqltext.token_count('ref')} as r,
  {sqltext.token_count(sqltext.last_line('context'))} as x, {sqltext.token_count('context')} as whole from ex)
"""
_BP_REF, _BP_CTX = sqltext.penalty("c", "r"), sqltext.penalty("c", "x")
_NEAREST = """case when r is null then x when abs(r - c) < abs(x - c) then r when abs(r - c) > abs(x - c) then x else least(r, x) end"""

WORDS_SQL = EXAMPLES_SQL + f""",
bags as (select *, {overlap.sql_words('cand')} as wc, {overlap.sql_words('ref')} as wr,
  {overlap.sql_words(sqltext.last_line('context'))} as wx from ex),
f1 as (select conv_id, turn, model, context, cand,
  case when ref is null then null else {overlap.sql_f1('wc', 'wr')} end as ref_score,
  {overlap.sql_f1('wc', 'wx')} as context_score, 0.0 as empty_score from bags)
"""
# Mean of the components that are there, for the three- and the two-component form.
MEAN3 = "(coalesce(ref_score, 0) + context_score + empty_score) / (2 + cast(ref_score is not null as integer))"


def _scores(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*KEY, *[F.round(c, 6).alias(c) for c in columns])


@query(
    "q_token_count",
    f"select doc_id, {sqltext.token_count('text')} as n_tokens from documents",
)
def count_tokens(spark: SparkSession, sf_dir: str):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", token_count(F.col("text")).cast("bigint").alias("n_tokens")
    )


@query("q_bp_single", f"with {COUNTS_SQL} select conv_id, turn, round({_BP_REF}, 6) as score from cnt")
def bp_single(spark, sf_dir):
    return _scores(score(last_examples(spark, sf_dir), "bleu", "ref"), "score")


@query("q_bp_context_last", f"with {COUNTS_SQL} select conv_id, turn, round({_BP_CTX}, 6) as score from cnt")
def bp_context_last(spark, sf_dir):
    return _scores(score(last_examples(spark, sf_dir), "bleu", "context_last"), "score")


@query("q_bp_whole_prompt", f"with {COUNTS_SQL} select conv_id, turn, round({sqltext.penalty('c', 'whole')}, 6) as score from cnt")
def bp_whole_prompt(spark, sf_dir):
    # The prompts are counted turn by turn; no prompt is put together as text.
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    replies = turns.where("role = 'assistant'").select(*KEY)
    lengths = prompt_lengths(turns).where("context_tokens is not null").join(replies, KEY, "left_semi")
    return _scores(lengths.withColumn("score", penalty_from_counts(F.col("tokens"), F.col("context_tokens"))), "score")


@query("q_bp_whole_prompt_text", f"with {COUNTS_SQL} select conv_id, turn, round({sqltext.penalty('c', 'whole')}, 6) as score from cnt")
def bp_whole_prompt_text(spark, sf_dir):
    return _scores(score(examples(spark, sf_dir), "bleu", "context_last", TextColumns(whole_prompt=True)), "score")


@query("q_bp_empty", f"with {COUNTS_SQL} select conv_id, turn, round({sqltext.penalty('c', '0')}, 6) as score from cnt")
def bp_empty(spark, sf_dir):
    return _scores(score(last_examples(spark, sf_dir), "bleu", "empty"), "score")


@query(
    "q_bp_multi",
    f"with {COUNTS_SQL}, near as (select *, {_NEAREST} as m from cnt) select conv_id, turn, round({sqltext.penalty('c', 'm')}, 6) as score from near",
)
def bp_multi(spark, sf_dir):
    return _scores(score(last_examples(spark, sf_dir), "bleu", "multi"), "score")


@query(
    "q_bp_missing_as_text",
    f"""with {COUNTS_SQL}, filled as (select conv_id, turn, c, coalesce(r, 1) as r from cnt)
    select conv_id, turn, round({_BP_REF}, 6) as score from filled""",
)
def bp_missing_as_text(spark, sf_dir):
    return _scores(score(last_examples(spark, sf_dir), "bleu", "ref", TextColumns(missing_as_text=True)), "score")


_PARTS = f"parts as (select conv_id, turn, {_BP_REF} as ref_score, {_BP_CTX} as context_score from cnt)"


@query(
    "q_multi_avg",
    f"""with {COUNTS_SQL}, {_PARTS} select conv_id, turn, {sqltext.rounded(['ref_score', 'context_score'])},
    round((coalesce(ref_score, 0) + context_score) / (1 + cast(ref_score is not null as integer)), 6) as score from parts""",
)
def multi_avg(spark, sf_dir):
    return _scores(score(last_examples(spark, sf_dir), "bleu", "multi_avg"), "ref_score", "context_score", "score")


@query(
    "q_multi_max",
    f"""with {COUNTS_SQL}, {_PARTS} select conv_id, turn, {sqltext.rounded(['ref_score', 'context_score'])},
    round(greatest(coalesce(ref_score, -1), context_score), 6) as score from parts""",
)
def multi_max(spark, sf_dir):
    return _scores(score(last_examples(spark, sf_dir), "bleu", "multi_max"), "ref_score", "context_score", "score")


@query(
    "q_missing_component",
    f"""with {COUNTS_SQL}, {_PARTS}
    select conv_id, turn, cast(null as double) as ref_score, round(context_score, 6) as context_score,
      round(context_score, 6) as score from parts""",
)
def missing_component(spark, sf_dir):
    table = last_examples(spark, sf_dir).drop("ref")
    return _scores(score(table, "bleu", "multi_avg"), "ref_score", "context_score", "score")


@query("q_scorer_overlap", f"with {WORDS_SQL} select conv_id, turn, round(ref_score, 6) as score from f1")
def scorer_overlap(spark, sf_dir):
    return _scores(score(last_examples(spark, sf_dir), overlap.NAME, "ref"), "score")


@query(
    "q_scorer_overlap_multi",
    f"with {WORDS_SQL} select conv_id, turn, round(greatest(coalesce(ref_score, 0), context_score), 6) as score from f1",
)
def scorer_overlap_multi(spark, sf_dir):
    return _scores(score(last_examples(spark, sf_dir), overlap.NAME, "multi"), "score")


@query(
    "q_scorer_components",
    f"""with {WORDS_SQL} select conv_id, turn, {sqltext.rounded(['ref_score', 'context_score', 'empty_score'])},
    round({MEAN3}, 6) as score from f1""",
)
def scorer_components(spark, sf_dir):
    scored = score(last_examples(spark, sf_dir), overlap.NAME, "multi_avg")
    return _scores(scored, "ref_score", "context_score", "empty_score", "score")


@query("q_scorer_resumed", f"with {WORDS_SQL} select conv_id, turn, {sqltext.rounded(['ref_score', 'context_score', 'empty_score'])}, round({MEAN3}, 6) as score from f1")
def scorer_resumed(spark, sf_dir):
    # The first run gets through a part of the dialogues; the second one scores the rest only.
    table = landed(last_examples(spark, sf_dir), "examples")
    path = new_scratch_path(spark, "kept-scores")
    score_stored(table.where(F.col("conv_id") % 3 == 0), overlap.NAME, path, "multi_avg", KEY, steps=2)
    done = score_stored(table, overlap.NAME, path, "multi_avg", KEY, steps=4)
    return _scores(done, "ref_score", "context_score", "empty_score", "score")


@query("q_attach_scores", f"with {WORDS_SQL} select conv_id, turn, model, round(ref_score, 6) as score from f1")
def attached_scores(spark, sf_dir):
    table = examples(spark, sf_dir)
    scored = score(table, overlap.NAME, "ref").select(*KEY, "context", "model", "score")
    joined = attach_scores(table, scored, key=[*KEY, "context", "model"])
    return joined.select(*KEY, "model", F.round("score", 6).alias("score"))


@query(
    "q_reference_modes",
    f"""with {EXAMPLES_SQL}
    select conv_id, turn, 'ref' as mode, ref as refs from ex where ref is not null
    union all select conv_id, turn, 'ref', '' from ex where ref is null
    union all select conv_id, turn, 'context_last', {sqltext.last_line('context')} from ex
    union all select conv_id, turn, 'empty', '' from ex
    union all select conv_id, turn, 'multi', concat_ws('|', ref, {sqltext.last_line('context')}) from ex""",
)
def reference_modes(spark, sf_dir):
    table = last_examples(spark, sf_dir)
    modes = [m for m in MODES if m in SINGLE_MODES or m == "multi"]
    parts = [
        with_references(table, mode).select(*KEY, F.lit(mode).alias("mode"), F.array_join("refs", "|").alias("refs"))
        for mode in modes
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
