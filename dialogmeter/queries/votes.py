"""Votes and the relational catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialogmeter.operators import pairwise
from dialogmeter.operators.regression import rounded
from dialogmeter.plans.workflows import correlate_votes, score_votes, vote_table, win_ratio_line
from dialogmeter.queries import sqltext
from dialogmeter.queries.registry import query
from dialogmeter.queries.views import CATALOG_SQL, EVALSET, VOTES_SQL, catalog, votes
from dialogmeter.sources.relational import register_catalog, sql_source

IN_SET = f"select prompt_id from dataset_text join evaluation_dataset on evaluationdataset_id = evalset_id where name = '{EVALSET}'"
PARTS_SQL = CATALOG_SQL + f""",
the_set as (select evalset_id from evaluation_dataset where name = '{EVALSET}'),
ctx as (select prompt_id, prompt_text from dataset_text join the_set on evaluationdataset_id = evalset_id),
refs as (
  select prompt_id, model_id as ref_id, name as reference_name, response_text as reference_text
  from model_response join model using (model_id)
    join (select model_id from baselines join the_set on evaluationdataset_id = evalset_id) listed using (model_id)
  where is_baseline < 3),
resp as (
  select distinct prompt_id, model_id, name as model_name, response_text as candidate_text
  from model_response join model using (model_id)
  where (is_baseline = 0 or is_baseline > 2) and exists (select 1 from baselines)
    and evaluationdataset_id in (select evalset_id from the_set)),
ctx2 as (select * from ctx semi join resp using (prompt_id)),
evals as (
  select value, model_1, model_2, prompt_id, mturk_run_id
  from ab_comparison join evaluation_run on mturk_run_id = mturk_run_id_id
  where prompt_id in (select prompt_id from ctx)),
models as (select distinct model_id from resp),
shown as (select m.model_id, v.prompt_id, count(v.value) as counts
  from models m join evals v on v.model_1 = m.model_id or v.model_2 = m.model_id group by 1, 2),
won as (select m.model_id, v.prompt_id, count(v.value) as wins
  from models m join evals v on (v.model_1 = m.model_id and v.value = 0) or (v.model_2 = m.model_id and v.value = 1) group by 1, 2),
tab as (
  select c.prompt_id, c.prompt_text, r.ref_id, r.reference_name, r.reference_text,
    s.model_id, s.model_name, s.candidate_text, w.wins::double / h.counts as win_ratio, h.counts
  from ctx2 c cross join models m
  left join (select * from refs where ref_id = (select min(ref_id) from refs)) r on r.prompt_id = c.prompt_id
  left join resp s on s.prompt_id = c.prompt_id and s.model_id = m.model_id
  left join shown h on h.prompt_id = c.prompt_id and h.model_id = m.model_id
  left join won w on w.prompt_id = c.prompt_id and w.model_id = m.model_id)
"""
# Outer join of two grouped counts, the way the ratio is defined on aligned series.
RATIO_SQL = VOTES_SQL + """,
ids as (select distinct model_1 as model_id from ab_comparison union select distinct model_2 from ab_comparison),
shown as (select prompt_id, model_id, count(value) as counts from ab_comparison join ids
  on model_1 = model_id or model_2 = model_id group by 1, 2),
won as (select prompt_id, model_id, count(value) as wins from ab_comparison join ids
  on (model_1 = model_id and value = 0) or (model_2 = model_id and value = 1) group by 1, 2)
"""


@query("q_ab_comparisons", f"with {VOTES_SQL} select * from ab_comparison")
def ab_comparisons(spark, sf_dir):
    return catalog(spark, sf_dir).ab_comparison


@query("q_evaluation_runs", f"with {CATALOG_SQL} select * from evaluation_run")
def evaluation_runs(spark, sf_dir):
    return catalog(spark, sf_dir).evaluation_run


@query("q_model_names", f"with {CATALOG_SQL} select model_id, name from model")
def model_names(spark, sf_dir):
    return catalog(spark, sf_dir).model.select("model_id", "name")


@query("q_sql_source", f"with {CATALOG_SQL} {IN_SET}")
def from_sql(spark, sf_dir):
    register_catalog(catalog(spark, sf_dir), prefix="vote_")
    return sql_source(
        spark,
        """select t.prompt_id from vote_dataset_text t join vote_evaluation_dataset e
           on t.evaluationdataset_id = e.evalset_id where e.name = :evalset""",
        evalset=EVALSET,
    )


@query("q_prompt_ids", f"with {CATALOG_SQL} {IN_SET}")
def prompt_ids(spark, sf_dir):
    return pairwise.prompt_ids(catalog(spark, sf_dir), EVALSET)


@query("q_contexts", f"with {PARTS_SQL} select * from ctx")
def contexts(spark, sf_dir):
    return pairwise.contexts(catalog(spark, sf_dir), EVALSET)


@query("q_references", f"with {PARTS_SQL} select * from refs")
def references(spark, sf_dir):
    return pairwise.reference_answers(catalog(spark, sf_dir), EVALSET)


@query("q_first_reference", f"with {PARTS_SQL} select min(ref_id) as ref_id from refs")
def first_reference(spark, sf_dir):
    return pairwise.first_reference_id(catalog(spark, sf_dir), EVALSET)


@query("q_model_responses", f"with {PARTS_SQL} select * from resp")
def model_responses(spark, sf_dir):
    return pairwise.model_responses(catalog(spark, sf_dir), EVALSET)


@query("q_distinct_models", f"with {PARTS_SQL} select * from models")
def distinct_models(spark, sf_dir):
    return pairwise.model_responses(catalog(spark, sf_dir), EVALSET).select("model_id").distinct()


@query("q_contexts_semi", f"with {PARTS_SQL} select * from ctx2")
def contexts_semi(spark, sf_dir):
    return pairwise.answered_contexts(catalog(spark, sf_dir), EVALSET)


@query("q_evaluations_semi", f"with {PARTS_SQL} select * from evals")
def evaluations_semi(spark, sf_dir):
    return pairwise.evaluations(catalog(spark, sf_dir), EVALSET)


@query("q_win_counts", f"with {RATIO_SQL} select prompt_id, model_id, coalesce(wins, 0) as wins, counts from shown left join won using (prompt_id, model_id)")
def win_counts(spark, sf_dir):
    return pairwise.win_ratio(votes(spark, sf_dir)).select("prompt_id", "model_id", "wins", "counts")


@query(
    "q_win_ratio",
    f"""with {RATIO_SQL} select prompt_id, model_id, counts, round(wins::double / counts, 6) as win_ratio
    from shown full outer join won using (prompt_id, model_id)""",
)
def win_ratio(spark, sf_dir):
    return pairwise.win_ratio(votes(spark, sf_dir)).select(
        "prompt_id", "model_id", "counts", F.round("win_ratio", 6).alias("win_ratio")
    )


@query(
    "q_win_ratio_zero",
    f"""with {RATIO_SQL} select prompt_id, model_id, counts, round(coalesce(wins, 0)::double / nullif(counts, 0), 6) as win_ratio
    from shown left join won using (prompt_id, model_id)""",
)
def win_ratio_zero(spark, sf_dir):
    return pairwise.win_ratio(votes(spark, sf_dir), zero_wins="zero").select(
        "prompt_id", "model_id", "counts", F.round("win_ratio", 6).alias("win_ratio")
    )


@query("q_win_ratio_table", f"with {PARTS_SQL} select * replace (round(win_ratio, 6) as win_ratio) from tab")
def win_ratio_table(spark, sf_dir):
    return vote_table(catalog(spark, sf_dir), EVALSET).withColumn("win_ratio", F.round("win_ratio", 6))


@query(
    "q_win_ratio_chosen_reference",
    f"""with {PARTS_SQL} select c.prompt_id, r.ref_id, r.reference_text from ctx2 c cross join models m
    left join (select * from refs where ref_id = 12) r on r.prompt_id = c.prompt_id
    left join resp s on s.prompt_id = c.prompt_id and s.model_id = m.model_id""",
)
def win_ratio_chosen_reference(spark, sf_dir):
    return vote_table(catalog(spark, sf_dir), EVALSET, ref_id=12).select("prompt_id", "ref_id", "reference_text")


SCORED_SQL = PARTS_SQL + f""",
cnt as (select *, {sqltext.token_count('candidate_text')} as c, {sqltext.token_count('prompt_text')} as w,
  {sqltext.token_count('reference_text')} as r, {sqltext.token_count(sqltext.last_line('prompt_text'))} as x from tab),
scored as (select *, {sqltext.penalty('c', 'w')} as score from cnt)
"""


@query(
    "q_scored_votes",
    f"""with {SCORED_SQL} select prompt_id, model_id, candidate_text, counts, round(win_ratio, 6) as win_ratio, round(score, 6) as score
    from scored where score is not null and win_ratio is not null""",
)
def scored_votes(spark, sf_dir):
    scored = score_votes(vote_table(catalog(spark, sf_dir), EVALSET), "bleu", "context_last")
    return pairwise.scored_votes(scored).select(
        "prompt_id", "model_id", "candidate_text", "counts",
        F.round("win_ratio", 6).alias("win_ratio"), F.round("score", 6).alias("score"),
    )


@query(
    "q_win_ratio_regression",
    f"""with {SCORED_SQL}, pts as (select * from scored where score is not null and win_ratio is not null),
    {sqltext.fits('pts', 'score', 'win_ratio', [])}
    select {sqltext.rounded(sqltext.FIT_COLUMNS)}, n from fit""",
)
def win_ratio_regression(spark, sf_dir):
    return rounded(correlate_votes(score_votes(vote_table(catalog(spark, sf_dir), EVALSET), "bleu", "context_last")))


@query(
    "q_win_ratio_line",
    f"""with {SCORED_SQL}, pts as (select score, win_ratio from scored where score is not null and win_ratio is not null)
    select round(score, 6) as x, round(win_ratio, 6) as y,
      round((select regr_intercept(win_ratio, score) from pts) + (select regr_slope(win_ratio, score) from pts) * score, 6) as y_hat
    from pts""",
)
def win_ratio_points(spark, sf_dir):
    points = win_ratio_line(score_votes(vote_table(catalog(spark, sf_dir), EVALSET), "bleu", "context_last"))
    return points.select(*[F.round(c, 6).alias(c) for c in ("x", "y", "y_hat")])
