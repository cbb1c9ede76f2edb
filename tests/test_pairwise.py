import random

import pytest
from pyspark.sql import functions as F

from dialogmeter import Catalog, correlate_votes, vote_table
from dialogmeter.operators import pairwise
from dialogmeter.sources.relational import TABLES, jdbc_table, register_catalog, sql_source


@pytest.fixture
def cat(spark):
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    return Catalog(
        evaluation_dataset=table([(1, "ESL 3-turn"), (2, "NCM")], "evalset_id long, name string"),
        dataset_text=table(
            [(10, "A: x\nB: hi", 1), (11, "B: yo", 1), (12, "B: unanswered", 1), (20, "other", 2)],
            "prompt_id long, prompt_text string, evaluationdataset_id long",
        ),
        model=table(
            [(1, "human", 1), (2, "m2", 3), (3, "m3", 0), (4, "human2", 2)], "model_id long, name string, is_baseline long"
        ),
        baselines=table([(1, 1), (4, 1), (2, 1)], "model_id long, evaluationdataset_id long"),
        model_response=table(
            [
                (10, 1, 1, "ref10"), (11, 1, 1, "ref11"), (10, 4, 1, "other ref"),
                (10, 2, 1, "two"), (10, 2, 1, "two"), (10, 2, 1, "two again"), (11, 3, 1, "three"), (20, 3, 2, "else"),
            ],
            "prompt_id long, model_id long, evaluationdataset_id long, response_text string",
        ),
        ab_comparison=table(
            [
                (10, 2, 3, 0, 7), (10, 3, 2, 1, 7), (10, 2, 3, 2, 7), (10, 2, 3, None, 7), (11, 2, 3, 0, 7),
                (11, 3, 3, 0, 7), (10, 2, 3, 0, 99), (20, 2, 3, 0, 7),
            ],
            "prompt_id long, model_1 long, model_2 long, value long, mturk_run_id_id long",
        ),
        evaluation_run=table([(7,)], "mturk_run_id long"),
    )


SET = "ESL 3-turn"


def test_catalogue_queries(cat):
    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    assert rows(pairwise.prompt_ids(cat, SET)) == [(10,), (11,), (12,)]
    assert rows(pairwise.reference_answers(cat, SET)) == [
        (10, 1, "human", "ref10"), (10, 4, "human2", "other ref"), (11, 1, "human", "ref11")
    ]
    assert rows(pairwise.model_responses(cat, SET)) == [(10, 2, "m2", "two"), (10, 2, "m2", "two again"), (11, 3, "m3", "three")]
    assert rows(pairwise.answered_contexts(cat, SET).select("prompt_id")) == [(10,), (11,)]
    assert pairwise.evaluations(cat, SET).count() == 6
    assert pairwise.first_reference_id(cat, SET).first().ref_id == 1


def test_no_baseline_row_means_no_response(cat):
    empty = Catalog(**{**cat.__dict__, "baselines": cat.baselines.where("false")})
    assert pairwise.model_responses(empty, SET).count() == 0


def test_win_ratio_rules(cat):
    got = {(r.prompt_id, r.model_id): (r.wins, r.counts, r.win_ratio) for r in pairwise.win_ratio(pairwise.evaluations(cat, SET)).collect()}
    assert got[(10, 2)] == (2, 3, 2 / 3)
    assert got[(10, 3)] == (0, 3, None)
    assert got[(11, 2)] == (1, 1, 1.0)
    # Against itself a model is counted once, and it wins.
    assert got[(11, 3)] == (1, 2, 0.5)
    zero = pairwise.win_ratio(pairwise.evaluations(cat, SET), zero_wins="zero").where("prompt_id = 10 and model_id = 3")
    assert zero.first().win_ratio == 0.0
    with pytest.raises(ValueError):
        pairwise.win_ratio(cat.ab_comparison, zero_wins="x")


def test_one_pass_equals_two_aligned_counts(spark):
    rng = random.Random(3)
    rows = [
        (rng.randrange(6), rng.choice([1, 2, 3, None]), rng.choice([1, 2, 3]), rng.choice([0, 1, 2, None])) for _ in range(400)
    ]
    votes = spark.createDataFrame(rows, "prompt_id long, model_1 long, model_2 long, value long")
    got = {(r.prompt_id, r.model_id): (r.counts, r.win_ratio) for r in pairwise.win_ratio(votes).collect()}
    want = {}
    for m in (1, 2, 3):
        for p in range(6):
            shown = [r for r in rows if r[0] == p and m in (r[1], r[2])]
            won = [r for r in shown if (r[1] == m and r[3] == 0) or (r[2] == m and r[3] == 1)]
            if shown:
                counts = sum(r[3] is not None for r in shown)
                want[(p, m)] = (counts, len(won) / counts if won else None)
    assert got == want


def test_win_ratio_table(cat):
    rows = {(r.prompt_id, r.candidate_text, r.counts): r for r in vote_table(cat, SET).collect()}
    # Two prompts with an answer, two models; model 2 answered prompt 10 twice.
    assert len(rows) == 5
    two = rows[(10, "two", 3)]
    assert (two.prompt_text, two.ref_id, two.reference_text, two.model_name) == (" hi", 1, "ref10", "m2")
    silent = rows[(10, None, 3)]
    assert silent.model_id is None and silent.win_ratio is None and silent.reference_text == "ref10"
    assert rows[(11, None, 1)].win_ratio == 1.0
    chosen = vote_table(cat, SET, ref_id=4).collect()
    assert {(r.prompt_id, r.reference_text) for r in chosen} == {(10, "other ref"), (11, None)}


def test_rows_without_score_or_ratio_are_dropped(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, None), (None, 0.1), (float("nan"), 0.3), (3.0, 0.9), (4.0, 0.8)], "score double, win_ratio double")
    assert correlate_votes(df).first().n == 3


def test_sql_source_binds_parameters(spark, cat):
    register_catalog(cat, prefix="t_")
    query = "select evalset_id from t_evaluation_dataset where name = :name"
    assert sql_source(spark, query, name="NCM").first().evalset_id == 2
    assert sql_source(spark, query, name="x' or '1' = '1").count() == 0
    assert len(TABLES) == 7


def test_jdbc_split_needs_bounds(spark):
    with pytest.raises(ValueError):
        jdbc_table(spark, {"url": "jdbc:none"}, "t", split_on="id")


def test_grid_is_an_equi_join(cat):
    plan = vote_table(cat, SET)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
