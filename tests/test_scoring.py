import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dialogmeter import TextColumns, VOTE_TEXTS, correlate, evaluate, register_scorer, score, score_examples
from dialogmeter.operators.batching import Batching, calls, scored, windows
from dialogmeter.operators.references import MODES, with_references
from dialogmeter.operators.scoring import attach_scores, key_digest, scorer
from dialogmeter.operators.stored_scores import score_stored
from dialogmeter.plans.workflows import rating_lines

ROWS = [("a b\nx y z", "r s", "one two three"), ("only", None, "w"), ("q", "r s t", None)]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, "context string, ref string, cand string").withColumn("model", F.lit("m"))


@pytest.fixture
def length_scorer():
    """Scores by text length, so that every call is traceable."""

    def factory():
        return lambda cands, refs: [len(c) + 100 * sum(len(r) for r in rs) for c, rs in zip(cands, refs)]

    register_scorer("length_sum", factory)
    return "length_sum"


def by_cand(df, *columns):
    return {r.cand: tuple(r[c] for c in columns) for r in df.collect()}


def test_reference_lists(table):
    def lists(mode):
        return [r.refs for r in with_references(table, mode).collect()]

    assert lists("ref") == [["r s"], [None], ["r s t"]]
    assert lists("context_last") == [["x y z"], ["only"], ["q"]]
    assert lists("empty") == [[""], [""], [""]]
    assert lists("multi") == [["r s", "x y z"], [None, "only"], ["r s t", "q"]]
    with pytest.raises(ValueError):
        lists("multi_avg")


def test_vote_tables_use_the_whole_prompt_in_single_mode_only(spark):
    df = spark.createDataFrame([("c", "r", "p1\np2")], "candidate_text string, reference_text string, prompt_text string")
    assert with_references(df, "context_last", VOTE_TEXTS).first().refs == ["p1\np2"]
    assert with_references(df, "multi", VOTE_TEXTS).first().refs == ["r", "p2"]


def test_bad_arguments(table):
    with pytest.raises(ValueError):
        score(table, "bleu", "best")
    with pytest.raises(ValueError):
        score(table, "fed")
    with pytest.raises(ValueError):
        score(table.drop("ref"), "bleu", "ref")
    assert scorer("bleu").factory is None
    assert len(MODES) == 6


def test_length_metric(table):
    assert by_cand(score(table, "bleu", "ref"), "score") == {"one two three": (1.0,), "w": (None,), None: (None,)}
    assert by_cand(score(table, "bleu", "empty"), "score")["w"] == (1.0,)
    as_text = score(table, "bleu", "ref", TextColumns(missing_as_text=True))
    assert by_cand(as_text, "score")[None] == (math.exp(1 - 3 / 1),)


def test_averaging_modes(table):
    avg = by_cand(score(table, "bleu", "multi_avg"), "ref_score", "context_score", "score")
    assert avg["w"] == (None, 1.0, 1.0)
    assert score(table, "bleu", "multi_max").columns[-3:] == ["ref_score", "context_score", "score"]


def test_missing_component_is_skipped(table):
    got = by_cand(score(table.drop("ref"), "bleu", "multi_avg"), "ref_score", "context_score", "score")
    assert got["w"] == (None, 1.0, 1.0)


def test_batch_scorer(table, length_scorer):
    single = by_cand(score(table, length_scorer, "ref"), "score")
    assert single == {"one two three": (13 + 300.0,), "w": (None,), None: (None,)}
    multi = by_cand(score(table, length_scorer, "multi"), "score")
    assert multi["one two three"] == (13 + 100 * (3 + 5.0),)
    assert multi["w"] == (1 + 400.0,)
    parts = by_cand(score(table, length_scorer, "multi_max"), "ref_score", "context_score", "empty_score", "score")
    assert parts["one two three"] == (313.0, 513.0, 13.0, 513.0)
    assert parts["w"] == (None, 401.0, 1.0, 401.0)


def test_only_texts_reach_the_worker(table, length_scorer):
    wide = table.withColumn("ballast", F.lit("x" * 10))
    plan = score(wide, length_scorer, "multi_avg")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1
    call = plan.split("ArrowEvalPython [")[1].split("]")[0]
    assert "ballast" not in call and "Exchange" not in plan


def test_length_metric_needs_no_python_and_no_shuffle(table):
    plan = score(table, "bleu", "multi_avg")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_attach_scores(spark, table):
    scored = spark.createDataFrame([("only", "m", 0.5)], "context string, model string, score double")
    assert by_cand(attach_scores(table, scored), "score") == {"one two three": (None,), "w": (0.5,), None: (None,)}
    with pytest.raises(Exception, match="share one key"):
        attach_scores(table, scored.union(scored)).collect()


def test_an_existing_score_and_helper_names_stay(spark):
    df = spark.createDataFrame([("q", "a b", "c", 9.0, 1, 2)], "context string, ref string, cand string, score double, _c int, _scores int")
    got = score(df, "bleu", score_col="bp").first()
    assert (got.score, got._c, got._scores) == (9.0, 1, 2) and got.bp == pytest.approx(0.36787944)


def test_keys_of_several_fields_do_not_run_together(spark):
    rows = [("a\x1f", "b"), ("a", "\x1fb"), (None, "a"), ("a", None), ("", "a")]
    df = spark.createDataFrame(rows, "x string, y string").select(key_digest(["x", "y"]).alias("k"))
    assert df.distinct().count() == len(rows)


def test_scoring_runs_once_for_all_reports(spark, tmp_path):
    counter = spark.sparkContext.accumulator(0)

    def counting():
        def run(cands, refs):
            counter.add(len(cands))
            return [float(len(c)) for c in cands]

        return run

    register_scorer("counted", counting)
    rows = [(f"q{i}", "r", "m", "c" * (i + 1), f"[{i % 4}, {i % 3}]", f"[{i % 5}]", f"[{i % 2}]") for i in range(12)]
    df = spark.createDataFrame(rows, "context string, ref string, model string, cand string, warmth string, sense string, overall string")
    scored = score_examples(df, "counted", out=str(tmp_path / "scored"))
    correlate(scored, ["overall"]).collect()
    rating_lines(scored, ["overall"]).collect()
    assert counter.value == 12
    reports = evaluate(df.select("context", "ref", "cand", "model", "warmth", "sense", "overall"), "counted", out=str(tmp_path / "again"))
    for r in reports.values():
        r.collect()
    assert counter.value == 24


def padding(lengths, groups):
    return sum(len(g) * max(lengths[i] for i in g) - sum(lengths[i] for i in g) for g in groups)


def test_calls_hold_texts_of_about_equal_length():
    lengths = [(i * 7919) % 900 + 1 for i in range(1000)] + [200_000]
    limits = Batching(rows=64, padded=10_000)
    made = calls(lengths, limits)
    assert sorted(i for call in made for i in call) == list(range(len(lengths)))
    assert all(len(call) <= 64 and (len(call) == 1 or len(call) * max(lengths[i] for i in call) <= 10_000) for call in made)
    arrival = [list(range(i, min(i + 10, len(lengths)))) for i in range(0, len(lengths), 10)]
    assert padding(lengths, made) < padding(lengths, arrival) / 20
    assert calls([], limits) == []


def test_windows_are_bounded_and_order_is_kept():
    batches = [(pd.Series(["x" * n, None]), pd.Series([[["r"]], [[None]]])) for n in (5, 50, 1, 400, 2)]
    # 6, 51, 2, 401 and 3 characters, references included.
    assert [len(w) for w in windows(batches, 57)] == [2, 2, 1]
    seen = []

    def model(cands, refs):
        seen.append([len(c) for c in cands])
        return [len(c) for c in cands]

    out = [s.tolist() for s in scored(batches, model, Batching(rows=2, padded=1000))]
    assert out == [[[float(n)], [None]] for n in (5, 50, 1, 400, 2)]
    assert seen == [[1, 2], [5, 50], [400]]


@pytest.fixture
def counted(tmp_path):
    """A scorer that notes every text it is given and fails on the one named in a file."""
    notes, poison = tmp_path / "notes", tmp_path / "poison"
    notes.mkdir()

    def factory():
        import uuid

        def model(cands, refs):
            if poison.exists() and poison.read_text() in cands:
                raise RuntimeError("killed")
            (notes / uuid.uuid4().hex).write_text("\n".join(cands))
            return [float(len(c)) for c in cands]

        return model

    register_scorer("counted", factory)
    return poison, lambda: sorted(c for f in notes.iterdir() for c in f.read_text().split("\n"))


def test_an_interrupted_run_goes_on(spark, counted, tmp_path):
    poison, noted = counted
    path = str(tmp_path / "scores")
    rows = [(f"c{i}", "m", f"cand{i:03d}", "r") for i in range(60)]
    df = spark.createDataFrame(rows, "context string, model string, cand string, ref string")
    first = score_stored(df.limit(0).unionByName(df.where("cand < 'cand020'")), "counted", path, steps=8)
    assert first.count() == 20 and noted() == [r[2] for r in rows[:20]]
    poison.write_text("cand045")
    with pytest.raises(Exception, match="killed"):
        score_stored(df, "counted", path, steps=8)
    kept = spark.read.parquet(path).count()
    assert 20 <= kept < 60
    before = noted()
    poison.unlink()
    out = {r.cand: r.score for r in score_stored(df, "counted", path, steps=8).collect()}
    assert out == {r[2]: 7.0 for r in rows}
    # What had been committed was not scored again.
    assert len(noted()) - len(before) == 60 - kept
    again = noted()
    assert score_stored(df, "counted", path, steps=8).count() == 60 and noted() == again


def test_stored_scores_want_a_key_per_row(spark, counted, tmp_path):
    df = spark.createDataFrame([("c", "m", "a", "r"), ("c", "m", "b", "r")], "context string, model string, cand string, ref string")
    with pytest.raises(Exception, match="two rows share one key"):
        score_stored(df, "counted", str(tmp_path / "s")).collect()
    empty = score_stored(df.where("cand is null"), "counted", str(tmp_path / "none"), mode="multi_avg")
    assert empty.count() == 0 and "score" in empty.columns


def test_stored_components(spark, counted, tmp_path):
    df = spark.createDataFrame([("c", "m", "abc", None), ("d", None, None, "r")], "context string, model string, cand string, ref string")
    out = {r.context: r for r in score_stored(df, "counted", str(tmp_path / "s"), mode="multi_avg").collect()}
    assert (out["c"].ref_score, out["c"].context_score, out["c"].score) == (None, 3.0, 3.0)
    assert out["d"].score is None
