import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogmeter import schemas
from dialogmeter.functions.combine import row_max, row_mean
from dialogmeter.session import new_scratch_path, recommended_conf, shared_scratch
from dialogmeter.sinks.tables import normalised_header, write_parquet, write_tsv
from dialogmeter.sources.open_records import open_ratings, read_open_records
from dialogmeter.sources.tsv import clean_missing, misfits, read_score_files, read_tsv, type_report, with_found_types

PAIR = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])
AWKWARD = ["plain", "a\rb", "a\r\nb", "a\nb", "\n", " lead", "trail ", 'q"q', '"', "tab\tx", "back\\slash", '\\"', "x\\", "é", "'", "#c"]


def round_trip(spark, texts):
    path = new_scratch_path(spark, "test")
    write_tsv(spark.createDataFrame(list(enumerate(texts)), PAIR), path)
    rows = read_tsv(spark, path, PAIR, missing_words=False).collect()
    return [r.t for r in sorted(rows, key=lambda r: r.id)]


def test_awkward_texts_survive(spark):
    assert round_trip(spark, AWKWARD) == AWKWARD


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("ab\"\\\t\n\r ,é'"), min_size=1, max_size=12), min_size=25, max_size=25))
def test_any_text_survives(spark, texts):
    assert round_trip(spark, texts) == texts


def test_lists_and_header(spark, tmp_path):
    df = spark.createDataFrame([("x", [1, 0, 1])], "`Some Text` string, `Maintains Context` array<int>")
    write_tsv(df, str(tmp_path / "o"))
    row = read_tsv(spark, str(tmp_path / "o")).first()
    assert row.asDict() == {"some_text": "x", "maintains_context": "[1, 0, 1]"}
    assert normalised_header(df).columns == ["some_text", "maintains_context"]
    assert write_tsv(df, None) is df and write_parquet(df, None) is df


def test_files_with_carriage_returns_and_row_numbers(spark, tmp_path):
    (tmp_path / "f.tsv").write_bytes(b'\tcand\tscore\r\n0\t"two\nlines"\t1.5\r\n1\tNA\t\r\n')
    df = read_tsv(spark, str(tmp_path / "f.tsv"), infer=True)
    assert df.columns == ["row_id", "cand", "score"]
    assert [tuple(r) for r in df.orderBy("row_id").collect()] == [(0, "two\nlines", 1.5), (1, None, None)]


def test_whole_numbers_stored_as_decimals(spark, tmp_path):
    columns = schemas.votes_table("score")
    header = "\t".join(columns.fieldNames())
    (tmp_path / "v.tsv").write_text(header + "\n1\tp\t112\tn\tr\t5.0\tm\tc\t0.5\t18.0\t-1.5\n2\tp\t\t\t\t\t\t\t\t\tnan\n")
    rows = read_tsv(spark, str(tmp_path / "v.tsv"), columns).orderBy("prompt_id").collect()
    assert (rows[0].model_id, rows[0].counts, rows[0].score) == (5, 18, -1.5)
    assert rows[1].counts is None and rows[1].score is None and rows[1].candidate_text is None


def test_score_files(spark, tmp_path):
    for name, value in (("one", 1.0), ("two", 2.0)):
        write_tsv(spark.createDataFrame([("c", value)], "context string, old_score double"), str(tmp_path / name))
    tables = read_score_files(spark, {n: str(tmp_path / n) for n in ("one", "two")}, score_col="old_score")
    assert {n: (t.first().metric, t.first().score) for n, t in tables.items()} == {"one": ("one", 1.0), "two": ("two", 2.0)}


def test_missing_words(spark):
    df = spark.createDataFrame([("NA", float("nan")), ("x", 1.0)], "t string, d double")
    assert [tuple(r) for r in clean_missing(df).collect()] == [(None, None), ("x", 1.0)]


def test_scratch_folder(spark):
    assert shared_scratch(spark) == shared_scratch(spark)
    assert new_scratch_path(spark, "a") != new_scratch_path(spark, "a")


def test_recommended_settings_grow_with_the_input():
    small, large = recommended_conf(10**9, 16), recommended_conf(10**14, 4000)
    assert int(small["spark.sql.shuffle.partitions"]) == 32
    assert int(large["spark.sql.shuffle.partitions"]) == 20_000


FOLDER = os.environ.get("SCORE_FILES_DIR")


@pytest.mark.skipif(not FOLDER, reason="SCORE_FILES_DIR names no folder of score files")
def test_combined_scores_in_given_files(spark):
    """Every file with component columns holds their mean or their maximum."""
    seen = 0
    for name in sorted(os.listdir(FOLDER)):
        path = os.path.join(FOLDER, name)
        if not os.path.isfile(path) or not name.endswith("_scores"):
            continue
        df = read_tsv(spark, path, infer=True)
        parts = [F.col(c).cast("double") for c in ("ref_score", "context_score", "empty_score") if c in df.columns]
        if len(parts) < 2:
            continue
        seen += 1
        combine = row_mean if "_avg" in name else row_max
        gap = F.abs(combine(parts) - F.col("score").cast("double"))
        assert df.where((gap > 1e-5) | (combine(parts).isNull() != F.col("score").isNull())).count() == 0, name
    assert seen


def test_empty_text_and_null_stay_apart(spark, tmp_path):
    df = spark.createDataFrame([("", "a"), (None, "b"), (" ", "c")], "x string, y string")
    returned = write_tsv(df, str(tmp_path / "t"))
    schema = T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.StringType())])
    got = read_tsv(spark, str(tmp_path / "t"), schema, missing_words=False)
    want = [("", "a"), (" ", "c"), (None, "b")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, returned.collect()), key=str) == sorted(want, key=str)
    assert {r.y: r.x for r in read_tsv(spark, str(tmp_path / "t"), schema).collect()} == {"a": None, "b": None, "c": " "}


def test_types_that_all_cells_fit(spark):
    rows = [("1", "1", "True", "x", None, "1.5", "+7", "12345678901234567890"), ("-20", "NA", "False", "2", None, "2", "8", "1")]
    df = spark.createDataFrame(rows, "i string, gap string, flag string, mixed string, none string, real string, sign string, `long er` string")
    report = {r.column_name: r for r in type_report(df).collect()}
    assert {c: r.type for c, r in report.items()} == {
        "i": "bigint", "gap": "double", "flag": "boolean", "mixed": "string", "none": "double", "real": "double", "sign": "bigint", "long er": "double"}
    assert (report["gap"].n, report["gap"].n_missing, report["gap"].n_bigint) == (2, 1, 1)
    assert [tuple(r) for r in misfits(df, {"mixed": "double", "gap": "bigint", "i": "string"}).collect()] == [("mixed", "x", 1)]
    typed = with_found_types(df)
    assert [t for _, t in typed.dtypes] == [report[c].type for c in df.columns]
    assert typed.first().flag is True and typed.collect()[1].gap is None
    assert with_found_types(df, {"mixed": "double"}).first().mixed is None
    assert {r.type for r in type_report(df.limit(0)).collect()} == {"double"}


def test_records_with_any_labels(spark, tmp_path):
    lines = [
        '{"id": "a", "answers": [{"response": "r", "fun": [1, 3], "depth": ["x", 2, null]}, {"response": "s", "new one": [4]}]}',
        '{"id": "b", "answers": []}', '{"id": "c"}', '{"id": "d", "answers": [{"fun": []}, {"fun": 3}, 7]}', '{"id": null, "answers": [{"fun": [2.5]}]}',
    ]
    (tmp_path / "records.json").write_text("\n".join(lines))
    got = open_ratings(read_open_records(spark, str(tmp_path / "records.json")), "$.answers", {"id": "$.id"}).collect()
    assert sorted((r.id or "-", r.answer, r.quality, r.ratings, r.median or 0) for r in got) == [
        ("-", 0, "fun", [2.5], 2.5), ("a", 0, "depth", [2.0], 2.0), ("a", 0, "fun", [1.0, 3.0], 2.0), ("a", 1, "new one", [4.0], 4.0),
        ("d", 0, "fun", [], 0)]
