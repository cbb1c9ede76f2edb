import json

import pytest
from pyspark.sql import functions as F

from dialogmeter import preprocess, schemas
from dialogmeter.operators.flatten import GROUND_TRUTH, explode_responses, layout
from dialogmeter.sources.dialog_json import read_dialog_json, read_examples


def response(text, model, value=1):
    return {"response": text, "model": model, **{q: [value, 0, 1] for q in schemas.USR_QUALITIES}}


USR = [
    {
        "context": ' "hi"\nthere \n', "fact": 'f"act ',
        "responses": [response('early "x" ', "A"), response(' "truth" ', GROUND_TRUTH), response("late\n", "B", 3)],
    },
    {"context": "no truth", "fact": "", "responses": [response("only", "A")]},
    {"context": "nothing", "fact": "", "responses": []},
]


@pytest.fixture
def usr_path(tmp_path):
    (tmp_path / "usr").mkdir()
    (tmp_path / "usr" / "part.json").write_text("\n".join(json.dumps(r) for r in USR))
    return str(tmp_path / "usr")


def test_usr_examples(spark, usr_path):
    rows = {r.cand: r for r in read_examples(spark, "usr", usr_path).collect()}
    assert set(rows) == {'early "x" ', "late\n", "only"}
    late = rows["late\n"]
    assert (late.context, late.fact, late.ref, late.model) == ("hi\nthere", "fact", "truth", "B")
    assert late.maintains_context == [3, 0, 1]
    assert rows['early "x" '].ref == "truth"
    assert rows["only"].ref is None


def test_preceding_reference_depends_on_the_order(spark, usr_path):
    records = read_dialog_json(spark, "usr", usr_path)
    refs = {r.r.response: r.ref for r in explode_responses(records, "preceding").collect()}
    assert refs == {'early "x" ': None, "late\n": ' "truth" ', "only": None}
    with pytest.raises(ValueError):
        explode_responses(records, "other")


def test_array_file(spark, tmp_path):
    (tmp_path / "all.json").write_text(json.dumps(USR, indent=1))
    assert read_examples(spark, "usr", str(tmp_path / "all.json"), lines=False).count() == 3


def test_static_records(spark, tmp_path):
    record = {"dialog_history": '"ctx" ', "dialog_response": ' "raw" ', "system": ' "S"', **{q: [2] for q in schemas.STATIC_QUALITIES}}
    (tmp_path / "s.json").write_text(json.dumps(record))
    row = read_examples(spark, "static_data", str(tmp_path / "s.json")).first()
    assert (row.context, row.cand, row.model, row.semantically_appropriate) == ("ctx", ' "raw" ', "S", [2])


def test_fed_records_split_on_the_response_key(spark, tmp_path):
    turn = {"context": "c", "response": "System: a: b", "system": "M", "annotations": {q: ["1", "N/A (x)"] for q in schemas.FED_TURN_QUALITIES}}
    dialog = {"context": "d", "system": "M", "annotations": {q: ["2"] for q in schemas.FED_DIALOG_QUALITIES}}
    (tmp_path / "f.json").write_text(json.dumps(turn) + "\n" + json.dumps(dialog))
    with_response = read_examples(spark, "fed_referenced", str(tmp_path / "f.json")).collect()
    without = read_examples(spark, "fed_unreferenced", str(tmp_path / "f.json")).collect()
    assert [(r.context, r.cand, r.interesting) for r in with_response] == [("c", " b", ["1", "N/A (x)"])]
    assert [(r.context, r.error_recovery) for r in without] == [("d", ["2"])]
    assert "cand" not in without[0].asDict()


def test_unknown_data_set():
    with pytest.raises(ValueError):
        layout("other")


def test_preprocess_writes_only_when_asked(spark, usr_path, tmp_path):
    out = str(tmp_path / "out")
    assert preprocess(spark, "usr", usr_path).count() == 3
    assert not (tmp_path / "out").exists()
    preprocess(spark, "usr", usr_path, out=out)
    header = spark.read.options(sep="\t", header=True, multiLine=True, quote='"', escape='"').csv(out)
    assert header.columns == ["context", "fact", "ref", "cand", "model", *map(schemas.column_name, schemas.USR_QUALITIES)]
    assert header.where(F.col("understandable") == "[3, 0, 1]").count() == 1
