import json

from dialogmeter import schemas, score
from dialogmeter.sources.dialog_json import read_examples
from dialogmeter.streaming.scoring import score_stream, stream_examples


def write(folder, name, replies):
    rows = [
        {"dialog_history": "a\nb c d", "dialog_response": r, "system": "S", **{q: [1] for q in schemas.STATIC_QUALITIES}} for r in replies
    ]
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def test_late_files_are_scored_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for name, replies in (("1.json", ["x", "x y z"]), ("2.json", ["x y"])):
        write(source, name, replies)
        examples = stream_examples(spark, "static_data", str(source))
        score_stream(examples, out, state, "bleu", "context_last").awaitTermination(120)
    got = sorted((r.cand, r.score) for r in spark.read.parquet(out).collect())
    batch = score(read_examples(spark, "static_data", str(source)), "bleu", "context_last")
    assert got == sorted((r.cand, r.score) for r in batch.collect()) and len(got) == 3
