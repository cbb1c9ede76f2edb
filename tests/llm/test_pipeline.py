"""The pipeline and the registered queries on small tables."""

import hashlib
import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from dialogmeter.llm import bpe_codec, registry, toxicity
from tests.llm.test_dedup import A_Z, brute_classes, prose
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_all_ten_and_the_pipeline_are_registered():
    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op")]
    assert sorted(names, key=lambda n: int(n[2:])) == [f"op{i}" for i in range(1, 11)]
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", list(registry.LLM_ORACLES))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of documents and labels with toxic texts, copies, near copies and several sources."""
    rng = random.Random(21)
    texts = [prose(rng, rng.choice([8, 40, 120])) for _ in range(120)]
    rows = [(i, t, "en", f"src{i % 4}") for i, t in enumerate(texts)]
    rows += [(200 + i, t.upper(), "en", "src1") for i, t in enumerate(texts[:10])]
    for i, t in enumerate(texts[40:60]):
        words = t.split()
        words[-1] = "different"
        rows.append((300 + i, " ".join(words), "en", "src2"))
    toxic = [(400 + i, f"{prose(rng, 10)} {rng.choice(['zzyzxword', 'qwoxqwox'])} {prose(rng, 5)}", "en", "src0") for i in range(40)]
    rows += toxic + [(500, None, None, None), (501, "", "en", "src3"), (None, prose(rng, 30), "en", "src3")]
    labels = [(i, 1, 0) for i in range(100)] + [(r[0], 0, 1) for r in toxic]
    folder = str(tmp_path_factory.mktemp("corpus"))
    full = [(i, t, lang, s, None if t is None else len(t), "extra") for i, t, lang, s in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, row string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages_against_brute_force(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        found[name] = docs.collect()
        docs = spark.createDataFrame(found[name], docs.schema)
        if name != "bpe_encoding":
            assert docs.columns == columns
    source = spark.read.parquet(f"{folder}/documents.parquet")
    scores = toxicity.predict(spark, source, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    clean = {r.doc_id for r in scores if r.score < 0.5}
    assert {r.doc_id for r in found["toxicity"]} == clean and not clean & set(range(400, 440))
    assert clean >= set(range(120)) | {500, 501, None}
    best = {}
    for r in found["toxicity"]:
        key = (r.text or "").translate(A_Z)
        best[key] = max(best.get(key, -1), -1 if r.doc_id is None else r.doc_id)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in found["exact_dedup"]) == sorted(best.values())
    left = [(r.doc_id, r.text) for r in found["exact_dedup"]]
    want = sorted(min((left[i][0] for i in c if left[i][0] is not None), default=-1) for c in brute_classes(left))
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in found["near_dedup"]) == want
    sizes, mixed = {}, {}
    for r in found["near_dedup"]:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    for r in found["mixing"]:
        mixed[r.source] = mixed.get(r.source, 0) + len(r.text.split())
    # Whole documents, so each source may miss its target by half of its longest one.
    most = sum(max((len((r.text or "").split()) for r in found["near_dedup"] if r.source == s), default=0) for s in sizes)
    assert abs(sum(mixed.values()) - sum(sizes.values())) <= most / 2 + len(sizes) and mixed["src0"] > sizes["src0"]
    assert {(r.doc_id, r.text) for r in found["mixing"]} <= {(r.doc_id, r.text) for r in found["near_dedup"]}
    codec = bpe_codec.codec(bpe_codec.default_tokenizer())
    want = sorted((str(r.doc_id), hashlib.sha256(ids).hexdigest()) for r, (ids, _) in zip(found["mixing"], codec.encode([r.text for r in found["mixing"]]), strict=True))
    assert sorted((str(r.doc_id), r.ids_sha256) for r in found["bpe_encoding"]) == want


def test_run_equals_its_stages_and_handles_an_empty_table(spark, corpus, tmp_path):
    folder, _ = corpus
    rows = corpus_pipeline.run(spark, folder).count()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == rows
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_last_stage_returns_the_ids(spark, docs_of):
    texts = ["Some words, twice: some words", "", None]
    rows = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs_of(texts), SF).collect()}
    codec = bpe_codec.codec(bpe_codec.default_tokenizer())
    for i, (ids, decoded) in enumerate(codec.encode(texts)):
        assert b"".join(x.to_bytes(4, "little") for x in rows[i].ids) == ids and rows[i].decoded == decoded
        assert rows[i].n_tokens == len(rows[i].ids)
