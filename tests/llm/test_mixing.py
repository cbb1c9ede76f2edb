import random

import duckdb
import pytest

from dialogmeter.llm import mixing


def pour(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing and resharing until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        words = total - sum(full.values())
        rate = words / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if rate * w[s] > most * sizes[s]]
        if not over:
            return {**full, **{s: rate * w[s] for s in rest}}
        full.update({s: most * sizes[s] for s in over})


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for i in range(400):
        source = rng.choice(["a", "a", "a", "b", "é", "z", "tiny", None]) if i else "single"
        if source == "tiny" and rng.random() < 0.8:
            source = "a"
        out.append((i, " ".join("w" for _ in range(rng.choice([0, 1, 7, 40, 200]))), "en", source))
    return [*out, (500, None, "en", "a"), (501, "", "en", "empty"), (7, "again and again", "en", "b"), (7, "again and again", "en", "b"), (None, "no id", "en", "b")]


def test_targets_and_taken_words(spark, docs_of, labels_of, rows, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    labels = labels_of([(i, 0) for i in range(0, 300, 3)] + [(3, 0), (None, 0)])
    docs = docs_of(rows).withColumnRenamed("n_chars", "key")
    got = mixing.mix(docs, labels).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    assert {r.source: r.source_size for r in got} == sizes
    want = pour(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        # Documents are whole, so a source may miss its target by half of the one at the end.
        assert abs(taken[s] - want[s]) <= max(r.size for r in got if r.source == s) / 2 + 1
    again = mixing.mix(docs.repartition(7), labels).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and key


def test_mix_equals_sql(spark, docs_of, labels_of, rows):
    docs, labels = docs_of([r for r in rows if r[0] != 7]), labels_of([(1, 0), (2, 1)])
    con = duckdb.connect()
    documents, marks = docs.toArrow(), labels.toArrow()
    con.register("documents", documents)
    con.register("labels", marks)
    want = con.execute(f"select doc_id, size, source_size, round(target, 4), taken from ({mixing.SQL})").fetchall()
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 4), r.taken) for r in mixing.mix(docs, labels).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_rows_of_one_id_are_ordered_by_size(spark, docs_of):
    # All ids are null, so all keys are equal.
    docs = docs_of([(None, "w " * (1 + i % 50), "en", "big" if i < 900 else "a") for i in range(1000)])
    got = [r for r in mixing.mix(docs).collect() if r.source == "big"]
    assert abs(sum(r.taken for r in got) - got[0].target) <= 50 * 18 / 2
    long = mixing.mix(docs_of([(1, "w " * 400_000, "en", "a"), (2, "v", "en", "b"), (3, "u " * 9, "en", "b")])).collect()
    assert all(r.taken % r.size == 0 for r in long) and {r.taken for r in long if r.doc_id == 1} == {400_000}


def test_better_documents_are_taken_more_often(spark, docs_of):
    docs = docs_of([(i, "five words are in here", "en", "big" if i < 3000 else "a") for i in range(6000)])
    quality = spark.createDataFrame([(i, i % 2, 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    got = [r for r in mixing.mix(docs, quality).collect() if r.source == "big"]
    assert any(r.taken == 0 for r in got)
    good, poor = (sum(r.taken > 0 for r in got if r.doc_id % 2 == k) for k in (1, 0))
    assert good > 1.2 * poor


def test_mixed_documents_hold_the_words_taken(spark, docs_of, labels_of, rows):
    docs, labels = docs_of(rows).withColumnRenamed("lang", "taken"), labels_of([(1, 0)])
    mixed = mixing.mix_documents(docs, labels)
    assert mixed.columns == docs.columns
    words, whole = {}, {t for _, t, *_ in rows}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
        assert r.n_chars == len(r.text) and r.text in whole
    taken = {}
    for r in mixing.mix(docs, labels).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert words == {s: n for s, n in taken.items() if n}


def test_empty_tables(spark, docs_of, labels_of):
    docs = docs_of([]).limit(0)
    assert mixing.mix(docs, labels_of([]).limit(0)).count() == 0
    assert mixing.mix_documents(docs).count() == 0
