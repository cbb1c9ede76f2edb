import random
import zlib

import numpy as np
import pytest

from dialogmeter.llm import chargrams, langid, license_scan, toxicity
from dialogmeter.llm.chargrams import PIECE, grams

VOICES = {"aa": "the of and thing on er".split(), "bb": "der und schein keit ung".split(), "cc": "que los cion ado mente".split()}


def texts(rng, voice, n):
    return [" ".join(rng.choice(VOICES[voice]) for _ in range(rng.randint(3, 30))) for _ in range(n)]


def test_long_texts_have_the_same_grams_in_pieces():
    rng = random.Random(1)
    text = "".join(rng.choice("abc dé") for _ in range(PIECE + 1000))
    found, counts = grams(text, (1, 3), 12)
    want = {}
    for part in (text[:PIECE], text[PIECE - 500 :]):
        for g, c in zip(*grams(part, (1, 3), 12), strict=True):
            want[g] = want.get(g, 0) + c
    assert set(found) <= set(want) and counts.sum() == 2 * (len(text) + 2) - 2


def test_language_of_held_out_texts(spark, docs_of):
    rng = random.Random(2)
    rows = [(i, t, v) for i, (t, v) in enumerate((t, v) for v in VOICES for t in texts(rng, v, 60))]
    rows += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "der und keit", None), (None, "los cion que", "cc")]
    rows.append(rows[0])
    docs = docs_of(rows)
    got = langid.predict(spark, docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[1000].lang_pred, by[1001].lang_pred, by[1002].lang_pred, by[None].lang_pred) == ("und", "und", "bb", "cc")
    truth = {r[0]: r[2] for r in rows}
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_language_without_training_rows(spark, docs_of):
    got = langid.predict(spark, docs_of([(1, "some text"), (2, None)])).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0), ("und", 1.0)}
    assert langid.predict(spark, docs_of([]).limit(0)).count() == 0


def test_ftrl_drops_features_under_the_first_penalty():
    rows = [(np.array([0, 2]), np.array([1.0, 1e-6]), 0), (np.array([1, 2]), np.array([1.0, 1e-6]), 1)] * 20
    w, _ = langid.train_ftrl(rows, 2, 3, l1=0.01)
    assert w[0, 0] > 0 > w[1, 0] and not w[:, 2].any()


def test_temperature_softens_overconfidence():
    logits = np.array([[8.0, 0.0]] * 8 + [[0.0, 8.0]] * 2)
    assert langid.fit_temperature(logits, np.zeros(10, int)) > 2


@pytest.fixture(scope="module")
def toxic_rows():
    rng = random.Random(5)
    clean = [(i, t) for i, t in enumerate(texts(rng, "aa", 200))]
    bad = []
    for i, t in enumerate(texts(rng, "aa", 60), 1000):
        words = t.split()
        words.insert(rng.randint(0, len(words)), rng.choice(["moronic", "scumbag"]))
        bad.append((i, " ".join(words)))
    return clean, bad


def test_toxicity_of_held_out_texts(spark, docs_of, labels_of, toxic_rows):
    clean, bad = toxic_rows
    labels = labels_of([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in bad] + [(7, 0), (None, 1), (8, None), (99999, 1)])
    rows = clean + bad + [(2000, None), (2001, ""), clean[0], (None, "you scumbag"), (2002, "and the thing " * 30_000 + "scumbag")]
    got = toxicity.predict(spark, docs_of(rows), labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == 1 and by[2002].predicted == 1 and by[2000].predicted == by[2001].predicted == 0
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 2000]
    assert np.mean([r.predicted == (r.doc_id >= 1000) for r in held]) > 0.95
    kept = toxicity.drop_toxic(spark, docs_of(rows).withColumnRenamed("lang", "toxic_score"), docs_of(rows), labels)
    assert kept.columns == ["doc_id", "text", "toxic_score", "source", "n_chars"]
    assert kept.count() == sum(r.score < 0.5 for r in got)


def test_toxic_counts_cover_every_labelled_text(spark, docs_of, labels_of, toxic_rows):
    from collections import Counter

    from pyspark.sql import functions as F

    clean, bad = toxic_rows
    rows = clean + bad + [clean[0], (3000, ""), (3001, None), (3002, "long moronic " * 40_000)]
    marks = {**{i: 0 for i, _ in clean}, **{i: 1 for i, _ in bad}, 3000: 1, 3001: 1, 3002: 1}
    made = toxicity._training_rows(docs_of(rows), labels_of([*marks.items(), (5, 1), (None, 1)]), 50, 10)
    marks[5] = 1
    want = {toxicity._OTHER: Counter(), toxicity._TOXIC: Counter()}
    used = [(i, t) for i, t in rows if t is not None and zlib.crc32(str(i).encode()) % 5]
    for i, t in used:
        want[toxicity._OTHER + marks[i]].update([-1, *chargrams.grams(t, toxicity.SIZES, toxicity.BITS)[0].tolist()])
    found = {k: {} for k in want}
    pairs = made.where("kind > 0").select("kind", F.explode(F.arrays_zip("g", "n")).alias("x")).groupBy("kind", "x.g").agg(F.sum("x.n").alias("n"))
    for r in pairs.collect():
        found[r.kind][r.g] = r.n
    assert found == want
    sample = made.where("kind = 0").collect()
    assert 45 <= len(sample) <= 51 and all(r.at is not None for r in sample)  # an id may stand for two rows, or for none


def test_weights_equal_a_dense_regression():
    rng = np.random.default_rng(2)
    x = rng.random((300, 40)) < 0.2
    scale = rng.normal(size=40)
    y = (x @ (scale * rng.normal(size=40)) > 0).astype(float)
    starts = np.append(0, np.cumsum(x.sum(1))).astype(np.int64)
    w, c = toxicity.fit_logistic(starts, np.flatnonzero(x.ravel()) % 40, scale, y, 1e-3, epochs=4, batch=32)
    # The same steps over whole matrices.
    dense, seen, const, seen_const = np.zeros(40), np.full(40, 1e-8), 0.0, 1e-8
    random = np.random.default_rng(10)
    for _ in range(4):
        order = random.permutation(300)
        for at in range(0, 300, 32):
            rows = x[order[at : at + 32]] * scale
            error = (1 / (1 + np.exp(-(rows @ dense + const))) - y[order[at : at + 32]]) / len(rows)
            here = rows.any(0)
            grad = np.where(here, rows.T @ error + 1e-3 * dense, 0)
            seen += grad**2
            dense -= 0.1 * grad / np.sqrt(seen)
            seen_const += error.sum() ** 2
            const -= 0.1 * error.sum() / np.sqrt(seen_const)
    assert w == pytest.approx(dense, abs=1e-9) and c == pytest.approx(const, abs=1e-9)
    assert np.mean((x * scale @ w + c > 0) == y) > 0.9


def test_ftrl_equals_a_dense_loop():
    """Every coordinate of every row, one number at a time."""
    import math

    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(12, 5, replace=False)), rng.random(5), int(rng.integers(3))) for _ in range(40)]
    alpha, beta, l1, l2 = 0.5, 1.0, 1e-2, 1e-4
    z, n = [[0.0] * 13 for _ in range(3)], [[0.0] * 13 for _ in range(3)]

    def weight(c, i):
        if abs(z[c][i]) <= l1:
            return 0.0
        return -(z[c][i] - math.copysign(l1, z[c][i])) / ((beta + math.sqrt(n[c][i])) / alpha + l2)

    for _ in range(3):
        for found, values, y in rows:
            x = [0.0] * 12 + [1.0]
            for i, v in zip(found, values, strict=True):
                x[i] = float(v)
            logits = [sum(weight(c, i) * x[i] for i in range(13)) for c in range(3)]
            parts = [math.exp(v - max(logits)) for v in logits]
            steps = []
            for c in range(3):
                error = parts[c] / sum(parts) - (c == y)
                steps += [(c, i, error * x[i], weight(c, i)) for i in range(13)]
            for c, i, g, w in steps:
                z[c][i] += g - (math.sqrt(n[c][i] + g * g) - math.sqrt(n[c][i])) / alpha * w
                n[c][i] += g * g
    got, constants = langid.train_ftrl(rows, 3, 12, alpha, beta, l1, l2)
    want = np.array([[weight(c, i) for i in range(13)] for c in range(3)])
    assert np.column_stack([got, constants]) == pytest.approx(want, abs=1e-9)


def test_language_sample_is_bounded_by_rows(spark, docs_of):
    rng = random.Random(9)
    rows = [(7, t, "aa") for t in texts(rng, "aa", 80)] + [(100 + i, t, "bb") for i, t in enumerate(texts(rng, "bb", 80))]
    rows += [(300 + i, t, "aa") for i, t in enumerate(texts(rng, "aa", 30))]
    model = langid.fit(spark, docs_of(rows), fit_rows=40)
    assert set(model.languages) == {"aa", "bb"}


def test_toxicity_without_labels(spark, docs_of, labels_of):
    docs = docs_of(["a text", None])
    assert [r.predicted for r in toxicity.predict(spark, docs, labels_of([]).limit(0)).collect()] == [0, 0]
    assert toxicity.predict(spark, docs.limit(0), labels_of([(1, 1)])).count() == 0


def test_licence_notices(spark, docs_of):
    rng = random.Random(6)
    filler = [t + "." for t in texts(rng, "aa", 120)]
    rows = [(i, "\n".join(filler[i : i + 5])) for i in range(100)]
    rows += [
        (200, filler[0] + "\nReleased under the MIT License."), (201, "Licensed under the Apache License, Version 2.0.\n" + filler[1]),
        (202, f"{filler[2]} This work is licensed under the GNU General Public License, version 3. {filler[3]}"), (203, None), (204, ""),
        (205, "All rights reserved.\nLicensed under CC BY-NC 4.0."), (206, "She renewed her driver license in the general office."),
        (207, (filler[4] + "\n") * 60_000 + "All rights reserved."), (None, "Released under the MIT License"),
    ]
    got = license_scan.licences(spark, docs_of(rows).withColumnRenamed("source", "found")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: list(r.families) for r in got}
    assert (by[200], by[201], by[202], by[205], by[207], by[None]) == (["mit"], ["apache"], ["gpl"], ["cc-by-nc", "proprietary"], ["proprietary"], ["mit"])
    assert not any(by[i] for i in [*range(100), 203, 204, 206])
    assert license_scan.licences(spark, docs_of([]).limit(0)).count() == 0


def test_wrapped_licence_headers(spark, docs_of, monkeypatch):
    rng = random.Random(7)
    filler = [t + "." for t in texts(rng, "aa", 120)]
    mit = ["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files (the \"Software\"), to deal",
           "in the Software without restriction, including without limitation the rights"]
    gpl = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by",
           "the Free Software Foundation, either version 3 of the License, or"]
    bsd = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions are met:"]
    rows = [(i, "\n".join(filler[i : i + 5])) for i in range(100)]
    rows += [
        (200, "\n".join(mit)), (201, filler[0] + "\n\n" + "\n".join("# " + x for x in gpl)), (202, "/*\n" + "\r\n".join(" * " + x for x in bsd) + "\n */"),
        (203, "\n\n".join(mit)), (204, "All rights reserved\n" + "\n".join(mit) + "\n\n" + "\n".join(bsd)), (205, "Released under the MIT License\nand more"),
    ]
    got = license_scan.licences(spark, docs_of(rows)).collect()
    by = {r.doc_id: (list(r.families), r.n_notices) for r in got}
    assert [by[i] for i in range(200, 206)] == [
        (["mit"], 1), (["gpl"], 1), (["bsd"], 1), ([], 0), (["bsd", "mit", "proprietary"], 3), (["mit"], 1)]
    assert not any(by[i][1] for i in range(100))
    # A cut between two slices of a long text.
    import pyarrow as pa

    from dialogmeter.llm import textbuf

    model = license_scan.fit(spark, docs_of(rows))
    monkeypatch.setattr(textbuf, "SLICE", 1000)
    for lead in range(0, 900, 60):
        found, = license_scan.notices(pa.array(["x" * lead + ".\n" + "\n".join(mit) + ".\n" + "y z.\n" * 300]), model)
        assert [n[0] for n in found] == ["mit"]


def test_counts_of_ngrams_come_in_bounded_rows(spark, docs_of, labels_of):
    random = np.random.default_rng(1)
    texts = ["".join(map(chr, random.integers(97, 123, 100_000))) for _ in range(3)]
    rows = toxicity._training_rows(docs_of([(i, t) for i, t in enumerate(texts, 1)]), labels_of([(i, i % 2) for i in range(1, 4)]), 10, 10).collect()
    trained = [i for i in range(1, 4) if zlib.crc32(str(i).encode()) % 5 != 0]
    counts = [r for r in rows if r.kind != toxicity._TEXT]
    assert sum(n for r in counts for n in r.n) == len(trained) + sum(len(toxicity.grams(texts[i - 1], toxicity.SIZES, toxicity.BITS)[0]) for i in trained)
    assert max(len(r.g) for r in counts) <= 1 << 16
