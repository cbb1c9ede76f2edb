import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dialogmeter.llm import lm_scoring as lm
from dialogmeter.llm import textbuf

PATH = lm.default_tokenizer()


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def ids_of(text):
    library = lm.speller(PATH).library
    return [i for w in words_of(text) for i in (library.encode(w) or [0])]


@pytest.fixture(autouse=True, params=[3, 16])
def group(request, monkeypatch):
    """Small models have few groups of few classes."""
    if "docs_of" not in request.fixturenames:
        monkeypatch.setattr(lm, "GROUP", request.param)
    elif request.param == 3:
        pytest.skip("jobs run with the module's own groups")


def small_model(k=48, size=60, seed=0):
    random = np.random.default_rng(seed)
    classes = np.minimum(np.arange(size), k - 2).astype(np.int32)
    ids = random.integers(0, 9, size).astype(float)
    pair_counts = random.integers(0, 5, (k + 1, k)).astype(float)
    # Of the shared class only one pair was seen, always with the same id.
    pair_counts[:, k - 2] = 0
    pair_counts[2, k - 2] = 3
    share, pairs = lm.smoothed(ids, pair_counts, classes)
    weights = lm.Weights.fresh(k, seed)
    weights = lm.Weights(**{n: getattr(weights, n) * (20 if n in "UG" else 1) for n in lm.Weights.__dataclass_fields__})
    return lm.Model("", classes, share, pairs, lm.grouped(pairs), pair_counts, np.array([2 * size + 57], np.int64), np.array([3]), weights)


def slow_logs(model, z):
    """Log probability of each class behind the start, one place and one key at a time."""
    w, out = model.weights, []
    for t in range(lm.CONTEXT + 1, len(z)):
        window = (t - lm.CONTEXT - 1) // lm.STRIDE * lm.STRIDE
        x = [w.E[z[window + i]] + w.P[i] for i in range(t - window)]
        q = x[-1] @ w.Q
        a = np.array([float(q @ (v @ w.K)) * lm.WIDTH**-0.5 for v in x])
        a = np.exp(a - a.max())
        state = x[-1] + sum(p * (v @ w.V) for p, v in zip(a / a.sum(), x, strict=True)) @ w.O
        def bounded(columns):
            return np.exp(np.clip(state @ columns, -lm.BOUND, lm.BOUND))

        g, pairs = z[t] // lm.GROUP, model.pairs[z[t - 1]].astype(float)
        groups = [pairs[i : i + lm.GROUP].sum() for i in range(0, len(pairs), lm.GROUP)] * bounded(w.G)
        own = slice(g * lm.GROUP, (g + 1) * lm.GROUP)
        chances = pairs[own] * bounded(w.U[:, own])
        out.append(math.log(groups[g] / groups.sum()) + math.log(chances[z[t] - own.start] / chances.sum()))
    return out


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 100])
def test_windows_score_each_id_once(n):
    model = small_model()
    z = np.array([model.start] * (lm.CONTEXT + 1) + np.random.default_rng(n).integers(0, 5, n).tolist() + [model.end], np.int32)
    windows = lm.class_windows(z, -1)
    logs = model.log_probabilities(np.maximum(windows, 0))[windows[:, lm.CONTEXT + 1 :] >= 0]
    assert len(logs) == n + 1
    assert logs == pytest.approx(slow_logs(model, z), abs=1e-4)


def test_probabilities_sum_to_one():
    model = small_model()
    z = [model.start] * (lm.CONTEXT + 1) + [1, 4, 2]
    windows = np.concatenate([lm.class_windows(np.array([*z, c], np.int32), 0)[:1] for c in range(model.end + 1)])
    chances = np.exp(model.log_probabilities(windows)[:, 3])
    assert chances.sum() == pytest.approx(1, abs=1e-5)
    ids = np.arange(60)
    for before in range(49):
        shares = np.exp(model.log_shares(np.full(60, before), ids))
        assert np.bincount(model.classes, shares)[:47] == pytest.approx([1] * 47, abs=1e-9)


@pytest.mark.parametrize("size", [1, 40])
def test_attention_from_tables(size):
    weights = lm.Weights.fresh(12, 5)
    weights = lm.Weights(**{n: getattr(weights, n) * size ** (n in "QK") for n in lm.Weights.__dataclass_fields__})
    inputs = np.random.default_rng(6).integers(0, 13, (7, lm.WINDOW))
    assert lm.attention(weights)(inputs) == pytest.approx(lm.attend(weights, inputs)[0], abs=1e-4 * size)


def test_gradient_equals_differences():
    k = 2 * lm.GROUP
    random = np.random.default_rng(3)
    part = random.integers(0, k, (2, lm.WINDOW + 1))
    part[1, -9:] = -1
    pairs = random.random((k + 1, k)) + 0.1
    pairs /= pairs.sum(1, keepdims=True)
    w = lm.Weights.fresh(k, 3)
    w = lm.Weights(**{n: getattr(w, n).astype(float) for n in lm.Weights.__dataclass_fields__})

    def loss(w):
        whole = np.maximum(part, 0)
        state, _ = lm.attend(w, whole[:, :-1])
        wanted, here = whole[:, lm.CONTEXT + 1 :, None], pairs[whole[:, lm.CONTEXT : -1]]
        g = np.exp(state @ w.G) * here.reshape(*here.shape[:2], -1, lm.GROUP).sum(3)
        p = (np.exp(state @ w.U) * here).reshape(*here.shape[:2], -1, lm.GROUP)
        p = (p / p.sum(3, keepdims=True) * (g / g.sum(2, keepdims=True))[..., None]).reshape(here.shape)
        chosen = np.take_along_axis(p, wanted, 2)[..., 0]
        here = part[:, lm.CONTEXT + 1 :] >= 0
        return -np.log(chosen[here]).mean()

    grad = lm._gradient(w, part, pairs)
    for name in lm.Weights.__dataclass_fields__:
        table = getattr(w, name)
        for at in [tuple(random.integers(0, s) for s in table.shape) for _ in range(4)]:
            up, down = table.copy(), table.copy()
            up[at] += 1e-5
            down[at] -= 1e-5
            fields = {n: getattr(w, n) for n in lm.Weights.__dataclass_fields__}
            slope = (loss(lm.Weights(**{**fields, name: up})) - loss(lm.Weights(**{**fields, name: down}))) / 2e-5
            assert grad[name][at] == pytest.approx(slope, abs=2e-6), name


@pytest.mark.parametrize("slice_bytes", [16, 64, 1 << 20])
def test_spelling_is_the_librarys_whatever_the_slices(monkeypatch, slice_bytes):
    monkeypatch.setattr(textbuf, "SLICE", slice_bytes)
    texts = ["The cat, THE mat\tand é ü!", "", None, " \n ", "x" * 200 + " tail", "a b c d e f g h i j k l m n o p"]
    ids, words = {}, {}
    for part in lm.spelled(pa.array(texts), PATH):
        at = 0
        for i, n in enumerate(part.lengths):
            ids.setdefault(part.first + i, []).extend(part.ids[at : at + n].tolist())
            words[part.first + i] = words.get(part.first + i, 0) + int(part.words[i])
            at += n
    assert [ids.get(i, []) for i in range(len(texts))] == [ids_of(t) for t in texts]
    assert [words.get(i, 0) for i in range(len(texts))] == [len(words_of(t)) for t in texts]


def test_words_are_looked_up_together(monkeypatch):
    # Also when the memo starts anew in between, and when its latest words join the others.
    texts = [f"wort{i} Ünïcode{i} x" for i in range(50)]
    plain = {h: ids for h, ids in zip(range(100, 150), ([i for w in words_of(t) for i in ids_of(w)] for t in texts), strict=True)}
    for memo in (20, 1000):
        monkeypatch.setattr(lm, "MEMO", memo)
        library, asked = lm.Speller(PATH), []

        def words(which, part):
            asked.append(len(which))
            return [texts[part[i] - 100].lower().split(" ")[0] for i in which]

        for part in (range(100, 130), range(110, 150), range(100, 150)):
            hashes = np.array(part, np.uint64)
            places, sizes = library.spell(hashes, lambda which, part=part: words(which, part))
            for h, place, size in zip(part, places, sizes, strict=True):
                word = texts[h - 100].lower().split(" ")[0]
                assert library.pool[place : place + size].tolist() == ids_of(word) == plain[h][:size]
        assert asked == ([30, 40, 50] if memo == 20 else [30, 20])


def test_windows_of_many_texts_are_those_of_each():
    random = np.random.default_rng(5)
    texts = [random.integers(0, 9, lm.CONTEXT + 2 + n).astype(np.int32) for n in (0, 23, 24, 25, 0, 100, 1)]
    places = np.append(0, np.cumsum([len(t) for t in texts]))
    each = np.concatenate([lm.class_windows(t, -1) for t in texts])
    assert np.array_equal(lm.texts_windows(np.concatenate(texts), places, -1), each)


def test_training_moves_each_weight_by_its_own_gradient():
    k, random = 2 * lm.GROUP, np.random.default_rng(4)
    block = random.integers(0, k, (lm.STEP, lm.WINDOW + 1)).astype(np.int32)
    pairs = random.random((k + 1, k)).astype(np.float32) + 0.1
    start = lm.Weights.fresh(k, 4)
    kept = {n: v.copy() for n, v in vars(start).items()}
    moved, n = lm.train([block], pairs, start, len(block))
    assert n == len(block)
    grad = lm._gradient(start, block[np.random.default_rng(11).permutation(len(block))], pairs)
    for name, was in kept.items():
        assert np.array_equal(getattr(start, name), was)
        g = grad[name]
        want = was - 0.015 * (1 - 1 / 2) * g / (np.abs(g) + 1e-8)
        clear = np.abs(g) > 1e-5
        assert getattr(moved, name)[clear] == pytest.approx(want[clear], abs=1e-4), name


def base_scores(rows):
    """n_tokens, n_known, train_tokens, base_score by counting whole words as text."""
    train = Counter()
    for doc_id, text in rows:
        if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 != 1:
            train.update([*words_of(text), "\n"])
    n, v = sum(train.values()), len(train)
    out = []
    for _, text in rows:
        tokens = [*words_of(text), "\n"]
        score = sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens) if n else len(tokens) * math.log10(0.5 / 0.5)
        out.append((len(tokens), sum(train[t] > 0 for t in tokens), n, score))
    return out


SENTENCES = ["the cat sat on the mat", "a dog ran to the cat", "Über die Straße", "one two three four", "le chat est là ."]


def some_docs(n):
    return [(i, " ".join(SENTENCES[(i * 7 + j * 3) % 5] for j in range(i % 6)) + (f" rare{i}" if i % 3 else "")) for i in range(n)]


@pytest.mark.parametrize("head", [3, 1 << 18])
def test_baseline_equals_counting(spark, docs_of, head):
    rows = [*some_docs(60), (3, None), (None, "the cat"), (61, ""), (7, "repeated row"), (7, "repeated row"), (62, "word " * 300_000)]
    got = lm.score_texts(spark, docs_of(rows).withColumn("row", F.lit("x")).withColumn("n", F.lit(1)), head=head).collect()
    want = sorted((i is None, i or 0, *x) for (i, _), x in zip(rows, base_scores(rows), strict=True))
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [x[:5] for x in found] == [x[:5] for x in want]
    assert [x[5] for x in found] == pytest.approx([x[5] for x in want], rel=1e-7)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert {r.doc_id: r.held_out for r in got if r.doc_id is not None} == {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows if i is not None}


def test_scores_are_the_models(spark, docs_of):
    rows = some_docs(80)
    df = docs_of(rows)
    model, _ = lm.fit(spark, df, F.lit(True), PATH, 100, 500)
    got = {r.doc_id: r.score for r in lm.scored_rows(df.repartition(3), model, (np.zeros(0, np.int64), np.zeros(0))).collect()}
    for i, text in rows[:25]:
        ids = np.array(ids_of(text), np.int64)
        z = np.array([model.start] * (lm.CONTEXT + 1) + model.classes[ids].tolist() + [model.end])
        shares = model.log_shares(z[lm.CONTEXT : -2], ids)
        assert got[i] == pytest.approx((sum(slow_logs(model, z)) + shares.sum()) / math.log(10), abs=1e-3)


def test_a_long_text_has_the_windows_of_one_piece(spark, docs_of):
    text = " ".join(SENTENCES[(j * j) % 5] for j in range(90_000))
    assert len(text) > 1 << 20
    df = docs_of([(1, text), (2, "the cat"), *some_docs(20)[3:]])
    model, _ = lm.fit(spark, df, F.lit(True), PATH, 100, 500)
    got = {r.doc_id: r.score for r in lm.scored_rows(df, model, (np.zeros(0, np.int64), np.zeros(0))).collect()}
    ids = np.array(ids_of(text), np.int64)
    z = np.array([model.start] * (lm.CONTEXT + 1) + model.classes[ids].tolist() + [model.end], np.int32)
    windows = lm.class_windows(z, -1)
    logs = model.log_probabilities(np.maximum(windows, 0))[windows[:, lm.CONTEXT + 1 :] >= 0].sum()
    assert got[1] == pytest.approx((logs + model.log_shares(z[lm.CONTEXT : -2], ids).sum()) / math.log(10), rel=1e-5)


@pytest.mark.parametrize("shard", [100, 1 << 16])
def test_every_training_text_is_learned_from(spark, docs_of, shard):
    # More texts than the two numbers, and each with ids that no other has.
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 600)]
    library = lm.speller(PATH).library
    alone = [c for c in letters if len(library.encode(c)) == 2 and 0 not in library.encode(c)][:150]
    assert len(alone) > 120
    rows = [(i, " ".join([SENTENCES[i % 5]] * 3 + [c] * 4)) for i, c in enumerate(alone)]
    model, _ = lm.fit(spark, docs_of(rows), F.lit(True), PATH, shard, 100)
    often = np.bincount([i for _, text in rows for i in ids_of(text)], minlength=len(model.classes))
    assert (np.bincount(model.classes)[model.classes[often > 0]] == 1).all()
    fresh = lm.Weights.fresh(lm.CLASSES, 11)
    moved = (model.weights.E != fresh.E).any(1)
    assert moved[model.classes[often > 0]].all()


def test_weights_of_shards_are_no_worse_than_one_shards(spark, docs_of):
    rows = [(i, " ".join(SENTENCES[(i + j) % 5] for j in range(40))) for i in range(200)]
    rows += [(1000 + i, SENTENCES[i]) for i in range(5)]
    df, nothing = docs_of(rows), (np.zeros(0, np.int64), np.zeros(0))
    total = {}
    for shard in (200, 1 << 16):
        model, _ = lm.fit(spark, df, F.lit(True), PATH, shard, 1000)
        total[shard] = lm.scored_rows(df, model, nothing).agg(F.sum("score")).first()[0]
    untrained = lm.Model(**{**vars(model), "weights": lm.Weights(**{n: v * (n not in "UG") for n, v in vars(model.weights).items()})})
    plain = lm.scored_rows(df, untrained, nothing).agg(F.sum("score")).first()[0]
    assert total[200] > plain and total[1 << 16] > plain


def test_likely_texts_score_better(spark, docs_of):
    rows = [(i, " ".join(SENTENCES[(i + j) % 5] for j in range(1 + i * 3 % 8))) for i in range(300)]
    rows += [(1000, "the cat sat on the mat"), (1001, "mat the on sat cat the"), (1002, "zq xv kjw pqz vvx qqk")]
    got = {r.doc_id: r.score for r in lm.score_texts(spark, docs_of(rows)).collect()}
    assert got[1000] > max(got[1001], got[1002]) + 3


def test_empty_tables_and_no_training_texts(spark, docs_of):
    assert lm.score_texts(spark, docs_of([])).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = lm.score_texts(spark, docs_of([(only, "a b c")])).collect()[0]
    assert (got.n_tokens, got.n_known, got.train_tokens) == (4, 0, 0)
    assert got.base_score == pytest.approx(0, abs=1e-9)
    assert math.isfinite(got.score)
