import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from dialogmeter.llm import exact_dedup, near_dedup
from dialogmeter.llm.textbuf import SLICE, words_by_text

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) + rng.choice(["", "", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    base = [prose(rng, rng.choice([1, 4, 5, 30, 300])) for _ in range(60)]
    odd = [None, "", "ÉCOLE", "École", "éCOLE", "ÇA İ", "ça İ", "Ⓐ x", "Ⓐ X", "ǅ", "K", "K", "\n\n", "a\0b"]
    long = prose(rng, 60_000)
    return base + base[:25] + [t.upper() for t in base[:5]] + odd + [long, long.upper(), long[:-1]] + [base[3]] * 40


def check_exact(got, rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(A_Z), []).append(doc_id)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    assert len(by) == len(groups)
    for text, ids in groups.items():
        found = by[hashlib.sha256(text.encode()).hexdigest()]
        keep = max((i for i in ids if i is not None), default=None)
        assert {(r.keep_id, r.group_size) for r in found} == {(keep, len(ids))}
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in found)
        assert [r.doc_id for r in found if r.kept] == [keep]


def test_exact_groups(spark, docs_of, texts):
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[0]), (None, "only null ids"), (None, "only null ids")]
    check_exact(exact_dedup.exact_duplicates(docs_of(rows)).collect(), rows)


def test_exact_groups_with_colliding_identifiers(spark, docs_of, texts, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.pmod(F.hash(*c), F.lit(7)).cast("long"))
    rows = list(enumerate(texts))
    check_exact(exact_dedup.exact_duplicates(docs_of(rows)).collect(), rows)


def test_chunks_join_to_the_text_and_meet_again_after_a_change(spark):
    rng = random.Random(2)
    text = prose(rng, 3000)
    changed = "Some new words. " + text
    df = spark.createDataFrame([(text,), (changed,), ("x" * 5000,)], "t string").select(exact_dedup.chunks("t").alias("c"))
    (a,), (b,), (c,) = df.collect()
    assert "".join(a) == text and "".join(b) == changed and "".join(c) == "x" * 5000
    assert len(set(a) & set(b)) > 0.8 * len(a) and max(map(len, a + b + c)) <= 2048


def test_exact_keep_one(spark, docs_of, texts):
    rows = [*enumerate(texts), (3, texts[3])]
    docs = docs_of(rows).withColumnRenamed("lang", "x_sha")
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert len(got) == len({(t or "").translate(A_Z) for _, t in rows})
    assert exact_dedup.keep_one(docs.limit(0)).count() == 0 and exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def shingle_counts(text):
    words = [w for w in re.split(r"[\t-\r ]+", (text or "").translate(A_Z)) if w]
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] * bool(words)
    out = {}
    for r in runs:
        out[r] = out.get(r, 0) + 1
    return {r: 1 + np.log(n) for r, n in out.items()}


def jaccard(a, b):
    """Probability Jaccard by its definition."""
    if not a or not b:
        return float(len(a) == len(b))
    both = set(a) | set(b)
    total = 0.0
    for d in set(a) & set(b):
        total += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in both)
    return total


def brute_classes(rows):
    sets = [shingle_counts(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and jaccard(sets[i], sets[j]) >= near_dedup.SIMILAR:
                root[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def near_rows():
    rng = random.Random(11)
    rows = []
    for g in range(12):
        words = prose(rng, rng.choice([3, 6, 40, 120])).split()
        rows.append(" ".join(words))
        for _ in range(rng.choice([0, 2, 12])):
            changed = list(words)
            for _ in range(rng.randint(0, 2)):
                changed[rng.randrange(len(changed))] = "changed"
            rows.append(" ".join(changed))
        # A chain: each is near the one before, the ends are not.
        if g == 3:
            chain = prose(rng, 100).split()
            for k in range(10):
                chain[9 * k] = "link" * (k + 1)
                rows.append(" ".join(chain))
    rows += [None, "", "   ", "Same five words are here", "same FIVE words are\nhere", "one two"]
    return [*enumerate(rows), (2, rows[2]), (None, rows[2]), (None, "nobody else says this at all")]


def partition(rows, got):
    """Rows grouped by class, as sorted lists of (id, text)."""
    return sorted(sorted(str(rows[i][0]) for i in c) for c in got)


@pytest.mark.parametrize("small", [8, 0])
def test_near_classes_equal_all_pairs(spark, docs_of, small, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rows = near_rows()
    got = near_dedup.near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    want = partition(rows, brute_classes(rows))
    # Classes are told apart by their smallest id; the one without ids is its own.
    found = {}
    for r in got:
        found.setdefault(r.class_id, []).append(str(r.doc_id))
    assert sorted(map(sorted, found.values())) == want
    for r in got:
        assert r.class_size == len(found[r.class_id])
    assert sum(r.kept for r in got) == len(want)


def test_near_keep_one(spark, docs_of):
    rows = near_rows()
    docs = docs_of(rows).withColumnRenamed("lang", "x_key")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(brute_classes(rows))
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(1)
    element = rng.integers(1, 2**48, 700).astype(np.uint64)
    weight = 1 + np.log(rng.integers(1, 9, 700))
    a, b = slice(0, 500), slice(60, 700)
    found = near_dedup.registers(
        np.repeat([0, 1], [500, 640]), np.concatenate([element[a], element[b]]), np.concatenate([weight[a], weight[b]]), 2)
    order = lambda s: (np.sort(element[s]), weight[s][np.argsort(element[s])])
    exact = near_dedup.probability_jaccard(order(a), order(b))
    named = [dict(zip(element[s].tolist(), weight[s], strict=True)) for s in (a, b)]
    assert exact == pytest.approx(jaccard(*named))
    assert abs((found[0] == found[1]).mean() - exact) < 0.15


def test_one_arrival_fills_a_text_of_one_element():
    found = near_dedup.registers(np.array([0]), np.array([5], np.uint64), np.array([1.0]), 2)
    assert (found[0] == 5).all() and not found[1].any()


def test_words_of_long_texts_are_whole():
    import pyarrow as pa

    rng = random.Random(3)
    long = prose(rng, 400_000)
    assert len(long) > SLICE
    column = pa.array(["a b", None, long, "", "C c", "x" * (SLICE + 10)])
    found = []
    for _, words, counts in words_by_text(column):
        ends = np.cumsum(counts)
        found += [words[e - c : e] for c, e in zip(counts, ends, strict=True)]
    assert [len(w) for w in found] == [len((t or "").split()) for t in column.to_pylist()]
    assert found[4][0] == found[4][1] and len(set(found[2].tolist())) == len(set(long.split()))


def edited(words, rng, n):
    """The words with ``n`` of them changed, none within a run of another."""
    out = list(words)
    for k in rng.sample(range(4, len(words) - 4, 5), n):
        out[k] = f"new{rng.randrange(10**9)}"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_meet_in_their_original_only(spark, docs_of, seed):
    rng = random.Random(seed)
    original = prose(rng, 104).split()
    copies = [edited(original, rng, 2) for _ in range(300)]
    rows = list(enumerate(" ".join(w) for w in [*copies[:200], original, *copies[200:]]))
    sets = [shingle_counts(t) for _, t in rows[198:203]]
    assert jaccard(sets[0], sets[2]) >= near_dedup.SIMILAR > jaccard(sets[0], sets[1])
    got = near_dedup.near_duplicates(docs_of(rows)).collect()
    assert {(r.class_id, r.class_size) for r in got} == {(0, 301)}


@pytest.mark.parametrize("block, small", [(2048, 64), (4, 64), (4, 0), (7, 2)])
def test_every_pair_of_two_classes_that_can_be_linked_leaves_once(spark, docs_of, block, small, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rng = random.Random(4)
    texts = []
    for size in (30, 12, 2, 2):
        words = prose(rng, 104).split()
        texts += [" ".join(edited(words, rng, rng.choice([1, 2, 4]))) for _ in range(size)]
    docs = docs_of(list(enumerate(texts))).withColumnRenamed("doc_id", "node")
    bands = {r.doc_id: r.bands for r in near_dedup.signatures(docs.withColumnRenamed("node", "doc_id")).collect()}
    sketch = {r.node: np.frombuffer(r.sketch, np.uint8) for r in near_dedup.sketches(docs).collect()}
    # Three classes of any members, one of them large.
    root = {i: (0 if i < 20 else 1 + i % 2) for i in bands}
    members = spark.createDataFrame([(b, i, root[i]) for i, own in bands.items() for b in own], "bucket long, node long, root long")
    known = spark.createDataFrame([(i, bytearray(sketch[i].tobytes()), bands[i]) for i in bands], "node long, sketch binary, bands array<bigint>")
    got = sorted((r.a, r.b) for r in near_dedup.across_classes(members, known).collect())
    want = [
        (a, b) for a in bands for b in bands
        if a < b and root[a] != root[b] and set(bands[a]) & set(bands[b]) and (sketch[a] == sketch[b]).mean() >= near_dedup.LEAST_AGREEMENT
    ]
    assert got == sorted(want) and want


def test_members_of_two_pivots_meet(spark, docs_of, monkeypatch):
    """Chains p - x - y - q of one bucket each, where p and q may be the pivots."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows, bucket = [], {}
    for chain in range(12):
        words = prose(rng, 104).split()
        steps = [words]
        for k in range(3):
            steps.append([f"s{chain}x{k}" if i in (10 + 30 * k, 20 + 30 * k) else w for i, w in enumerate(steps[-1])])
        p, x, y, q = (" ".join(s) for s in steps)
        for text in (p, q, x, y):
            bucket[len(rows)] = chain
            rows.append((len(rows), text))
    sets = [shingle_counts(t) for _, t in rows[:4]]
    assert jaccard(sets[2], sets[3]) >= near_dedup.SIMILAR > max(jaccard(sets[0], sets[1]), jaccard(sets[0], sets[3]), jaccard(sets[1], sets[2]))
    signatures, of = near_dedup.signatures, spark.createDataFrame(list(bucket.items()), "doc_id long, bucket long")
    monkeypatch.setattr(near_dedup, "signatures", lambda docs: signatures(docs).drop("bands").join(of, "doc_id").select(
        "doc_id", "key", "same", F.array("bucket").alias("bands")))
    monkeypatch.setattr(near_dedup, "PIVOTS", 2)
    got = near_dedup.near_duplicates(docs_of(rows)).collect()
    assert sorted(r.class_size for r in got) == [4] * 48


@pytest.mark.parametrize("tile, packed", [(256, 1 << 18), (7, 50)])
def test_members_that_are_nearly_near_are_not_paired_row_by_row(spark, docs_of, tile, packed, monkeypatch):
    """Most of the 1770 pairs can be linked by their sketches, few are."""
    for name, value in (("PIVOTS", 1), ("TILE", tile), ("PACKED", packed)):
        monkeypatch.setattr(near_dedup, name, value, raising=False)
    rng = random.Random(6)
    original = prose(rng, 220).split()
    rows = list(enumerate(" ".join(edited(original, rng, 3)) for _ in range(60)))
    similarities, asked = near_dedup.similarities, []

    def counted(pairs):
        asked.append(pairs.count())
        return similarities(pairs)

    monkeypatch.setattr(near_dedup, "similarities", counted)
    found = {}
    for r in near_dedup.near_duplicates(docs_of(rows)).collect():
        found.setdefault(r.class_id, []).append(str(r.doc_id))
    # Of the members' pairs only those with pivots are rows.
    assert sum(asked) < 10 * len(rows)
    held = near_dedup.elements(pa.array([t for _, t in rows]))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and near_dedup.probability_jaccard(held[i], held[j]) >= near_dedup.SIMILAR:
                root = [root[j] if r == root[i] else r for r in root]
    want = partition(rows, [[i for i in range(len(rows)) if root[i] == r] for r in set(root)])
    assert sorted(map(sorted, found.values())) == want and 1 < len(want) < len(rows)
