import math

import numpy as np
import pytest

from dialogmeter.llm import whitening

KIND = "vec_id long, embedding array<double>, label int, x string"


def table(spark, vectors, kind=KIND):
    return spark.createDataFrame([(i, v, 0, "a") for i, v in enumerate(vectors)], kind)


def plain(vectors):
    """Covariance and integer rows by numpy, over whole matrices."""
    x = np.floor(np.array(vectors, float) * 256).astype(int)
    distinct = np.unique(x, axis=0)
    centred = distinct - distinct.mean(0)
    return x, distinct, centred.T @ centred / len(distinct)


def check(spark, vectors, wanted=4):
    x, distinct, cov = plain(vectors)
    n, s = len(distinct), distinct.sum(0)
    e = np.sort(np.linalg.eigvalsh(cov))[::-1]
    rows = whitening.whiten(table(spark, vectors)).collect()
    k = min(wanted, int((e > 1e-9 * e[0]).sum()))
    assert len(rows) == k * len(x)
    got = np.full((len(x), k), np.nan)
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n
        assert r.deviation == int(((n * x[r.vec_id] - s) ** 2).sum())
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(cov), rel=1e-9)
        assert r.identity_error < 1e-10
    _, first = np.unique(x, axis=0, return_index=True)
    fitted = got[first]
    assert np.abs(fitted.T @ fitted / n - np.eye(k)).max() < 1e-9
    # The component that a column projects on: it must be an eigenvector.
    centred = x - s / n
    for c in range(k):
        y = np.linalg.lstsq(centred, got[:, c] * math.sqrt(e[c]), rcond=None)[0]
        assert np.abs(cov @ y - e[c] * y).max() < 1e-8 * e[0]


def test_equals_eigenvectors_of_the_whole_covariance(spark):
    random = np.random.default_rng(1)
    vectors = (random.standard_normal((300, 12)) * np.linspace(0.2, 1, 12)).tolist()
    check(spark, [*vectors, *vectors[:50], vectors[0]])


def test_repeated_eigenvalues_are_all_found(spark):
    axes = [[2.0 * (i == j) * sign for j in range(6)] for i in range(6) for sign in (1, -1)]
    check(spark, axes)
    # Three large equal ones beside small ones.
    mixed = [[(4.0 if i < 3 else 1.0) * (i == j) * sign for j in range(9)] for i in range(9) for sign in (1, -1)]
    check(spark, mixed)


def test_few_vectors_have_few_components(spark):
    check(spark, [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]])
    assert whitening.whiten(table(spark, [[1.0, 2.0]] * 3)).count() == 0


def test_rows_that_take_no_part(spark):
    good = [[0.5, -0.25, 0.0], [-0.0, 0.1, 0.9], [0.3, 0.3, -0.7], [0.2, -0.9, 0.4]]
    bad = [None, [], [0.1, None, 0.2], [0.1, math.nan, 0.2], [math.inf, 0.0, 0.0], [0.1, 0.2]]
    rows = whitening.whiten(table(spark, good + bad)).collect()
    assert {r.vec_id for r in rows} == {0, 1, 2, 3}
    assert {r.n for r in rows} == {4}


def test_empty_tables_null_ids_and_clashing_names(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [None, []])).count() == 0
    rows = [(None, [0.1, 0.5], 1, 2.0), (None, [0.7, 0.2], 1, 2.0), (3, [0.3, 0.3], 1, 2.0), (3, [0.3, 0.3], 1, 2.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int, n double")
    out = whitening.whiten(df).collect()
    assert len(out) == 8
    assert sorted(r.vec_id is None for r in out) == [False] * 4 + [True] * 4


def test_entries_beyond_a_long(spark):
    rows = whitening.whiten(table(spark, [[1e300, 0.0], [-1e300, 0.5], [0.0, 1.0]])).collect()
    assert {r.deviation for r in rows if r.vec_id == 0} == {None}
    # Beside such a variance the other one is rounding.
    assert len(rows) == 3


def test_deviations_are_exact():
    x = np.array([[2**40, -(2**40)], [3, 4]])
    assert whitening.deviations(x, 5, [7, 9]) == [None, (15 - 7) ** 2 + (20 - 9) ** 2]
    assert whitening.deviations(x[1:], 5, [7, 9]) == [64 + 121]
