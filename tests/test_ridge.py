import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogmeter import explain_overall
from dialogmeter.operators import ridge

NAMES = ["understandable", "natural", "engaging"]


@pytest.fixture
def data(spark):
    rng = np.random.default_rng(11)
    x = rng.integers(1, 5, size=(160, 3)) + rng.normal(scale=0.1, size=(160, 3))
    y = x @ [0.5, -0.2, 0.9] + rng.normal(scale=0.7, size=160)
    rows = [(i, *map(float, row), float(t)) for i, (row, t) in enumerate(zip(x, y))]
    rows.append((999, None, 1.0, 1.0, 1.0))
    return spark.createDataFrame(rows, "id long, understandable double, natural double, engaging double, overall double")


def arrays(df, test):
    rows = df.where(ridge.is_test_row(["id"]) == F.lit(test)).na.drop().collect()
    return np.array([[r[c] for c in NAMES] for r in rows]), np.array([r.overall for r in rows])


def plain_fit(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return w, y.mean() - w @ x.mean(0)


def scaled_fit(x, y, alpha):
    norm = np.linalg.norm(x - x.mean(0), axis=0)
    w, b = plain_fit(x / norm, y, alpha)
    return w / norm, b


def test_split_is_a_quarter_and_stable(data):
    first = {r.id for r in data.where(ridge.is_test_row(["id"])).collect()}
    again = {r.id for r in data.repartition(7).where(ridge.is_test_row(["id"])).collect()}
    assert first == again and 20 < len(first) < 60


def test_errors_equal_refitting_without_each_row(data):
    x, y = arrays(data, False)
    xt, yt = arrays(data, True)
    for row in ridge.ridge_errors(data, NAMES, "overall", ["id"]).collect():
        left_out = []
        for i in range(len(y)):
            w, b = plain_fit(np.delete(x, i, 0), np.delete(y, i), row.alpha)
            left_out.append((y[i] - x[i] @ w - b) ** 2)
        assert row.loo_mse == pytest.approx(np.mean(left_out))
        w, b = scaled_fit(x, y, row.alpha)
        assert row.test_mse == pytest.approx(np.mean((yt - xt @ w - b) ** 2))


def test_parameters(data):
    errors = {r.alpha: r for r in ridge.ridge_errors(data, NAMES, "overall", ["id"]).collect()}
    best = min(errors, key=lambda a: errors[a].loo_mse)
    got = {r.param: r.value for r in explain_overall(data, ["id"]).collect()}
    assert got["alpha"] == best and got["mse"] == pytest.approx(errors[best].test_mse)
    x = np.vstack([arrays(data, t)[0] for t in (False, True)])
    y = np.concatenate([arrays(data, t)[1] for t in (False, True)])
    w, b = scaled_fit(x, y, best)
    assert [got[f"coef_{n}"] for n in NAMES] == pytest.approx(w)
    assert got["intercept"] == pytest.approx(b)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 403, 9000])
def test_exactly_a_quarter_of_the_rows(spark, n, monkeypatch):
    monkeypatch.setattr(ridge, "_FEW", 5)
    rows = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    got = {r.key for r in rows.where(ridge.exact_test_rows(rows, ["key"])).collect()}
    keys = sorted((int(hashlib.md5(f"k{i}".encode()).hexdigest()[:15], 16), f"k{i}") for i in range(n))
    assert got == {k for _, k in keys[: -(-n // 4)]}
    assert {r.key for r in rows.repartition(7).where(ridge.exact_test_rows(rows, ["key"])).collect()} == got


def test_repeated_keys_stay_together(spark):
    rows = spark.createDataFrame([("a",)] * 50 + [(None,)] * 3 + [("b",), ("c",)], "key string")
    sides = rows.withColumn("is_test", ridge.exact_test_rows(rows, ["key"])).groupBy("key").agg(F.count_distinct("is_test").alias("n")).collect()
    assert {r.n for r in sides} == {1}
