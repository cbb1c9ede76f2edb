import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dialogmeter import evaluate, score
from dialogmeter.functions.pvalue import correlation_p_value
from dialogmeter.operators import regression
from dialogmeter.operators.annotations import grouped_median
from dialogmeter.operators.correlation import correlation_matrix, wide_matrix
from dialogmeter.plans.workflows import compare_components, compare_metrics, correlate, rating_correlation, rating_lines


def p_by_integration(r, n):
    """Share of the integral of cos(t)^(n-3) beyond asin(|r|)."""

    def area(lo):
        t = np.linspace(lo, math.pi / 2, 400_001)
        return np.trapezoid(np.cos(t) ** (n - 3), t)

    return area(math.asin(min(abs(r), 1.0))) / area(0.0)


CASES = [(0.0, 10), (0.3, 3), (0.99, 3), (0.9, 5), (-0.9, 5), (0.7, 12), (0.71, 12), (0.2, 50), (0.6, 60), (0.75, 70), (0.04, 1242), (0.108393, 1242), (0.5, 100)]


def test_p_value(spark):
    df = spark.createDataFrame(CASES, "r double, n long").select("r", "n", correlation_p_value(F.col("r"), F.col("n")).alias("p"))
    for row in df.collect():
        assert row.p == pytest.approx(p_by_integration(row.r, row.n), rel=2e-5, abs=1e-13)


def test_p_value_of_known_results(spark):
    # Correlations published with six digits beside their p-values.
    known = [(0.041342, 240, 0.523864), (0.134749, 240, 0.036966), (0.227694, 300, 0.000069), (0.01574, 375, 0.761281), (0.032037, 1242, 0.259236), (0.082584, 1186, 0.004429)]
    df = spark.createDataFrame(known, "r double, n long, want double")
    for row in df.withColumn("p", correlation_p_value(F.col("r"), F.col("n"))).collect():
        assert row.p == pytest.approx(row.want, abs=1e-5)


def test_p_value_edges(spark):
    rows = [(1.0, 10), (-1.0, 4), (0.5, 2), (None, 10), (0.01, 10**9), (1e-5, 10**10)]
    out = [r.p for r in spark.createDataFrame(rows, "r double, n long").select(correlation_p_value(F.col("r"), F.col("n")).alias("p")).collect()]
    assert out[:4] == [0.0, 0.0, None, None]
    assert out[4] == pytest.approx(0.0, abs=1e-300)
    assert out[5] == pytest.approx(math.erfc(1 / math.sqrt(2)), rel=1e-8)


@pytest.fixture
def points(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in ("a", "b"):
        x = rng.normal(size=50)
        y = 2 * x + rng.normal(size=50)
        rows += [(g, float(u), float(v)) for u, v in zip(x, y)]
    rows += [("a", None, 1.0), ("a", 1.0, float("nan")), ("flat_x", 1.0, 2.0), ("flat_x", 1.0, 3.0), ("flat_x", 1.0, 4.0)]
    rows += [("flat_y", 1.0, 2.0), ("flat_y", 2.0, 2.0), ("flat_y", 4.0, 2.0), ("two", 0.0, 1.0), ("two", 1.0, 3.0), ("one", 1.0, 1.0)]
    return spark.createDataFrame(rows, "g string, x double, y double")


def fits_by_group(df):
    return {r.g: r for r in df.collect()}


def test_regression_equals_least_squares(points):
    fits = fits_by_group(regression.linear_regression(points, "x", "y", ["g"]))
    for g in "ab":
        rows = [(r.x, r.y) for r in points.where(F.col("g") == g).collect() if r.x is not None and not math.isnan(r.y)]
        x, y = np.array(rows).T
        slope, intercept = np.polyfit(x, y, 1)
        r = np.corrcoef(x, y)[0, 1]
        stderr = math.sqrt((1 - r * r) * ((y - y.mean()) ** 2).sum() / ((x - x.mean()) ** 2).sum() / (len(x) - 2))
        got = fits[g]
        assert (got.slope, got.intercept, got.r, got.stderr) == pytest.approx((slope, intercept, r, stderr))
        assert got.n == 50 and got.r2 == pytest.approx(r * r)


def test_degenerate_groups(points):
    fits = fits_by_group(regression.linear_regression(points, "x", "y", ["g"]))
    assert fits["flat_x"].slope is None and fits["flat_x"].r is None and fits["flat_x"].p is None and fits["flat_x"].stderr is None
    assert (fits["flat_y"].slope, fits["flat_y"].r, fits["flat_y"].p) == (0.0, 0.0, 1.0)
    assert fits["two"].slope == 2.0 and fits["two"].p is None and fits["two"].stderr is None
    assert fits["one"].slope is None and fits["one"].n == 1


def test_null_pairs_can_make_a_fit_undefined(points):
    fits = fits_by_group(regression.linear_regression(points, "x", "y", ["g"], nulls="propagate"))
    assert fits["a"].r is None and fits["b"].r is not None
    with pytest.raises(ValueError):
        regression.linear_regression(points, "x", "y", nulls="drop")


def test_report(spark):
    fits = spark.createDataFrame([("q", 0.0413421, 0.5, 10), ("z", -0.0005, 1.0, 3)], "g string, r double, p double, n long")
    rows = {r.g: r for r in regression.correlation_report(fits, "g").collect()}
    assert rows["q"].label == "q: $R=$0.041342\n p=0.5"
    assert rows["z"].label == "z: $R=$-0.0005\n p=1.0"
    assert regression.correlation_report(fits).where("n = 10").first().label == "$R=$0.041342\n p=0.5"


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_fitted_line_with_and_without_broadcast(spark, points, limit):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        rows = regression.fitted_line(points, "x", "y", ["g"])
        got = rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    fits = fits_by_group(regression.linear_regression(points, "x", "y", ["g"]))
    assert len(got) == points.count()
    for r in got:
        if fits[r.g].slope is None or r.x is None:
            assert r.y_hat is None
        else:
            assert r.y_hat == pytest.approx(fits[r.g].intercept + fits[r.g].slope * r.x)
    assert ("BroadcastHashJoin" in plan) or limit == "-1"


def test_fitted_line_of_a_null_group_and_without_groups(spark):
    rows = [(None, 0.0, 1.0), (None, 1.0, 3.0), (None, 2.0, 5.0), ("a", 0.0, 0.0), ("a", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    assert sorted((str(r.g), r.x, r.y_hat) for r in regression.fitted_line(df, "x", "y", ["g"]).collect()) == [
        ("None", 0.0, 1.0), ("None", 1.0, 3.0), ("None", 2.0, 5.0), ("a", 0.0, 0.0), ("a", 1.0, 1.0)]
    whole = regression.fitted_line(df.where("g is null"), "x", "y")
    assert whole.columns == ["x", "y", "y_hat"] and all(r.y == pytest.approx(r.y_hat) for r in whole.collect())


def test_labels(spark):
    fits = spark.createDataFrame([("q", 0.5, 0.25, None)], "g string, r double, r2 double, p double")
    assert fits.select(regression.report_label(F.col("g"), 3, r2=True).alias("l")).first().l == "q: $R=$0.5, $R^2=$0.25\n p=nan"


def test_correlation_matrix(spark):
    rows = [(1.0, 2.0, None, 1.0), (2.0, 1.0, 5.0, 1.0), (3.0, 5.0, 6.0, 1.0), (4.0, 4.0, 1.0, 1.0), (5.0, float("nan"), 2.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    got = {(r.col_a, r.col_b): (r.r, r.n) for r in correlation_matrix(df, list("abck")).collect()}
    data = {c: [r[i] for r in rows] for i, c in enumerate("abck")}
    for a in "abc":
        for b in "abc":
            pairs = [(x, y) for x, y in zip(data[a], data[b]) if x is not None and y is not None and not math.isnan(x) and not math.isnan(y)]
            x, y = np.array(pairs).T
            assert got[(a, b)] == (pytest.approx(np.corrcoef(x, y)[0, 1]), len(pairs))
    assert got[("k", "a")] == (None, 5) and got[("k", "k")] == (None, 5)
    wide = {r.col_a: r for r in wide_matrix(correlation_matrix(df, ["a", "b"]), ["a", "b"]).collect()}
    assert wide["a"].b == wide["b"].a == pytest.approx(got[("a", "b")][0])


SCORED = [
    ("c", "m1", "[1, 2]", "[3]", 0.1, 0.4), ("c", "m2", "[2]", "[1]", 0.7, 0.5), ("d", "m1", "[N/A]", "[2]", 0.9, 0.1), ("e", "m1", "[4]", "[5]", 0.8, 0.2),
]


def test_workflows_on_a_scored_table(spark):
    scored = spark.createDataFrame(SCORED, "context string, model string, natural string, overall string, ref_score double, score double")
    fits = {r.quality: r for r in correlate(scored).collect()}
    assert set(fits) == {"natural", "overall"}
    assert fits["natural"].n == 3
    assert fits["natural"].r == pytest.approx(np.corrcoef([0.4, 0.5, 0.2], [1.5, 2, 4])[0, 1])
    assert rating_correlation(scored).count() == 4
    assert rating_lines(scored).count() == 8
    assert set(r.quality for r in correlate(scored, ["ref_score"]).collect()) == {"ref_score"}


def test_components_against_the_combined_score(spark):
    rows = [(0.1, 0.3, 1.0), (0.2, 0.1, 1.0), (0.4, 0.2, 0.5), (0.9, 0.9, None)]
    df = spark.createDataFrame(rows, "score double, ref_score double, win_ratio double")
    got = compare_components(df, ["ref_score"]).first()
    assert got.n == 3 and got.r == pytest.approx(np.corrcoef([0.1, 0.2, 0.4], [0.3, 0.1, 0.2])[0, 1])


def test_metrics_against_each_other(spark):
    base = [("a", "m1", 1.0), ("b", "m1", 2.0), ("c", "New Human Generated", 9.0), ("d", None, 4.0)]
    other = [(c, m, s * 2 + (c == "c")) for c, m, s in base]
    tables = {n: spark.createDataFrame(r, "context string, model string, score double") for n, r in (("one", base), ("two", other))}
    got = {r.scope: r for r in compare_metrics(tables, [("one", "two")]).collect()}
    assert got["all"].n == 4 and got["excl_human"].n == 3
    assert got["excl_human"].r == pytest.approx(1.0) and (got["all"].x_name, got["all"].y_name) == ("one", "two")


def test_evaluate_scores_and_reports(spark):
    rows = [
        (f"c{i}\nlast {'w ' * (i % 5)}", "r " * (i % 4 + 1), "x " * (i % 7 + 1), f"m{i % 3}", f"[{i % 2}, 1, 0]", f"[{i % 3 + 1}]", f"[{i % 5}, {i % 4}]")
        for i in range(60)
    ]
    table = spark.createDataFrame(rows, "context string, ref string, cand string, model string, natural string, engaging string, overall string")
    got = evaluate(table, "bleu", "ref")
    assert {r.quality for r in got["fits"].collect()} == {"natural", "engaging", "overall"}
    assert got["matrix"].count() == 9
    assert [r.param for r in got["ridge"].collect()] == ["alpha", "mse", "coef_natural", "coef_engaging", "intercept"]
    direct = {r.quality: r.r for r in correlate(score(table, "bleu", "ref")).collect()}
    assert {r.quality: r.r for r in got["fits"].collect()} == pytest.approx(direct)


def test_wide_matrix_with_gaps_equals_pairwise_correlation(spark):
    rng = np.random.default_rng(7)
    k, n = 200, 600
    rows = rng.normal(size=(n, 5)) @ rng.normal(size=(5, k)) + rng.normal(size=(n, k)) + 1e6 * (np.arange(k) % 3)
    rows[rng.random((n, k)) < 0.2] = np.nan
    rows[:, 7] = 3.3
    rows[:, 9] = np.nan
    names = [f"v {i}" for i in range(k)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=names)).repartition(5)
    got = np.full((k, k), np.nan)
    sizes = np.zeros((k, k), int)
    for r in correlation_matrix(df, names).collect():
        i, j = names.index(r.col_a), names.index(r.col_b)
        got[i, j], sizes[i, j] = np.nan if r.r is None else r.r, r.n
    want = pd.DataFrame(rows).corr().to_numpy()
    want[7, :] = want[:, 7] = np.nan
    here = ~np.isnan(rows)
    assert (sizes == here.astype(int).T @ here.astype(int)).all()
    assert np.allclose(got, want, atol=1e-9, equal_nan=True)


def test_matrix_reads_the_rows_once(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "a double, b double")
    plan = correlation_matrix(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "Expand" not in plan


def test_median_of_a_hot_group(spark):
    rng = np.random.default_rng(8)
    rows = [("hot", float(v)) for v in rng.normal(size=4001)] + [("even", float(v)) for v in (4, 1, 3, 2)]
    rows += [("same", 5.0)] * 1000 + [("one", -1.0), ("none", None), ("none", math.nan), (None, 2.0), (None, 4.0)]
    got = {r.g: r.median for r in grouped_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    hot = float(np.median([v for g, v in rows if g == "hot"]))
    assert got == {"hot": hot, "even": 2.5, "same": 5.0, "one": -1.0, None: 3.0}


def test_cells_of_a_plot(spark):
    rows = [("a", 0.0, 0.0), ("a", 10.0, 10.0), ("a", 9.99, 5.0), ("b", 5.0, 5.0), ("b", None, 1.0), ("b", math.nan, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {(r.g, r.x_cell, r.y_cell): r.n for r in regression.point_cells(df, "x", "y", ["g"], cells=2).collect()}
    assert got == {("a", 0, 0): 1, ("a", 1, 1): 2, ("b", 1, 1): 1}
    flat = regression.point_cells(df.withColumn("x", F.lit(1.0)), "x", "y", cells=3).collect()
    assert {r.x_cell for r in flat} == {0} and sum(r.n for r in flat) == 6
    assert regression.point_cells(df.limit(0), "x", "y").count() == 0
