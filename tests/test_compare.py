import pytest
from pyspark.sql import functions as F

from dialogmeter.operators import compare, joins


def table(spark, rows):
    return spark.createDataFrame(rows, "context string, model string, score double")


def test_side_by_side_is_an_inner_join(spark):
    tables = {
        "one": table(spark, [("a", "m", 1.0), ("b", "m", None), ("c", "m", 3.0)]),
        "two": table(spark, [("a", "m", 5.0), ("b", "m", 6.0), ("d", "m", 7.0)]),
    }
    wide = compare.metrics_side_by_side(tables)
    assert wide.columns == ["context_digest", "model", "one_score", "two_score"]
    assert sorted((r.one_score or 0, r.two_score) for r in wide.collect()) == [(0, 6.0), (1.0, 5.0)]


def test_duplicate_key_is_an_error(spark):
    tables = {"one": table(spark, [("a", "m", 1.0), ("a", "m", 2.0)]), "two": table(spark, [("a", "m", 5.0)])}
    with pytest.raises(Exception, match="share one key"):
        compare.metrics_side_by_side(tables).collect()


def test_score_column_per_table(spark):
    tables = {"one": table(spark, [("a", "m", 1.0)]).withColumnRenamed("score", "old"), "two": table(spark, [("a", "m", 5.0)])}
    row = compare.metrics_side_by_side(tables, score_col={"one": "old", "two": "score"}).first()
    assert (row.one_score, row.two_score) == (1.0, 5.0)


def test_row_index_is_consecutive(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("hot"), ((F.col("id") * 37) % 1000).alias("key"))
    rows = compare.with_row_index(df.repartition(7), ["key"]).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(1000))
    assert [r.key for r in rows] == list(range(1000))
    ties = compare.with_row_index(df.repartition(5), ["hot"]).collect()
    assert sorted(r.row_id for r in ties) == list(range(1000))
    assert max(r.row_id for r in ties if r.hot == 0) < min(r.row_id for r in ties if r.hot == 1)


def test_row_index_of_an_empty_table(spark):
    assert compare.with_row_index(spark.range(0), ["id"]).collect() == []


def test_stack_filter_audit_preview(spark):
    one = table(spark, [("a", "m", 1.0), ("b", compare.HUMAN_MODEL, 2.0), ("c", None, 3.0)])
    stacked = compare.stack_metrics({"x": one, "y": one})
    assert stacked.count() == 6 and set(stacked.columns) == {"context", "model", "metric", "score"}
    assert sorted(r.context for r in one.where(compare.not_human()).collect()) == ["a", "c"]
    audit = {r.table_name: (r.n_rows, r.n_cols) for r in compare.shape_audit({"one": one, "two": stacked}).collect()}
    assert audit == {"one": (3, 3), "two": (6, 4)}
    assert [r.context for r in compare.preview(one, ["context"], 2).collect()] == ["a", "b"]


def test_pairs_with_all_rows_of_the_other_table(spark):
    rows, others = spark.range(20).withColumnRenamed("id", "a"), spark.range(5).withColumnRenamed("id", "b")
    grid = joins.pair_with_all(rows, others, ["a"])
    assert sorted((r.a, r.b) for r in grid.collect()) == [(a, b) for a in range(20) for b in range(5)]
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_audit_on_the_way_through_a_merge(spark, tmp_path):
    paths = {}
    for name, rows in (("one", [("a", "m", 1.0), ("b", "m", 2.0)]), ("two", [("a", "m", 5.0)])):
        paths[name] = str(tmp_path / name)
        table(spark, rows).write.parquet(paths[name])
    tables = {name: spark.read.parquet(path) for name, path in paths.items()}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("audit", "audit")
    merged, audit = compare.merge_audited(tables)
    jobs = len(tracker.getJobIdsForGroup("audit"))
    got = {r.table_name: (r.n_rows, r.n_cols) for r in audit.collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {"one": (2, 3), "two": (1, 3), "merged": (1, 4)}
    assert merged.count() == 1
    # The shuffles of the merge and its result; nothing is counted apart.
    assert jobs <= 4
