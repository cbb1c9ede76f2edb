"""Score tables of several metrics side by side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from dialogmeter.session import cut_lineage, landed

# Fixed value: the model name of fresh human answers, left out of one of the comparisons.
HUMAN_MODEL = "New Human Generated"


def not_human(model: str = "model") -> Column:
    """Rows of real models; a missing model name is kept."""
    return ~F.col(model).eqNullSafe(F.lit(HUMAN_MODEL))


def stack_metrics(tables: dict[str, DataFrame], score_col: str = "score", keep: Sequence[str] = ("context", "model")) -> DataFrame:
    """Union of the tables with the metric's name in a column."""
    parts = [
        df.select(*keep, F.lit(name).alias("metric"), F.col(score_col).cast("double").alias("score"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def metrics_side_by_side(
    tables: dict[str, DataFrame], key: Sequence[str] = ("context", "model"),
    score_col: str | dict[str, str] = "score", text_key: Sequence[str] = ("context",),
) -> DataFrame:
    """One row per example with a column ``<metric>_score`` per table.

    Only examples present in every table stay (an inner join). It is one shuffle over all
    tables together: rows meet in a grouped aggregate on the natural key, where long texts of
    the key are replaced by their digest (returned as ``<column>_digest``). A key that occurs
    twice in a table is an error. ``score_col`` names the score column, per table if need be.
    """
    if isinstance(score_col, str):
        score_col = dict.fromkeys(tables, score_col)
    digests = {c: F.sha2(F.col(c), 256).alias(f"{c}_digest") if c in text_key else F.col(c) for c in key}
    parts = [
        df.select(*digests.values(), F.lit(name).alias("_metric"), F.col(score_col[name]).cast("double").alias("_score"))
        for name, df in tables.items()
    ]
    rows = reduce(DataFrame.unionByName, parts)
    names = [c for c in rows.columns if c not in ("_metric", "_score")]
    aggregates = []
    for name in tables:
        here = F.col("_metric") == name
        aggregates.append(F.count_if(here).alias(f"_n_{name}"))
        aggregates.append(F.max(F.when(here, F.col("_score"))).alias(f"_s_{name}"))
    grouped = rows.groupBy(*names).agg(*aggregates)
    in_all = reduce(lambda a, b: a & b, [F.col(f"_n_{name}") > 0 for name in tables])

    def single(name: str) -> Column:
        return F.when(F.col(f"_n_{name}") == 1, F.col(f"_s_{name}")).otherwise(
            F.raise_error(F.lit(f"two rows of metric {name} share one key")).cast("double")
        )

    return grouped.where(in_all).select(*names, *[single(name).alias(f"{name}_score") for name in tables])


def with_row_index(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Consecutive row numbers from 0 in the given order.

    Rows are range-partitioned and sorted, and the sorted copy is kept in the shared folder
    so that numbering and data come from one and the same layout. Partitions are then numbered
    in parallel from their offsets; only one count per partition is summed up. Equal order keys
    are spread by a hash of the whole row, so that a frequent value does not fill one partition.
    """
    spread = F.xxhash64(*df.columns)
    ordered = cut_lineage(df.repartitionByRange(*order, spread).sortWithinPartitions(*order, spread))
    # High bits: partition, low 33 bits: position inside it.
    placed = ordered.withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn(
        "_pos", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    )
    # One row per partition of the layout, so the running sum and the broadcast are small.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos"))
        .drop("_at", "_part", "_pos", "_offset")
    )


def shape_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Row and column counts of the tables, to see that a merge lost nothing."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def merge_audited(
    tables: dict[str, DataFrame], key: Sequence[str] = ("context", "model"),
    score_col: str | dict[str, str] = "score", text_key: Sequence[str] = ("context",), merged_name: str = "merged",
) -> tuple[DataFrame, DataFrame]:
    """(the merged table, ``shape_audit`` of the tables and of the merged one), each table read once.

    The rows are counted on their way into the merge and out of it, while the merged table is
    landed: no table is scanned again for its size.
    """
    seen = {name: Observation(f"rows-{name}") for name in [*tables, merged_name]}

    def counted(name: str, df: DataFrame) -> DataFrame:
        return df.observe(seen[name], F.count(F.lit(1)).alias("n_rows"))

    watched = {name: counted(name, df) for name, df in tables.items()}
    merged = counted(merged_name, metrics_side_by_side(watched, key, score_col, text_key))
    columns = {name: len(df.columns) for name, df in tables.items()} | {merged_name: len(merged.columns)}
    merged = landed(merged, "merged")
    rows = [(name, seen[name].get["n_rows"], columns[name]) for name in seen]
    return merged, merged.sparkSession.createDataFrame(rows, "table_name string, n_rows bigint, n_cols bigint")


def preview(df: DataFrame, order: Sequence[str], rows: int = 5) -> DataFrame:
    """The first rows in a fixed order."""
    return df.orderBy(*order).limit(rows)
