"""Rating columns: which they are, their medians, and their long form."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogmeter.functions.ratings import median_rating
from dialogmeter.functions.text import nan_to_null
from dialogmeter.session import landed

COMPONENT_SCORES = ("ref_score", "context_score", "empty_score")


def quality_columns(columns: Sequence[str], include_components: bool = False) -> list[str]:
    """Columns between ``model`` and the last one, which holds the score.

    Component scores of the averaging modes stand there as well; they are no human ratings and
    are left out unless asked for.
    """
    columns = list(columns)
    between = columns[columns.index("model") + 1 : -1]
    return [c for c in between if include_components or c not in COMPONENT_SCORES]


def median_table(df: DataFrame, qualities: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One median per rating cell, beside the ``keep`` columns."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*keep, *[median_rating(F.col(q), kinds[q]).alias(q) for q in qualities])


def long_form(
    df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "quality", value: str = "rating"
) -> DataFrame:
    """One row per cell: wide to long without a shuffle."""
    return df.unpivot(list(keep), list(columns), name, value)


def grouped_median(votes: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median of ``value`` in every group, where each vote is a row.

    Votes are counted per distinct value first. Those counts are sorted over the whole table, so a
    group with many values lies in several ranges: running sums within a range start from the
    sums of the group's ranges before it, and the one or two values in the middle are picked out.
    No group is collected. Null and NaN votes don't count; a group without votes has no row.
    """
    by = list(by)
    number = nan_to_null(F.col(value).cast("double"))
    counts = votes.select(*by, number.alias("_value")).where("_value is not null").groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("_n"))
    ranged = landed(counts.repartitionByRange(*by, "_value").withColumn("_range", F.spark_partition_id()), "value-counts")
    sums = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_sum"))
    whole = Window.partitionBy(*by)
    # A few rows per group: one for each range it reaches into.
    before = F.sum("_sum").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_part"),
        F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_sum").over(whole).alias("_total"))
    same = reduce(lambda a, b: a & b, [ranged[c].eqNullSafe(sums[f"_by{i}"]) for i, c in enumerate(by)], ranged["_range"] == sums["_part"])
    placed = ranged.join(sums, same)
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_range").orderBy("_value"))

    def holds(place: Column) -> Column:
        return (place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_n"))

    low, high = F.expr("(_total - 1) div 2"), F.expr("_total div 2")
    middle = placed.withColumn("_upto", upto).where(holds(low) | holds(high))
    ends = (F.min("_value") + F.max("_value")) / F.lit(2.0)
    return middle.groupBy(*by).agg(ends.alias(name))
