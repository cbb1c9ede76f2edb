"""Grids of every row beside every row of another table, dealt evenly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_SLOTS = 256


def spread_count(df: DataFrame) -> int:
    """Over how many slots a hot key is spread: a few per core, whatever the shuffle partitions."""
    return max(2, min(MOST_SLOTS, 2 * df.sparkSession.sparkContext.defaultParallelism))


def slot_of(keys: Sequence[Column], slots: Column | int) -> Column:
    """Slot of a row from its values and its input partition.

    Both are the same when a lost task is run again. The partition spreads exact copies, which
    the values alone would keep together.
    """
    count = F.lit(slots) if isinstance(slots, int) else slots
    return F.pmod(F.xxhash64(*keys) + F.spark_partition_id(), count).cast("int")


def every_slot(slots: Column | int) -> Column:
    count = F.lit(slots) if isinstance(slots, int) else slots
    return F.explode(F.sequence(F.lit(0), count - 1))


def pair_with_all(rows: DataFrame, others: DataFrame, spread_by: Sequence[str]) -> DataFrame:
    """Every row beside every row of the shorter table ``others``.

    The result is defined as a full grid, so its size is given. Work is spread by the hash of
    ``spread_by``: an equi-join on the slot, which neither needs ``others`` to fit into a
    broadcast nor meets a hot key.
    """
    slots = spread_count(rows)
    left = rows.withColumn("_slot", slot_of([F.col(c) for c in spread_by], slots))
    right = others.withColumn("_slot", every_slot(slots))
    return left.join(right, "_slot").drop("_slot")
