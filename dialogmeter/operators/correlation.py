"""Pairwise Pearson correlation of many columns in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmeter.functions.text import nan_to_null
from dialogmeter.session import send_with_jobs

send_with_jobs(__name__)

#: Each row of the matrices is merged by so many tasks first, then by one.
MERGERS = 64
PARTS = ("n", "a", "b", "aa", "bb", "ab")
_SCHEMA = "i int, slot int, " + ", ".join(f"{p} array<double>" for p in PARTS)


class CoMoments:
    """Co-moments of all pairs of columns, each over the rows in which both are present.

    Every part is a matrix: ``n`` the rows of a pair, ``a`` and ``b`` the means of its first and
    second column, ``aa``, ``bb`` and ``ab`` the centred sums of squares and products.
    """

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts

    @classmethod
    def of(cls, rows: np.ndarray) -> CoMoments:
        """Of rows with NaN where a value is missing: a matrix product for each sum."""
        here = ~np.isnan(rows)
        # Shifted by the columns' means, so that the centred sums lose no digits.
        shift = np.where(here, rows, 0).sum(0) / np.maximum(here.sum(0), 1)
        x, m = np.where(here, rows - shift, 0), here.astype(float)
        n = m.T @ m
        a = x.T @ m
        square = (x * x).T @ m
        per = np.maximum(n, 1)
        return cls({
            "n": n, "a": a / per + shift[:, None], "b": a.T / per + shift[None, :],
            "aa": square - a * a / per, "bb": (square - a * a / per).T, "ab": x.T @ x - a * a.T / per,
        })

    def merged(self, other: CoMoments) -> CoMoments:
        p, q = self.parts, other.parts
        n = p["n"] + q["n"]
        per = np.maximum(n, 1)
        gap_a, gap_b, weight = q["a"] - p["a"], q["b"] - p["b"], p["n"] * q["n"] / per
        return CoMoments({
            "n": n, "a": np.where(p["n"] > 0, p["a"] + gap_a * q["n"] / per, q["a"]),
            "b": np.where(p["n"] > 0, p["b"] + gap_b * q["n"] / per, q["b"]),
            "aa": p["aa"] + q["aa"] + gap_a * gap_a * weight, "bb": p["bb"] + q["bb"] + gap_b * gap_b * weight,
            "ab": p["ab"] + q["ab"] + gap_a * gap_b * weight,
        })


def _rows_of(moments: CoMoments, first: int, slot: int) -> pa.RecordBatch:
    k = len(moments.parts["n"])
    columns = [pa.array(np.arange(first, first + k, dtype=np.int32)), pa.array(np.full(k, slot, np.int32))]
    columns += [pa.array(list(moments.parts[p]), pa.list_(pa.float64())) for p in PARTS]
    return pa.RecordBatch.from_arrays(columns, ["i", "slot", *PARTS])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's rows: a row of each matrix per column."""
    from pyspark import TaskContext

    total = None
    for batch in batches:
        if batch.num_rows:
            part = CoMoments.of(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]))
            total = part if total is None else total.merged(part)
    if total is not None:
        yield _rows_of(total, 0, TaskContext.get().partitionId() % MERGERS)


def _merge(table: pa.Table) -> pa.Table:
    """The rows of one column (and slot) from several tasks as one."""
    total = None
    for batch in table.to_batches():
        for r in range(batch.num_rows):
            part = CoMoments({p: np.array(batch.column(p)[r].values.to_numpy())[None, :] for p in PARTS})
            total = part if total is None else total.merged(part)
    return pa.Table.from_batches([_rows_of(total, table.column("i")[0].as_py(), table.column("slot")[0].as_py())])


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long matrix ``(col_a, col_b, r, n)`` over pairwise complete rows.

    One pass over the rows: each Arrow batch is a few matrix products with a mask of what is
    missing, whatever the number of columns, and no row is copied. What tasks send on is one small
    row per column, merged in two steps, so no merging task sees more than a share of the tasks.
    """
    columns = list(columns)
    numbers = df.select(*[nan_to_null(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    slots = numbers.mapInArrow(_partial, _SCHEMA).groupBy("i", "slot").applyInArrow(_merge, _SCHEMA)
    rows = slots.withColumn("slot", F.lit(0)).groupBy("i").applyInArrow(_merge, _SCHEMA)
    names = F.array(*[F.lit(c) for c in columns])
    cells = rows.select("i", F.posexplode(F.arrays_zip(*PARTS)).alias("j", "x"))
    bound = F.greatest(F.least(F.col("x.ab") / (F.sqrt("x.aa") * F.sqrt("x.bb")), F.lit(1.0)), F.lit(-1.0))
    # Rounding leaves a hair of variance in a constant column.
    varies = (F.col("x.aa") > 1e-22 * F.col("x.n") * F.col("x.a") * F.col("x.a")) & (F.col("x.bb") > 1e-22 * F.col("x.n") * F.col("x.b") * F.col("x.b"))
    return cells.select(
        F.get(names, F.col("i")).alias("col_a"), F.get(names, F.col("j")).alias("col_b"),
        F.when(varies & (F.col("x.aa") > 0) & (F.col("x.bb") > 0), bound).alias("r"), F.col("x.n").cast("long").alias("n"))


def wide_matrix(long: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same matrix with one column per variable."""
    return long.groupBy("col_a").pivot("col_b", list(columns)).agg(F.first("r"))
