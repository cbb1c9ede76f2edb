"""Operator 12: embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers, ``x = floor(scale * c)``. The centred matrix A has a row ``x - S / n`` for
each of the n distinct vectors; it is never formed, only blocks of its rows are. Each step is one
pass over the blocks that does both products: ``p = A c`` for the next left vector and ``A'p`` for
the next right one. Left vectors are as long as the table, so they are not kept: each is ``A c`` for
a short ``c``, and its products with a new one follow from the ``A'u`` of earlier steps. Right
vectors, the ``c`` and the ``A'u`` (at most d vectors of d numbers) are held by the driver, which
orthogonalises fully against all of them, twice. The small bidiagonal matrix's SVD gives components
and deviations. One random restart after convergence finds repeated eigenvalues, which a single
sequence cannot see.

Rows with a null vector, or one with a null or non-finite entry, take no part. The dimension is that
of most remaining rows (the larger one of a tie); vectors of another length have no place among
them and take no part either. Entries beyond the range of a long are held at its ends. Only
components with a positive eigenvalue (beyond rounding beside the largest) exist, so n = 1 gives no row, and
few distinct vectors give fewer than ``components`` rows each. ``deviation`` is null where a long cannot hold it. Repeated rows
and null ids give a row each; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmeter.llm.store import ship, stored

SCALE, COMPONENTS = 256, 4
#: Bytes of a block of rows.
BLOCK = 1 << 20
#: A vector this small beside the matrix norm is rounding.
TINY = 1e-12
#: Residual of a component, relative to the largest eigenvalue, at which it has converged.
CONVERGED = 1e-14
#: Steps after the random restart.
PROBE = 12
_LONG = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """Sums of the distinct vectors, unit components (columns) and eigenvalues of their covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    steps: int

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_numbers(table: DataFrame, vector: str, scale: int, kept: list[str]) -> DataFrame:
    """The columns ``kept`` and ``x`` of the rows whose vector has finite entries only."""
    entry = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall(entry, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = table.where(F.col(vector).isNotNull() & finite)
    return rows.select(*kept, F.transform(entry, lambda c: F.floor(c * scale)).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, d)


def _blocks(distinct: DataFrame, d: int) -> DataFrame:
    """part (d low sums, d high sums, rows), block (rows as 64-bit integers) of a few rows each."""
    size = max(1, BLOCK // (8 * d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                x = _matrix(batch.column(0).slice(first, size), d)
                sums = [*(x & 0xFFFFFFFF).sum(0).tolist(), *(x >> 32).sum(0).tolist(), len(x)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sums], pa.list_(pa.int64())), pa.array([x.astype("<i8").tobytes()], pa.binary())], ["part", "block"])

    return distinct.mapInArrow(run, "part array<bigint>, block binary")


class _Products:
    """Sums over the centred rows, one pass each."""

    def __init__(self, blocks: DataFrame, mean: np.ndarray):
        self.blocks, self.mean = blocks.select("block"), mean

    def summed(self, each) -> np.ndarray:
        """The sum over all blocks of ``each``, a function from centred rows to an array."""
        mean = self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for block in batch.column(0):
                    rows = np.frombuffer(block.as_buffer(), "<i8").reshape(-1, len(mean)) - mean
                    part = np.ravel(each(rows))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

        sums = self.blocks.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
        got = sums.collect()  # as many numbers as ``each`` returns: at most d * COMPONENTS
        out = np.zeros(len(got))
        for row in got:
            out[row.i] = row.v
        return out


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        if basis:
            q = np.array(basis)
            v = v - q.T @ (q @ v)
    return v


def bidiagonalise(products: _Products, d: int, wanted: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray, int]:
    """(right singular vectors as columns, squared singular values, steps) of the ``wanted`` largest."""
    random = np.random.default_rng(seed)
    right: list[np.ndarray] = []
    short: list[np.ndarray] = []  # u = A c
    back: list[np.ndarray] = []  # A'u
    columns: list[np.ndarray] = []  # of the bidiagonal matrix; a restart leaves a zero beside the diagonal
    v, norm, probing, steps = random.standard_normal(d), 0.0, 0, 0
    while True:
        v = _orthogonal(v / np.linalg.norm(v), right)
        v = _orthogonal(v / np.linalg.norm(v), right)
        v /= np.linalg.norm(v)
        h = np.array(back) @ v if back else np.zeros(0)
        c = v - np.array(short).T @ h if short else v
        if short:  # the second round of the left orthogonalisation
            more = np.array(back) @ c
            c, h = c - np.array(short).T @ more, h + more
        got = products.summed(lambda rows, c=c: (lambda p: np.append(p @ rows, p @ p))(rows @ c))
        steps += 1
        alpha = float(np.sqrt(max(got[-1], 0.0)))
        norm = max(norm, alpha, float(np.linalg.norm(h)))
        right.append(v)
        new = None
        if alpha > TINY * norm:
            short.append(c / alpha)
            back.append(got[:-1] / alpha)
            h = np.append(h, alpha)
            new = _orthogonal(back[-1], right)
            if np.linalg.norm(new) <= TINY * norm:
                new = None
        columns.append(h)
        b = np.zeros((len(short), len(right)))
        for j, column in enumerate(columns):
            b[: len(column), j] = column
        _, s, vt = np.linalg.svd(b) if len(short) else (None, np.zeros(0), np.zeros((0, len(right))))
        y = np.array(right).T @ vt[: len(s)].T
        y, s = y[:, :wanted], s[:wanted]
        if len(right) == d:
            break
        if len(s) == wanted or new is None:
            residual = np.array(back).T @ (b @ vt[: len(s)].T) - y * s**2 if len(s) else np.zeros((d, 0))
            done = np.linalg.norm(residual, axis=0).max(initial=0) <= CONVERGED * norm**2
            if probing:
                probing -= 1
                if not probing and done:
                    break
                probing = max(probing, 1) if not done else probing
            elif done and len(s) == wanted:
                probing, new = PROBE, None
        v = random.standard_normal(d) if new is None else new
    return y, s**2, steps


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct ``x`` of ``rows``; None without rows."""
    ship(rows.sparkSession)
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).where("d > 0")
    best = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return None
    d = best.d
    blocks = stored(_blocks(rows.where(F.size("x") == d).select("x").distinct(), d), "whitening-blocks")
    totals = blocks.select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    part = {r.i: int(r.v) for r in totals.collect()}  # 2 d + 1 numbers
    n = part[2 * d]
    sums = [part[i] + (part[d + i] << 32) for i in range(d)]
    products = _Products(blocks, np.array([s / n for s in sums]))
    trace = float(products.summed(lambda a: np.array([(a * a).sum()]))[0]) / n
    if n == 1 or trace == 0:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), trace, 0.0, 0)
    y, squared, steps = bidiagonalise(products, d, min(components, d, n - 1))
    real = squared > (TINY * np.sqrt(trace * n)) ** 2
    y, e = y[:, real], squared[real] / n
    k = len(e)
    scaled = y / np.sqrt(e)
    moments = products.summed(lambda a: (lambda w: np.append(np.ravel(w.T @ w), w.sum(0)))(a @ scaled))
    covariance = moments[: k * k].reshape(k, k) / n - np.outer(moments[k * k :], moments[k * k :]) / n**2
    return Whitening(n, sums, y, e, trace, float(np.abs(covariance - np.eye(k)).max(initial=0)), steps)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over all dimensions of (n x - S)**2, None where a long cannot hold it."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums), default=0)
    if most * most * max(1, len(sums)) <= _LONG:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v <= _LONG else None for v in exact]


def whiten(table: DataFrame, vector: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS,
           scale: int = SCALE) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    rows = whole_numbers(table, vector, scale, [id_col])
    model = fit(rows, components)
    schema = T.StructType([
        table.schema[id_col], T.StructField("deviation", T.LongType()), T.StructField("projected", T.ArrayType(T.DoubleType()))])
    if model is None:
        d, model = 0, Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0)
    d = len(model.sums)
    shared = table.sparkSession.sparkContext.broadcast((model.n, model.sums, model.mean(), model.components / np.sqrt(model.eigenvalues)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, mean, scaled = shared.value
        k = scaled.shape[1]
        for batch in batches:
            x = _matrix(batch.column(1), d)
            flat = ((x - mean) @ scaled).ravel()
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(deviations(x, n, sums), pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float64()))], schema.names)

    projected = rows.where(F.size("x") == d).where(F.lit(d > 0)).mapInArrow(run, schema)
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]) if len(model.eigenvalues) else F.lit(None).cast("array<double>")
    return projected.select(id_col, "deviation", F.posexplode("projected").alias("place", "whitened")).select(
        id_col, (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("place")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
