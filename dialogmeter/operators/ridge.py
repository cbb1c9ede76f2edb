"""Ridge regression of one rating on the others.

Two passes over the data whatever its size: one for the moments of each split, one for the
leave-one-out and test errors of all candidate penalties. Only k-by-k moments (k = number of
rating columns) reach the driver, where the linear systems are solved.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmeter.session import cut_lineage, landed

# Fixed value: the penalties tried.
ALPHAS = (0.1, 1.0, 10.0)
TEST_SHARE = 4
#: Bits of a key's digest, those that one histogram looks at, and keys that need no further one.
_DIGEST_BITS, _STEP_BITS, _FEW = 60, 12, 4096


def is_test_row(key: Sequence[str], one_in: int = TEST_SHARE) -> Column:
    """One in four rows, decided by a digest of the row's key: the same on every run and layout."""
    return F.conv(F.substring(F.md5(_key_text(key)), 1, 8), 16, 10).cast("bigint") % one_in == 0


def _key_digest(key: Sequence[str]) -> Column:
    """60 bits of the key's digest, as a number."""
    return F.conv(F.substring(F.md5(_key_text(key)), 1, 15), 16, 10).cast("bigint")


def _key_text(key: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in key])


def smallest_digests(df: DataFrame, key: Sequence[str], rows: int) -> Column:
    """Whether a row is among the ``rows`` with the smallest key digests, ties by the key itself.

    The last one's digest is found by counting: a histogram of the leading bits tells which bucket
    holds it, the next histogram looks into that bucket only, until few keys are left. Nothing is
    sorted, and the driver sees one histogram at a time. Rows with one key are on the same side.
    """
    found = landed(df.select(_key_digest(key).alias("digest"), _key_text(key).alias("text")), "digests")
    prefix, shift, left = 0, _DIGEST_BITS, rows
    inside = found
    while True:
        if shift < _DIGEST_BITS:
            inside = found.where(F.shiftright("digest", shift) == prefix)
        if shift == 0 or inside.limit(_FEW + 1).count() <= _FEW:
            break
        shift -= _STEP_BITS
        counts = inside.groupBy(F.shiftright("digest", shift).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()
        for bucket in sorted(counts, key=lambda r: r.bucket):  # 2 ** _STEP_BITS of them at most
            if bucket.n >= left:
                prefix = bucket.bucket
                break
            left -= bucket.n
        else:
            return F.lit(True)  # there are no more rows than asked for
    last = None
    for keys in sorted(inside.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n")).collect()):
        if left <= 0:
            break
        last, left = keys, left - keys.n
    if rows <= 0 or last is None:
        return F.lit(False)
    digest = _key_digest(key)
    return (digest < last.digest) | ((digest == last.digest) & (_key_text(key) <= last.text))


def exact_test_rows(df: DataFrame, key: Sequence[str], one_in: int = TEST_SHARE) -> Column:
    """One in ``one_in`` rows, rounded up: that number exactly, and the same rows on every run and layout."""
    return smallest_digests(df, key, -(-df.count() // one_in))


def split_rows(df: DataFrame, features: Sequence[str], target: str, key: Sequence[str], exact: bool = False) -> DataFrame:
    """Complete rows as numbers, with their split: about a quarter for the test, or exactly a quarter."""
    names = [*features, target]
    complete = df.na.drop(subset=names)
    if exact:
        complete = landed(complete.select(*key, *names), "complete-rows")
    is_test = exact_test_rows(complete, key) if exact else is_test_row(key)
    return complete.select(is_test.alias("is_test"), *[F.col(c).cast("double").alias(c) for c in names])


def split_moments(rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Row count, means and centred cross products of the training and the test rows."""
    names = [*features, target]
    aggregates = [F.count(F.lit(1)).alias("n")]
    aggregates += [F.avg(c).alias(f"mean_{c}") for c in names]
    for i, a in enumerate(names):
        for b in names[i:]:
            aggregates.append((F.covar_pop(a, b) * F.count(F.lit(1))).alias(f"s_{a}_{b}"))
    return rows.groupBy("is_test").agg(*aggregates)


@dataclass
class Moments:
    n: float
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def from_row(cls, row, names: Sequence[str]) -> "Moments":
        k = len(names)
        scatter = np.zeros((k, k))
        for i, a in enumerate(names):
            for j in range(i, k):
                scatter[i, j] = scatter[j, i] = row[f"s_{a}_{names[j]}"]
        return cls(float(row["n"]), np.array([row[f"mean_{c}"] for c in names]), scatter)

    def merge(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(
            n,
            self.mean + gap * other.n / n,
            self.scatter + other.scatter + np.outer(gap, gap) * self.n * other.n / n,
        )

    def ridge(self, alpha: float) -> np.ndarray:
        """Weights on centred features, the last variable being the target."""
        xx, xy = self.scatter[:-1, :-1], self.scatter[:-1, -1]
        return np.linalg.solve(xx + alpha * np.eye(len(xy)), xy)

    def unit_norm_ridge(self, alpha: float) -> np.ndarray:
        """Ridge on features scaled to unit length, weights in the original units."""
        xx, xy = self.scatter[:-1, :-1], self.scatter[:-1, -1]
        length = np.sqrt(np.diag(xx))
        length = np.where(length > 0, length, 1.0)
        scaled = xx / np.outer(length, length) + alpha * np.eye(len(xy))
        return np.linalg.solve(scaled, xy / length) / length


def _prediction(features: Sequence[str], weights: np.ndarray, mean: np.ndarray) -> Column:
    out = F.lit(float(mean[-1]))
    for name, weight, centre in zip(features, weights, mean):
        out = out + F.lit(float(weight)) * (F.col(name) - F.lit(float(centre)))
    return out


def _leverage(features: Sequence[str], inverse: np.ndarray, mean: np.ndarray, n: float) -> Column:
    out = F.lit(1.0 / n)
    centred = [F.col(name) - F.lit(float(m)) for name, m in zip(features, mean)]
    for i, left in enumerate(centred):
        for j, right in enumerate(centred):
            out = out + F.lit(float(inverse[i, j])) * left * right
    return out


def penalty_errors(
    rows: DataFrame, features: Sequence[str], target: str, train: Moments, alphas: Sequence[float]
) -> DataFrame:
    """Leave-one-out error on the training rows and test error, one row per penalty."""
    cells = []
    for alpha in alphas:
        xx = train.scatter[:-1, :-1]
        inverse = np.linalg.inv(xx + alpha * np.eye(len(features)))
        residual = F.col(target) - _prediction(features, train.ridge(alpha), train.mean)
        left_out = residual / (F.lit(1.0) - _leverage(features, inverse, train.mean, train.n))
        final = F.col(target) - _prediction(features, train.unit_norm_ridge(alpha), train.mean)
        cells.append(
            F.struct(
                F.lit(float(alpha)).alias("alpha"),
                F.when(~F.col("is_test"), left_out * left_out).alias("loo"),
                F.when(F.col("is_test"), final * final).alias("test"),
            )
        )
    return (
        rows.select(F.inline(F.array(*cells)))
        .groupBy("alpha")
        .agg(F.avg("loo").alias("loo_mse"), F.avg("test").alias("test_mse"))
    )


def _read_moments(rows: DataFrame, features: Sequence[str], target: str) -> dict[bool, Moments]:
    # At most two rows: training and test.
    names = [*features, target]
    return {row["is_test"]: Moments.from_row(row, names) for row in split_moments(rows, features, target).collect()}


def ridge_errors(
    df: DataFrame, features: Sequence[str], target: str, key: Sequence[str], alphas: Sequence[float] = ALPHAS,
    exact: bool = False,
) -> DataFrame:
    """Table of penalties with their errors."""
    rows = cut_lineage(split_rows(df, features, target, key, exact))
    return penalty_errors(rows, features, target, _read_moments(rows, features, target)[False], alphas)


def ridge_parameters(
    df: DataFrame, features: Sequence[str], target: str, key: Sequence[str], alphas: Sequence[float] = ALPHAS,
    exact: bool = False,
) -> DataFrame:
    """Best penalty, its test error, and the weights refitted on all rows: ``(param, value)``.

    The few numeric columns are kept in the shared folder first, so that the second pass does
    not repeat whatever produced them.
    """
    rows = cut_lineage(split_rows(df, features, target, key, exact))
    moments = _read_moments(rows, features, target)
    train = moments[False]
    # One row per candidate penalty.
    errors = penalty_errors(rows, features, target, train, alphas).collect()
    best = min(errors, key=lambda e: (e["loo_mse"], e["alpha"]))
    everything = train.merge(moments[True]) if True in moments else train
    weights = everything.unit_norm_ridge(best["alpha"])
    intercept = everything.mean[-1] - float(weights @ everything.mean[:-1])
    result = [("alpha", float(best["alpha"])), ("mse", best["test_mse"])]
    result += [(f"coef_{name}", float(w)) for name, w in zip(features, weights)]
    result.append(("intercept", float(intercept)))
    return df.sparkSession.createDataFrame(result, "param string, value double")
