r"""Two-sided p-value of a Pearson correlation as a column expression.

With ``a = (n - 2) / 2`` the p-value is the regularised incomplete beta
:math:`I_{1-r^2}(a, 1/2)`. Three series cover its range:

* ``r^2 <= 1/2``: one minus the power series of :math:`I_{r^2}(1/2, a)`, whose terms are all
  positive;
* ``r^2 > 1/2``: the power series of :math:`I_{1-r^2}(a, 1/2)`;
* far tail (``a r^2 > 30``): the Pfaff-transformed series, which keeps relative accuracy where
  the first one would cancel.

The expression is meant for aggregated rows (one per regression), not for raw data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SERIES_TERMS = 160
TAIL_TERMS = 24
TAIL_FROM = 30.0
GAMMA_SHIFT = 32
# Asymptotic coefficients of Gamma(a + 1/2) / (Gamma(a) sqrt(a)) in powers of 1/a.
GAMMA_RATIO = [1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144]


def _gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a): asymptotic at a + 32, brought back by the recurrence."""
    far = a + GAMMA_SHIFT
    inverse = F.lit(1.0) / far
    poly = F.lit(0.0)
    for coefficient in reversed(GAMMA_RATIO):
        poly = poly * inverse + F.lit(coefficient)
    back = F.aggregate(
        F.sequence(F.lit(0), F.lit(GAMMA_SHIFT - 1)),
        F.lit(1.0),
        lambda acc, i: acc * ((a + i) / (a + i + 0.5)),
    )
    return F.sqrt(far) * poly * back


def _sum_of_products(factor, terms: int) -> Column:
    """1 + f(0) + f(0) f(1) + ... for ``terms`` factors."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * factor(i)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(terms - 1)), start, step, lambda acc: acc["total"])


def correlation_p_value(r: Column, n: Column) -> Column:
    """Null below three pairs or without a correlation; 0 for a perfect one."""
    r2 = F.least(r * r, F.lit(1.0))
    rest = F.lit(1.0) - r2
    a = (n.cast("double") - 2.0) / 2.0
    scale = F.abs(r) * F.exp(a * F.log1p(-r2)) * _gamma_ratio(a) / math.sqrt(math.pi)

    small_r = F.lit(1.0) - 2.0 * scale * _sum_of_products(lambda i: (a + 0.5 + i) / (i + 1.5) * r2, SERIES_TERMS)
    large_r = scale / a * _sum_of_products(lambda i: (a + 0.5 + i) / (a + 1.0 + i) * rest, SERIES_TERMS)
    tail = (scale / (a * r2)) * _sum_of_products(lambda i: -(i + 0.5) / (a + 1.0 + i) * (rest / r2), TAIL_TERMS)
    value = (
        F.when(r2 == 1.0, F.lit(0.0))
        .when(a * r2 > TAIL_FROM, tail)
        .when(r2 > 0.5, large_r)
        .otherwise(small_r)
    )
    return F.when((n >= 3) & r.isNotNull(), F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)))
