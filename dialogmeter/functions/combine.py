"""Row-wise combination of component scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialogmeter.functions.text import nan_to_null


def row_mean(cols: Sequence[Column]) -> Column:
    """Mean over the components that are present; null when none is."""
    clean = [nan_to_null(c.cast("double")) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in clean])
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in clean])
    return F.when(present > 0, total / present)


def row_max(cols: Sequence[Column]) -> Column:
    clean = [nan_to_null(c.cast("double")) for c in cols]
    return clean[0] if len(clean) == 1 else F.greatest(*clean)


# The two ways of folding components into one score.
COMBINERS = {"multi_avg": row_mean, "multi_max": row_max}
