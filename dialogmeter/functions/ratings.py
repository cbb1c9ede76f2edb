"""Human rating cells: parsing and the median of annotators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# List cells are bracketed, separated like this, and keep only all-digit tokens.
SEPARATOR = ", "
DIGITS = r"\A[0-9]+\z"


def parse_ratings(cell: Column) -> Column:
    """``"[1, 0, 1]"`` to numbers; tokens that are not all digits are dropped, of any length kept."""
    inner = F.substring(cell, F.lit(2), F.length(cell) - 2)
    return _digits(F.split(inner, SEPARATOR))


def _digits(items: Column) -> Column:
    kept = F.filter(items, lambda t: t.rlike(DIGITS))
    return F.transform(kept, lambda t: t.cast("double"))


def median_of_array(values: Column) -> Column:
    """Middle value; mean of the two middle values for an even count; null when empty."""
    ordered = F.array_sort(values)
    n = F.size(values)
    low = F.get(ordered, ((n - 1) / 2).cast("int"))
    high = F.get(ordered, (n / 2).cast("int"))
    return F.when(n > 0, (low + high) / F.lit(2.0))


def median_rating(cell: Column, kind: T.DataType) -> Column:
    """Median of one rating cell of the given type.

    Numbers are their own median. A text cell that reads as a number is one as well;
    any other text is a list.
    """
    if isinstance(kind, T.NumericType):
        return cell.cast("double")
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType):
            return median_of_array(_digits(cell))
        return median_of_array(F.filter(cell, lambda v: v.isNotNull()))
    if isinstance(kind, T.StringType):
        listed = cell.startswith("[")
        return F.when(listed, median_of_array(parse_ratings(cell))).otherwise(cell.try_cast("double"))
    raise TypeError(f"no median for a column of type {kind.simpleString()}")


def ratings_as_text(values: Column) -> Column:
    """List of ratings as the bracketed text stored in files."""
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), SEPARATOR), F.lit("]"))
