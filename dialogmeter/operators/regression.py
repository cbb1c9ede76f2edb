"""Simple linear regression per group, with r, its p-value and the slope's error."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmeter.functions.pvalue import correlation_p_value
from dialogmeter.functions.text import nan_to_null
from dialogmeter.session import landed

MEASURES = ["slope", "intercept", "r", "r2", "p", "stderr", "n"]


def linear_regression(
    df: DataFrame, x: str, y: str, by: Sequence[str] = (), nulls: str = "skip"
) -> DataFrame:
    """Fit ``y = intercept + slope * x`` in every group.

    One pass: a few moments are combined map-side, so a group of any size costs one small row per
    task. ``nulls="skip"`` uses complete pairs; ``"propagate"`` gives null measures for a group
    with an incomplete pair, as a fit over missing values would. A constant ``x`` has no fit;
    a constant ``y`` has r = 0.
    """
    if nulls not in ("skip", "propagate"):
        raise ValueError("nulls must be 'skip' or 'propagate'")
    a, b = (nan_to_null(F.col(c).cast("double")) for c in (x, y))
    pairs = df.select(*by, a.alias("_x0"), b.alias("_y0")).select(
        *by,
        F.when(F.col("_y0").isNotNull(), F.col("_x0")).alias("_x"),
        F.when(F.col("_x0").isNotNull(), F.col("_y0")).alias("_y"),
    )
    # Both sides of a pair are present or missing together, so plain moments can be used.
    moments = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count("_x").alias("n"),
        F.avg("_x").alias("_mx"),
        F.avg("_y").alias("_my"),
        F.var_pop("_x").alias("_vx"),
        F.var_pop("_y").alias("_vy"),
        F.covar_pop("_x", "_y").alias("_cxy"),
    )
    usable = (F.col("n") >= 2) & (F.col("_vx") > 0)
    if nulls == "propagate":
        usable = usable & (F.col("n") == F.col("_rows"))
    raw_r = F.col("_cxy") / (F.sqrt("_vx") * F.sqrt("_vy"))
    r = F.when(F.col("_vy") > 0, F.greatest(F.least(raw_r, F.lit(1.0)), F.lit(-1.0))).otherwise(F.lit(0.0))
    fitted = (
        moments.withColumn("slope", F.when(usable, F.col("_cxy") / F.col("_vx")))
        .withColumn("r", F.when(usable, r))
        .withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
    )
    spread = (F.lit(1.0) - F.col("r") * F.col("r")) * F.col("_vy") / F.col("_vx") / (F.col("n") - 2)
    return fitted.select(
        *by,
        "slope",
        "intercept",
        "r",
        (F.col("r") * F.col("r")).alias("r2"),
        correlation_p_value(F.col("r"), F.col("n")).alias("p"),
        F.when(F.col("r").isNotNull() & (F.col("n") > 2), F.sqrt(spread)).alias("stderr"),
        "n",
    )


def rounded(fits: DataFrame, digits: int = 6, measures: Sequence[str] = MEASURES[:-1]) -> DataFrame:
    """The measures rounded for a report."""
    return fits.withColumns({m: F.round(m, digits) for m in measures if m in fits.columns})


def _short_decimal(c: Column, digits: int) -> Column:
    """Rounded number as plain decimal text without trailing zeros."""
    trimmed = F.rtrim(F.round(c, digits).cast(f"decimal(20,{digits})").cast("string"), F.lit("0"))
    return F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)


def report_label(group: Column | None = None, digits: int = 6, r2: bool = False) -> Column:
    """Figure title of one fit: optional group, then r (and r squared) and p rounded to ``digits``.

    A measure that is undefined is written as ``nan``.
    """
    names = ["r", "r2", "p"] if r2 else ["r", "p"]
    shown = [F.coalesce(_short_decimal(F.col(c), digits), F.lit("nan")) for c in names]
    parts = "$R=$%s, $R^2=$%s\n p=%s" if r2 else "$R=$%s\n p=%s"
    if group is None:
        return F.format_string(parts, *shown)
    return F.format_string("%s: " + parts, group, *shown)


def correlation_report(fits: DataFrame, group: str | None = None, digits: int = 6) -> DataFrame:
    label = report_label(None if group is None else F.col(group), digits)
    keep = [] if group is None else [group]
    return fits.select(*keep, F.round("r", digits).alias("r"), F.round("p", digits).alias("p"), "n", label.alias("label"))


def fitted_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Points and fitted value per group: the data behind a scatter plot with its line.

    The points are computed once and landed; the fit and the result read that narrow copy. A
    null group is a group; without groups there is one line.
    """
    points = landed(df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "points")
    fits = linear_regression(points, "x", "y", by)
    if not by:
        slope, intercept = (fits.select(c).scalar() for c in ("slope", "intercept"))
        return points.select("x", "y", (intercept + slope * F.col("x")).alias("y_hat"))
    fits = landed(fits.select(*(F.col(c).alias(f"_fit_{i}") for i, c in enumerate(by)), "slope", "intercept"), "lines")
    same = reduce(lambda a, b: a & b, [points[c].eqNullSafe(fits[f"_fit_{i}"]) for i, c in enumerate(by)])
    return points.join(fits, same).select(*by, "x", "y", (F.col("intercept") + F.col("slope") * F.col("x")).alias("y_hat"))


def point_cells(df: DataFrame, x: str, y: str, by: Sequence[str] = (), cells: int = 20) -> DataFrame:
    """How many points lie in each cell of a ``cells`` x ``cells`` grid over all points: a plot of any number of them.

    by, x_cell, y_cell, x_from, x_to, y_from, y_to, n of the cells that hold points. Points with a
    missing value are left out. Counts are combined map-side, so a full cell costs one row per task;
    the bounds are those of all groups together, and their upper ends belong to the last cells.
    """
    a, b = (nan_to_null(F.col(c).cast("double")) for c in (x, y))
    points = df.select(*by, a.alias("_x"), b.alias("_y")).where("_x is not null and _y is not null")
    bounds = points.agg(*[f(c).alias(f"{c}{n}") for c in ("_x", "_y") for n, f in (("lo", F.min), ("hi", F.max))])

    def cell(c: str) -> Column:
        low, high = bounds.select(f"{c}lo").scalar(), bounds.select(f"{c}hi").scalar()
        place = F.floor((F.col(c) - low) / (high - low) * cells)
        return F.when(high > low, F.least(place, F.lit(cells - 1))).otherwise(F.lit(0)).cast("int")

    counts = points.groupBy(*by, cell("_x").alias("x_cell"), cell("_y").alias("y_cell")).agg(F.count(F.lit(1)).alias("n"))
    ends = []
    for c, name in (("_x", "x"), ("_y", "y")):
        low, high = bounds.select(f"{c}lo").scalar(), bounds.select(f"{c}hi").scalar()
        for end, step in (("from", 0), ("to", 1)):
            ends.append((low + (high - low) * (F.col(f"{name}_cell") + step) / cells).alias(f"{name}_{end}"))
    return counts.select(*by, "x_cell", "y_cell", *ends, "n")


def pair_points(
    df: DataFrame, pairs: Sequence[tuple[str, str]], scopes: dict[str, Column | None], keep: Sequence[str] = ()
) -> DataFrame:
    """scope, x_name, y_name, x, y (and ``keep``) of every row, pair of columns and row scope.

    ``scopes`` maps a label to a row condition (``None`` for all rows); rows outside have null values.
    """
    cells = []
    for scope, condition in scopes.items():
        for x, y in pairs:
            xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
            inside = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
            cells.append(
                F.struct(
                    F.lit(scope).alias("scope"), F.lit(x).alias("x_name"), F.lit(y).alias("y_name"),
                    F.when(inside, xs).alias("x"), F.when(inside, ys).alias("y"),
                )
            )
    return df.select(*keep, F.inline(F.array(*cells)))


def pair_regressions(
    df: DataFrame, pairs: Sequence[tuple[str, str]], scopes: dict[str, Column | None]
) -> DataFrame:
    """Regress one column on another for several pairs and row scopes in one pass."""
    return linear_regression(pair_points(df, pairs, scopes), "x", "y", ["scope", "x_name", "y_name"])


def pair_lines(
    df: DataFrame, pairs: Sequence[tuple[str, str]], scopes: dict[str, Column | None], keep: Sequence[str] = ()
) -> DataFrame:
    """Points and fitted values of several pairs and scopes; rows with both values."""
    points = pair_points(df, pairs, scopes, keep).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    by = ["scope", "x_name", "y_name"]
    points = landed(points, "pair-points")
    fits = landed(linear_regression(points, "x", "y", by).select(*by, "slope", "intercept"), "pair-fits")
    return points.join(fits, by).select(*keep, *by, "x", "y", (F.col("intercept") + F.col("slope") * F.col("x")).alias("y_hat"))
