"""Tab-separated tables with quoted, multi-line text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogmeter.functions.text import na_to_null, nan_to_null

# The dialect of the files. The line end is found out per file, because files from
# other writers end their lines with a carriage return too.
DIALECT = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "multiLine": True}
# Nothing reads as null but an absent value: a quoted empty text stays a text.
NO_NULL_WORD = "\x00"
INDEX_COLUMN = "_c0"


def clean_missing(df: DataFrame) -> DataFrame:
    """Missing-value words in text and NaN in numbers become null."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            out[f.name] = na_to_null(F.col(f"`{f.name}`"))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = nan_to_null(F.col(f"`{f.name}`"))
    return df.withColumns(out)


def read_tsv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, infer: bool = False,
    missing_words: bool = True,
) -> DataFrame:
    """Read a table file or a folder of them.

    Quoted fields may span lines, so a file cannot be split: one task reads one file. Write many
    files, or land the table as parquet once. ``infer`` looks at the data an extra time to guess
    types; give a schema for anything large. ``missing_words`` treats words such as ``NA`` as null.
    An unnamed leading column is the row number and is called ``row_id``.
    """
    reader = spark.read.options(**DIALECT, nullValue=NO_NULL_WORD)
    if schema is not None:
        # Types are cast after reading: whole numbers may be stored as "18.0" once a column has gaps.
        text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
        df = reader.schema(text).option("enforceSchema", True).csv(path)
        df = df.select(*[_typed(f, missing_words) for f in schema.fields])
    else:
        df = reader.option("inferSchema", infer).csv(path)
        if INDEX_COLUMN in df.columns:
            df = df.withColumnRenamed(INDEX_COLUMN, "row_id")
        if missing_words:
            df = clean_missing(df)
    return df


def _typed(f: T.StructField, missing_words: bool):
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.StringType):
        return (na_to_null(c) if missing_words else c).alias(f.name)
    value = na_to_null(c)
    if isinstance(f.dataType, T.IntegralType):
        whole = F.coalesce(value.try_cast(f.dataType), value.try_cast("double").try_cast(f.dataType))
        return whole.alias(f.name)
    return nan_to_null(value.try_cast("double")).cast(f.dataType).alias(f.name)


def read_score_files(
    spark: SparkSession, paths: dict[str, str], schema: T.StructType | None = None, score_col: str = "score"
) -> dict[str, DataFrame]:
    """Score tables by metric name, each with its score in ``score`` and the name in ``metric``."""
    tables = {}
    for metric, path in paths.items():
        df = read_tsv(spark, path, schema)
        if score_col != "score":
            df = df.withColumnRenamed(score_col, "score")
        tables[metric] = df.withColumns({"score": F.col("score").cast("double"), "metric": F.lit(metric)})
    return tables


# What a text cell must look like to be read as a type, narrowest type first.
CELL_TYPES = {
    "boolean": r"^(True|False|TRUE|FALSE|true|false)$",
    "bigint": r"^[+-]?[0-9]{1,18}$",
    "double": r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$",
}


def type_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, n, n_missing, n_boolean, n_bigint, n_double, type: one aggregate over all text columns.

    A column has the narrowest type that all its present cells fit; whole numbers with gaps are
    double, booleans with gaps and everything else string. A column without cells is double. Missing
    are nulls and the missing-value words. The counts tell how many cells do not fit a wider guess.
    """
    columns = df.columns if columns is None else columns
    cells = df.select(*[na_to_null(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)])
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(columns)):
        aggregates.append(F.count(f"c{i}").alias(f"n{i}"))
        aggregates += [F.count_if(F.col(f"c{i}").rlike(pattern)).alias(f"{kind}{i}") for kind, pattern in CELL_TYPES.items()]
    counted = cells.agg(*aggregates)
    reports = [
        F.struct(
            F.lit(c).alias("column_name"), F.col("rows").alias("n"), (F.col("rows") - F.col(f"n{i}")).alias("n_missing"),
            *[F.col(f"{kind}{i}").alias(f"n_{kind}") for kind in CELL_TYPES])
        for i, c in enumerate(columns)
    ]
    present, full = F.col("n") - F.col("n_missing"), F.col("n_missing") == 0
    kind = (
        F.when(full & (present > 0) & (F.col("n_boolean") == present), "boolean")
        .when(full & (present > 0) & (F.col("n_bigint") == present), "bigint")
        .when(F.col("n_double") == present, "double")
        .otherwise("string")
    )
    return counted.select(F.inline(F.array(*reports))).withColumn("type", kind)


def misfits(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """column_name, cell, n: the distinct cells that do not fit the type asked of their column."""
    asked = {c: t for c, t in types.items() if t in CELL_TYPES}
    long = df.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in asked]).unpivot([], list(asked), "column_name", "cell")
    fits = F.lit(None).cast("boolean")
    for c, t in asked.items():
        fits = F.when(F.col("column_name") == c, F.col("cell").rlike(CELL_TYPES[t])).otherwise(fits)
    return long.where(F.col("cell").isNotNull() & ~fits).groupBy("column_name", "cell").agg(F.count(F.lit(1)).alias("n"))


def with_found_types(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Text columns as the types given, or those that ``type_report`` finds; cells that do not fit are null."""
    if types is None:
        types = {r.column_name: r.type for r in type_report(df).collect()}  # one row per column
    return df.select(*[
        (c if types.get(name, "string") == "string" else c.try_cast(types[name])).alias(name)
        for name, c in ((n, na_to_null(F.col(f"`{n}`"))) for n in df.columns)
    ])
