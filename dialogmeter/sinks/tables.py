"""Table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogmeter.functions.ratings import ratings_as_text
from dialogmeter.schemas import column_name
from dialogmeter.session import landed
from dialogmeter.sources.tsv import DIALECT

# White space at the ends of a text belongs to it.
WRITE_OPTIONS = {
    "sep": DIALECT["sep"], "header": True, "quote": '"', "escape": '"', "lineSep": "\n",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def normalised_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[column_name(c) for c in df.columns])


def lists_as_text(df: DataFrame) -> DataFrame:
    """Rating lists in the bracketed form a text file can hold."""
    return df.withColumns(
        {f.name: ratings_as_text(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    )


def write_tsv(df: DataFrame, path: str | None, mode: str = "errorifexists") -> DataFrame:
    """Write ``df`` as a folder of tab-separated files if a path is given.

    Then the rows are computed once: they are landed, the text is written from the copy, and the
    copy is returned, so that what follows does not compute them again. Each task writes its own
    file: the table never passes through one writer.
    """
    if path is None:
        return df
    copy = landed(df, "table")
    lists_as_text(normalised_header(copy)).write.mode(mode).options(**WRITE_OPTIONS).csv(path)
    return copy


def write_parquet(df: DataFrame, path: str | None, mode: str = "errorifexists") -> DataFrame:
    """Write parquet, the splittable form for large tables, and return the written table."""
    if path is None:
        return df
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
