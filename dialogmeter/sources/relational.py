"""The vote database: JDBC tables, or DataFrames the caller already has."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from dialogmeter.operators.pairwise import Catalog

TABLES = [f.name for f in fields(Catalog)]


def jdbc_table(
    spark: SparkSession, options: dict[str, str], table: str, split_on: str | None = None,
    bounds: tuple[int, int] | None = None, partitions: int = 64,
) -> DataFrame:
    """One table of a database; the caller provides url, user and password in ``options``.

    Filters and column lists are pushed to the server. A large table should name a numeric
    ``split_on`` column with its bounds, otherwise a single connection reads it.
    """
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if split_on is not None:
        if bounds is None:
            raise ValueError("split_on needs the column's bounds")
        reader = reader.options(
            partitionColumn=split_on, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions
        )
    return reader.load()


def jdbc_query(spark: SparkSession, options: dict[str, str], query: str) -> DataFrame:
    """Result of a query that runs on the server."""
    return spark.read.format("jdbc").options(**options).option("query", query).load()


def jdbc_catalog(
    spark: SparkSession, options: dict[str, str], names: dict[str, str] | None = None,
    splits: dict[str, tuple[str, tuple[int, int]]] | None = None,
) -> Catalog:
    """All tables of the vote database; ``names`` maps a catalogue field to its server table."""
    names, splits = names or {}, splits or {}
    tables = {}
    for field in TABLES:
        column, bounds = splits.get(field, (None, None))
        tables[field] = jdbc_table(spark, options, names.get(field, field), column, bounds)
    return Catalog(**tables)


def register_catalog(cat: Catalog, prefix: str = "") -> None:
    """Make the tables visible to SQL."""
    for field in TABLES:
        getattr(cat, field).createOrReplaceTempView(prefix + field)


def sql_source(spark: SparkSession, query: str, **parameters) -> DataFrame:
    """Rows of a query; values are bound as named parameters, never pasted into the text."""
    return spark.sql(query, args=parameters)
