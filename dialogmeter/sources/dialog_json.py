"""Annotated dialogues stored as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialogmeter.operators.flatten import layout


def read_dialog_json(spark: SparkSession, dataset: str, path: str | list[str], lines: bool = True) -> DataFrame:
    """Nested records of a data set with its fixed schema.

    JSON lines are split over tasks. ``lines=False`` reads files that hold one array each; such
    a file is parsed by a single task, so large archives should be stored as lines (or written
    to parquet once).
    """
    schema, _ = layout(dataset)
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_examples(spark: SparkSession, dataset: str, path: str | list[str], lines: bool = True) -> DataFrame:
    """Flat examples of a data set."""
    _, flatten = layout(dataset)
    return read_dialog_json(spark, dataset, path, lines).transform(flatten)
