"""Annotated records whose labels are not known beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmeter.functions.ratings import median_of_array


def read_open_records(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """A JSON file as one variant column ``record``; nothing is inferred, so the data is read once."""
    return spark.read.option("singleVariantColumn", "record").option("multiLine", not lines).json(path)


def open_ratings(records: DataFrame, answers: str, keep: dict[str, str]) -> DataFrame:
    """Long ratings (``keep``..., answer, quality, ratings, median) of records with any labels.

    ``answers`` is the path of the list of answers in a record, ``keep`` names values of the record by
    their paths. Every field of an answer that holds a list is a quality, whatever its name; entries
    that are no numbers are dropped, as in known tables. An answer without ratings gives no row.
    """
    spark = records.sparkSession
    kept = [F.try_variant_get("record", path, "string").alias(name) for name, path in keep.items()]
    listed = records.select(*kept, F.try_variant_get("record", answers, "array<variant>").alias("_answers"))
    each = listed.select(*keep, F.posexplode("_answers").alias("answer", "_answer"))
    fields = each.lateralJoin(spark.tvf.variant_explode(F.col("_answer").outer()))
    ratings = F.filter(F.transform(F.try_variant_get("value", "$", "array<variant>"), lambda v: F.try_variant_get(v, "$", "double")), lambda v: v.isNotNull())
    rated = fields.where(F.schema_of_variant("value").startswith("ARRAY")).select(
        *keep, F.col("answer").cast("bigint").alias("answer"), F.col("key").alias("quality"), ratings.alias("ratings"))
    return rated.withColumn("median", median_of_array(F.col("ratings")))
