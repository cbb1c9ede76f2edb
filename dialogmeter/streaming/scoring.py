"""Scoring examples as their files arrive.

Scoring is row-wise, so the batch transform runs unchanged on a stream: no state and no
watermark are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from dialogmeter.operators.flatten import layout
from dialogmeter.operators.references import TextColumns
from dialogmeter.operators.scoring import score


def stream_examples(spark: SparkSession, dataset: str, path: str, files_per_batch: int = 1000) -> DataFrame:
    schema, flatten = layout(dataset)
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
    return lines.transform(flatten)


def score_stream(
    examples: DataFrame, out: str, checkpoint: str, metric: str, mode: str = "ref",
    texts: TextColumns = TextColumns(),
) -> StreamingQuery:
    """Score everything that is waiting and stop; run it again for later files."""
    return (
        score(examples, metric, mode, texts)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
