"""Nested dialogue records to flat example tables, one function per layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmeter import schemas
from dialogmeter.functions.text import after_last_colon, clean_text

# Fixed value: the model name that marks the human reference inside the response list.
GROUND_TRUTH = "Original Ground Truth"


def _is_truth(response: Column) -> Column:
    return response["model"].eqNullSafe(F.lit(GROUND_TRUTH))


def record_reference(responses: Column) -> Column:
    """Ground truth of the record, wherever it stands in the list."""
    return F.get(F.filter(responses, _is_truth), F.lit(0))["response"]


def preceding_reference(responses: Column, position: Column) -> Column:
    """Last ground truth at or before ``position``, as a single pass over the list sees it."""
    seen = F.filter(F.slice(responses, F.lit(1), position + 1), _is_truth)
    return F.try_element_at(seen, F.lit(-1))["response"]


def explode_responses(records: DataFrame, reference: str = "record") -> DataFrame:
    """One row per model response with its reference; the ground truth itself is left out.

    ``reference="record"`` does not depend on the list order; ``"preceding"`` reproduces the
    order-dependent carry-forward within a record.
    """
    if reference not in ("record", "preceding"):
        raise ValueError("reference must be 'record' or 'preceding'")
    keep = [c for c in records.columns if c != "responses"]
    found = F.col("responses")
    if reference == "record":
        rows = records.select(*keep, record_reference(found).alias("ref"), F.posexplode(found).alias("position", "r"))
    else:
        paired = F.transform(
            found, lambda r, i: F.struct(preceding_reference(found, i).alias("ref"), i.alias("position"), r.alias("r"))
        )
        rows = records.select(*keep, F.inline(paired))
    return rows.where(~_is_truth(F.col("r"))).select(*keep, "position", "ref", "r")


def _ratings(source: str | None, labels: list[str]) -> list[Column]:
    def field(label: str) -> Column:
        return F.col(f"`{label}`") if source is None else F.col(source)[label]

    return [field(label).alias(schemas.column_name(label)) for label in labels]


def flatten_usr(records: DataFrame, reference: str = "record") -> DataFrame:
    return explode_responses(records, reference).select(
        clean_text(F.col("context")).alias("context"),
        clean_text(F.col("fact")).alias("fact"),
        clean_text(F.col("ref")).alias("ref"),
        F.col("r.response").alias("cand"),
        F.col("r.model").alias("model"),
        *_ratings("r", schemas.USR_QUALITIES),
    )


def flatten_static(records: DataFrame) -> DataFrame:
    return records.select(
        clean_text(F.col("dialog_history")).alias("context"),
        F.col("dialog_response").alias("cand"),
        clean_text(F.col("system")).alias("model"),
        *_ratings(None, schemas.STATIC_QUALITIES),
    )


def flatten_fed_referenced(records: DataFrame) -> DataFrame:
    """Turn-level annotations: records that carry a response."""
    return records.where(F.col("response").isNotNull()).select(
        clean_text(F.col("context")).alias("context"),
        after_last_colon(F.col("response")).alias("cand"),
        clean_text(F.col("system")).alias("model"),
        *_ratings("annotations", schemas.FED_TURN_QUALITIES),
    )


def flatten_fed_unreferenced(records: DataFrame) -> DataFrame:
    """Dialogue-level annotations: records without a response."""
    return records.where(F.col("response").isNull()).select(
        clean_text(F.col("context")).alias("context"),
        clean_text(F.col("system")).alias("model"),
        *_ratings("annotations", schemas.FED_DIALOG_QUALITIES),
    )


# Data set name -> (schema of a record, flattening transform).
LAYOUTS = {
    "usr": (schemas.USR_JSON, flatten_usr),
    "static_data": (schemas.STATIC_JSON, flatten_static),
    "fed_referenced": (schemas.FED_TURN_JSON, flatten_fed_referenced),
    "fed_unreferenced": (schemas.FED_DIALOG_JSON, flatten_fed_unreferenced),
}


def layout(dataset: str):
    if dataset not in LAYOUTS:
        raise ValueError(f"unknown data set {dataset!r}; one of {sorted(LAYOUTS)}")
    return LAYOUTS[dataset]
