"""Explicit schemas of every table the library reads."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names of the four annotated dialogue layouts.
USR_QUALITIES = ["Understandable", "Natural", "Maintains Context", "Engaging", "Uses Knowledge", "Overall"]
STATIC_QUALITIES = [
    "fluent", "understandable", "interesting", "relevant", "human", "engaging", "correct",
    "semantically appropriate", "specific",
]
FED_TURN_QUALITIES = [
    "Interesting", "Engaging", "Specific", "Relevant", "Correct", "Semantically appropriate",
    "Understandable", "Fluent", "Overall",
]
FED_DIALOG_QUALITIES = [
    "Coherent", "Error recovery", "Consistent", "Diverse", "Depth", "Likeable", "Understanding",
    "Flexible", "Informative", "Inquisitive", "Overall",
]


def column_name(label: str) -> str:
    """Lower case with underscores for spaces: the header form of a quality label."""
    return label.lower().replace(" ", "_")


def _struct(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


def _text(*names: str) -> list[tuple[str, T.DataType]]:
    return [(name, T.StringType()) for name in names]


INTS = T.ArrayType(T.LongType())
# Annotators may answer with free text, so these lists hold strings.
TOKENS = T.ArrayType(T.StringType())

USR_RESPONSE = _struct(_text("response", "model") + [(q, INTS) for q in USR_QUALITIES])
USR_JSON = _struct(_text("context", "fact") + [("responses", T.ArrayType(USR_RESPONSE))])
STATIC_JSON = _struct(
    _text("dialog_history", "dialog_response", "system") + [(q, INTS) for q in STATIC_QUALITIES]
)
FED_TURN_JSON = _struct(
    _text("context", "response", "system")
    + [("annotations", _struct([(q, TOKENS) for q in FED_TURN_QUALITIES]))]
)
FED_DIALOG_JSON = _struct(
    _text("context", "response", "system")
    + [("annotations", _struct([(q, TOKENS) for q in FED_DIALOG_QUALITIES]))]
)


def usr_table(score: str | None = None) -> T.StructType:
    """Flat examples with reference and fact; list ratings are text in files."""
    ratings = [column_name(q) for q in USR_QUALITIES]
    tail = [(score, T.DoubleType())] if score else []
    return _struct(_text("context", "fact", "ref", "cand", "model", *ratings) + tail)


def fed_table(score: str | None = None) -> T.StructType:
    ratings = [column_name(q) for q in FED_TURN_QUALITIES]
    tail = [(score, T.DoubleType())] if score else []
    return _struct(_text("context", "cand", "model", *ratings) + tail)


def votes_table(score: str | None = None, components: list[str] = ()) -> T.StructType:
    """One row per prompt and model with its win ratio; ids stay nullable integers."""
    tail = [(c, T.DoubleType()) for c in components]
    tail += [(score, T.DoubleType())] if score else []
    return _struct(
        [("prompt_id", T.LongType()), ("prompt_text", T.StringType()), ("ref_id", T.LongType())]
        + _text("reference_name", "reference_text")
        + [("model_id", T.LongType())]
        + _text("model_name", "candidate_text")
        + [("win_ratio", T.DoubleType()), ("counts", T.LongType())]
        + tail
    )


def with_row_id(schema: T.StructType) -> T.StructType:
    """The same table as saved with a leading row number."""
    return T.StructType([T.StructField("row_id", T.LongType(), True), *schema.fields])
