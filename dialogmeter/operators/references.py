"""Which text a candidate is scored against."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmeter.functions.text import last_line, missing_as_text

# The reference modes.
MODES = ["ref", "context_last", "empty", "multi_avg", "multi_max", "multi"]
SINGLE_MODES = ["ref", "context_last", "empty"]


def check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"ref must be one of {', '.join(MODES)}, not {mode!r}")


@dataclass(frozen=True)
class TextColumns:
    """Names of the text columns of an example table.

    ``whole_prompt`` is the behaviour of vote tables: a single ``context_last`` reference is the
    whole prompt there, while the multi modes still use its last line. ``missing_as_text``
    scores a missing text as the word a string cast makes of it instead of giving null.
    """

    cand: str = "cand"
    ref: str = "ref"
    context: str = "context"
    whole_prompt: bool = False
    missing_as_text: bool = False

    def _text(self, name: str) -> Column:
        return missing_as_text(F.col(name)) if self.missing_as_text else F.col(name)

    def candidate(self) -> Column:
        return self._text(self.cand)

    def reference(self, df: DataFrame, mode: str, single: bool) -> Column | None:
        """Reference text for a single mode; null when an optional column is not there."""
        if mode == "empty":
            return F.lit("")
        name = self.ref if mode == "ref" else self.context
        if name not in df.columns:
            if single:
                raise ValueError(f"mode {mode!r} needs column {name!r}")
            return None
        if mode == "ref" or (single and self.whole_prompt):
            return self._text(name)
        return last_line(self._text(name))


VOTE_TEXTS = TextColumns("candidate_text", "reference_text", "prompt_text", whole_prompt=True)


def reference_columns(df: DataFrame, mode: str, texts: TextColumns = TextColumns()) -> dict[str, list[Column | None]]:
    """Score name -> references it is taken against.

    Single modes and ``multi`` have the one entry ``score``. The averaging modes have one
    entry per component; a component whose column is missing holds ``None``.
    """
    check_mode(mode)
    if mode in SINGLE_MODES:
        return {"score": [texts.reference(df, mode, single=True)]}
    if mode == "multi":
        return {"score": [texts.reference(df, m, single=m == "ref") for m in ("ref", "context_last")]}
    return {
        f"{short}_score": [texts.reference(df, m, single=False)]
        for short, m in (("ref", "ref"), ("context", "context_last"), ("empty", "empty"))
    }


def with_references(df: DataFrame, mode: str, texts: TextColumns = TextColumns()) -> DataFrame:
    """Add ``refs``: the array of reference texts of a single mode or of ``multi``."""
    refs = reference_columns(df, mode, texts)
    if list(refs) != ["score"]:
        raise ValueError("an averaging mode has one reference list per component")
    return df.withColumn("refs", F.array(*[F.lit(None).cast("string") if r is None else r for r in refs["score"]]))
