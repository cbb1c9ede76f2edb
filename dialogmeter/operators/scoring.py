"""Scorers by name: column expressions, or batch models run in Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmeter.functions.combine import COMBINERS
from dialogmeter.functions.tokens import closest_count, penalty_from_counts, token_count
from dialogmeter.operators.batching import Batching, scored, windows
from dialogmeter.operators.references import TextColumns, check_mode, reference_columns
from dialogmeter.session import landed

# A loaded model: candidates and their reference lists in, one score each out.
BatchModel = Callable[[list[str], list[list[str]]], Sequence[float]]


@dataclass(frozen=True)
class Scorer:
    """``factory`` builds a batch model inside a worker; ``None`` means the brevity penalty.

    ``components`` are the parts the averaging modes combine.
    """

    name: str
    factory: Callable[[], BatchModel] | None = None
    components: tuple[str, ...] = field(default=("ref_score", "context_score", "empty_score"))
    batching: Batching = field(default=Batching())


# The built-in length metric averages over two components only.
_SCORERS = {"bleu": Scorer("bleu", None, ("ref_score", "context_score"))}


def register_scorer(
    name: str, factory: Callable[[], BatchModel], components: Sequence[str] | None = None, batching: Batching = Batching()
) -> None:
    """Make a model available under ``name``; ``batching`` says what one call of it may hold.

    The factory is shipped to the workers and called once per task, before the first batch.
    A model that is slow to load should be cached by its own module, which a reused worker
    process keeps.
    """
    parts = Scorer(name).components if components is None else tuple(components)
    _SCORERS[name] = Scorer(name, factory, parts, batching)


def scorer(name: str) -> Scorer:
    if name not in _SCORERS:
        raise ValueError(f"no scorer named {name!r}; registered: {', '.join(sorted(_SCORERS))}")
    return _SCORERS[name]


def _batch_udf(factory: Callable[[], BatchModel], batching: Batching):
    """Arrow UDF over (candidate, list of reference lists) giving one score per reference list."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for window in windows(batches, batching.window):
            yield from scored(window, model, batching)

    return run


def score(
    df: DataFrame, metric: str, mode: str = "ref", texts: TextColumns = TextColumns(),
    score_col: str = "score",
) -> DataFrame:
    """Add ``score`` to every example; the averaging modes keep their component columns too.

    Only the texts travel to a Python worker, and only for a batch model; the length metric
    stays a projection without any shuffle.
    """
    check_mode(mode)
    chosen = scorer(metric)
    plan = reference_columns(df, mode, texts)
    if mode in COMBINERS:
        plan = {name: refs for name, refs in plan.items() if name in chosen.components}
    # Components are written under their own names, a single mode's score straight to its target.
    targets = {name: name if mode in COMBINERS else score_col for name in plan}
    if chosen.factory is None:
        values = _length_scores(df, plan, targets, texts)
    else:
        values = _model_scores(df, chosen, plan, targets, texts)
    if mode not in COMBINERS:
        return values
    return values.withColumn(score_col, COMBINERS[mode]([F.col(name) for name in plan]))


def unused_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def _length_scores(df: DataFrame, plan: dict, targets: dict[str, str], texts: TextColumns) -> DataFrame:
    # Token counts are projected once and then reused by the penalty expressions.
    own = unused_name(df, "_c")
    counts = {own: token_count(texts.candidate())}
    sizes: dict[str, list[Column]] = {}
    for name, refs in plan.items():
        sizes[name] = []
        for i, ref in enumerate(refs):
            if ref is not None:
                column = unused_name(df, f"_{name}_{i}")
                counts[column] = token_count(ref)
                sizes[name].append(F.col(column))
    scored = {
        targets[name]: penalty_from_counts(F.col(own), closest_count(F.col(own), cols))
        if cols
        else F.lit(None).cast("double")
        for name, cols in sizes.items()
    }
    return df.withColumns(counts).withColumns(scored).drop(*counts)


def _model_scores(df: DataFrame, chosen: Scorer, plan: dict, targets: dict[str, str], texts: TextColumns) -> DataFrame:
    variants = F.array(
        *[
            F.array(*[F.lit(None).cast("string") if r is None else r for r in refs])
            for refs in plan.values()
        ]
    )
    made = unused_name(df, "_scores")
    done = df.withColumn(made, _batch_udf(chosen.factory, chosen.batching)(texts.candidate(), variants))
    parts = {targets[name]: F.get(F.col(made), F.lit(i)) for i, name in enumerate(plan)}
    return done.withColumns(parts).drop(made)


def key_digest(key: Sequence[str]) -> Column:
    """Digest of several fields; nulls count, and no text can look like two fields."""
    fields = F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(key)])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def attach_scores(
    examples: DataFrame, scored: DataFrame, key: Sequence[str] = ("context", "model"), score_col: str = "score"
) -> DataFrame:
    """Add scores computed elsewhere, matched by a natural key instead of by position.

    Long texts are compared by digest so that the shuffle of ``scored`` carries no text.
    Rows without a score stay, with null.
    """
    made, copies = unused_name(examples, "_key"), unused_name(examples, "_copies")
    scores = scored.groupBy(key_digest(key).alias(made)).agg(F.count(F.lit(1)).alias(copies), F.max(score_col).alias(score_col))
    unique = F.when(F.col(copies) == 1, F.col(score_col)).otherwise(
        F.raise_error(F.lit("two scored rows share one key")).cast("double")
    )
    # Landed, so that the join starts from a scan of known size.
    scores = landed(scores.select(made, unique.alias(score_col)), "scores")
    return examples.withColumn(made, key_digest(key)).join(scores, made, "left").drop(made)
