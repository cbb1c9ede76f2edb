"""How well do automatic text scores agree with human judgement? Answered as Spark jobs."""

from dialogmeter.operators.pairwise import Catalog
from dialogmeter.operators.references import VOTE_TEXTS, TextColumns
from dialogmeter.operators.scoring import register_scorer, score
from dialogmeter.plans.workflows import (
    compare_components,
    compare_metrics,
    correlate,
    correlate_votes,
    evaluate,
    explain_overall,
    preprocess,
    rating_correlation,
    rating_lines,
    score_examples,
    score_votes,
    vote_table,
)

__all__ = [
    "Catalog", "TextColumns", "VOTE_TEXTS", "compare_components", "compare_metrics", "correlate",
    "correlate_votes", "evaluate", "explain_overall", "preprocess", "rating_correlation", "rating_lines",
    "register_scorer", "score", "score_examples", "score_votes", "vote_table",
]
