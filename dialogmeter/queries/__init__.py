"""Runnable queries over the shared tables, each with the SQL that gives the same rows."""

from dialogmeter.queries import (  # noqa: F401  (importing registers the queries)
    annotated,
    comparisons,
    scores,
    statistics,
    tables,
    votes,
)
from dialogmeter.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
