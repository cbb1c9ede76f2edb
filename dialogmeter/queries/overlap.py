"""A deterministic batch scorer that stands in for a learned model."""

from __future__ import annotations

from dialogmeter.operators.scoring import register_scorer

NAME = "overlap_f1"


def register() -> None:
    """F1 of the distinct words shared with the best reference."""

    def load():
        import re

        def words(s: str) -> set[str]:
            return {w for w in re.split("[ \n]+", s) if w}

        def f1(a: set[str], b: set[str]) -> float:
            return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0

        def model(cands: list[str], refs: list[list[str]]) -> list[float]:
            return [max(f1(words(c), words(r)) for r in rs) for c, rs in zip(cands, refs)]

        return model

    register_scorer(NAME, load)


def sql_words(expr: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({expr}, '[ \\n]+'), lambda w: w <> ''))"


def sql_f1(a: str, b: str) -> str:
    """F1 of two word lists."""
    return f"case when len({a}) + len({b}) = 0 then 0.0 else 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) end"


register()
