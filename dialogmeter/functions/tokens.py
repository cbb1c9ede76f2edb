"""Token counts and the brevity penalty as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialogmeter.functions.text import WHITESPACE, rstrip

# The public mteval-13a rules that come before the splitting. The rules themselves are
# spelled out in the tests and in the SQL of the queries.
UNESCAPE = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def _unescaped(out: Column) -> Column:
    for old, new in [("<skipped>", ""), ("-\n", ""), *UNESCAPE]:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


# One pass over the text, each match a token (with what belongs to it) and the spaces behind it. A
# group holds one character for each token that the match stands for. All loops are possessive.
# The plain letters and the guard only save the long class a look at most characters.
_BLANK = "".join(f"\\u{ord(c):04x}" for c in WHITESPACE)
_SIGN = r"!-&(-+/:-@\[-`{-~"
_LETTER = r"[a-zA-ZÀ-ᙿ]"
_OTHER = rf"[^{_BLANK}{_SIGN}.,0-9]"
_NUMBER = r"[0-9]++(?:[.,][0-9]++)*+"
# A hyphen behind a number is a token, and so is the first of several points behind one: the rules
# take points in pairs, counted from the first one that no number stands before.
_REST = rf"(?:{_LETTER}++|(?![ .,]){_OTHER}++|{_NUMBER}(?![-.,]))*+(?:{_NUMBER}(-|[.,](?=[.,]))?+)?+"
_TOKENS = "(?:" + "|".join([
    f"({_LETTER}){_REST}",
    # The second of two points stays with the number behind it.
    r"([.,])(?:([.,])(?![0-9])|[.,](?=[0-9]))?+",
    f"([{_SIGN}])",
    rf"(?=([^{_BLANK}{_SIGN}.,])){_REST}",
    f"[{_BLANK}]",
]) + ") *+"


def _counted(c: Column) -> Column:
    """The length of the text with one character left of each token."""
    return F.length(F.regexp_replace(_unescaped(c), _TOKENS, "$1$2$3$4$5$6$7"))


def token_count(c: Column) -> Column:
    """Number of 13a tokens."""
    return _counted(rstrip(c))


def tokens_in_line(c: Column) -> Column:
    """Number of 13a tokens of a text that another line follows."""
    return _counted(F.concat(c, F.lit("\n")))


def penalty_from_counts(cand: Column, ref: Column) -> Column:
    """1 for a candidate at least as long as the reference, exp(1 - r/c) below, 0 when empty."""
    return (
        F.when(cand >= ref, F.lit(1.0))
        .when(cand == 0, F.lit(0.0))
        .otherwise(F.exp(F.lit(1.0) - ref / cand))
    )


def closest_count(cand: Column, refs: Sequence[Column]) -> Column:
    """Reference length nearest to the candidate; the shorter one on a tie; nulls skipped."""
    if len(refs) == 1:
        return refs[0]
    ranked = [
        F.when(r.isNotNull(), F.struct(F.abs(r - cand).alias("gap"), r.alias("size"))) for r in refs
    ]
    return F.least(*ranked)["size"]


def brevity_penalty(cand: Column, refs: Sequence[Column]) -> Column:
    """Penalty of one text against its references; see ``scoring.score`` for whole tables."""
    c = token_count(cand)
    return penalty_from_counts(c, closest_count(c, [token_count(r) for r in refs]))
