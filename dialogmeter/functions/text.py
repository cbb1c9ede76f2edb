"""String expressions. All of them run inside the JVM on whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped or split.
WHITESPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Cell texts a tab-separated reader takes for a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Fixed value: what a missing text becomes when it is cast to a string first.
MISSING_TEXT = "nan"
# Fixed value: the evaluation set whose prompts keep only their last line, without speaker tag.
SPEAKER_TAGGED_SET = "ESL 3-turn"


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.trim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def clean_text(c: Column) -> Column:
    """Drop every double quote, then strip."""
    return strip(F.replace(c, F.lit('"'), F.lit("")))


def after_last_colon(c: Column) -> Column:
    """Text behind the last colon; the whole text when there is none."""
    return F.substring_index(c, ":", -1)


def last_line(c: Column) -> Column:
    return F.substring_index(c, "\n", -1)


def drop_speaker_tag(c: Column) -> Column:
    """Last line without its two-character speaker tag."""
    return F.substr(last_line(c), F.lit(3))


def trim_prompt(c: Column, dataset: str) -> Column:
    """Prompt text as it is scored for ``dataset``."""
    return drop_speaker_tag(c) if dataset == SPEAKER_TAGGED_SET else c


def missing_as_text(c: Column) -> Column:
    """Score a missing text as the literal word, as a cast to string would."""
    return F.coalesce(c, F.lit(MISSING_TEXT))


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(NA_TOKENS), c)


def nan_to_null(c: Column) -> Column:
    """NaN sorts above every number in Spark and is not skipped by aggregates."""
    return F.when(~F.isnan(c), c)
