import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialogmeter.functions.combine import row_max, row_mean
from dialogmeter.functions.tokens import brevity_penalty, token_count


def count_by_rules(s: str) -> int:
    """The public 13a rules, with the space inside the first class."""
    s = s.rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for old, new in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = s.replace(old, new)
    s = f" {s} "
    s = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", s)
    s = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", s)
    s = re.sub(r"([\.,])([^0-9])", r" \1 \2", s)
    s = re.sub(r"([0-9])(-)", r"\1 \2 ", s)
    return len(s.split())


EXAMPLES = [
    "", " ", "hello world", "i 'm fine .", "don't", "3.5, 4,000 and 5-6", "a..b", "1.", ".5", ",,", "x-\ny", "a - b",
    "&quot;hi&quot; &amp; &lt;b&gt;", "&amp;lt;", "<skipped> ok", "tab\tand\xa0nbsp", "end.\n", "-\n", "$5 (x) [y] {z}~", "né, ça.",
]


def test_token_count_examples(values):
    assert values(EXAMPLES + [None], token_count) == [count_by_rules(s) for s in EXAMPLES] + [None]


def test_long_tokens_and_runs(values):
    inputs = ["a1" * 200_000, "1,2" * 200_000, "a-" * 200_000, "," * 100_001 + "5", "." * 100_000 + "5", "7" + "." * 100_001 + "5 5-", "x " * 200_000]
    assert values(inputs, token_count) == [count_by_rules(s) for s in inputs]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("ab1,.-&;\n \t'\"$(<>\x1f\xa0"), max_size=25), min_size=40, max_size=40))
def test_token_count_property(values, inputs):
    assert values(inputs, token_count) == [count_by_rules(s) for s in inputs]


def penalty(spark, cand, *refs):
    refs = [F.lit(r).cast("string") for r in refs]
    return spark.range(1).select(brevity_penalty(F.lit(cand).cast("string"), refs).alias("p")).first().p


def test_brevity_penalty(spark):
    assert penalty(spark, "a b c", "a b") == 1.0
    assert penalty(spark, "a", "a b c") == pytest.approx(math.exp(-2))
    assert penalty(spark, "", "a") == 0.0
    assert penalty(spark, "", "") == 1.0
    assert penalty(spark, None, "a") is None
    assert penalty(spark, "a", None) is None


def test_closest_reference_wins_and_shorter_one_on_a_tie(spark):
    # 3 tokens against 1 and 5: both two away, the shorter one is taken.
    assert penalty(spark, "a b c", "a b c d e", "a") == 1.0
    assert penalty(spark, "a b c", "a b c d", "a") == pytest.approx(math.exp(1 - 4 / 3))
    assert penalty(spark, "a b c", None, "a b c d") == pytest.approx(math.exp(1 - 4 / 3))


def test_row_mean_and_max_skip_missing(spark):
    rows = [(1.0, 3.0, None), (None, None, None), (math.nan, 2.0, 4.0), (-1.0, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    cols = [F.col(c) for c in "abc"]
    out = df.select(row_mean(cols).alias("m"), row_max(cols).alias("x")).collect()
    assert [r.m for r in out] == [2.0, None, 3.0, -1.0]
    assert [r.x for r in out] == [3.0, None, 4.0, -1.0]
    turned = df.select(row_mean(cols[::-1]).alias("m"), row_max(cols[::-1]).alias("x")).collect()
    assert out == turned
