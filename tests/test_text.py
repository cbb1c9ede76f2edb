import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from dialogmeter.functions import text


def test_clean_text_drops_quotes_and_all_white_space(values):
    inputs = [' "hi" ', '\t\n"a b"\xa0 ', '""', None, 'in"side', "\x1cx\x85"]
    assert values(inputs, text.clean_text) == ["hi", "a b", "", None, "inside", "x"]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from('ab"\t\n\v \x1d\x85\xa0 　é'), max_size=12), min_size=20, max_size=20))
def test_clean_text_equals_python(values, inputs):
    assert values(inputs, text.clean_text) == [s.replace('"', "").strip() for s in inputs]


def test_last_colon_and_last_line(values):
    inputs = ["a: b: c", "none", "", ":", "x\ny", "x\n"]
    assert values(inputs, text.after_last_colon) == [s.split(":")[-1] for s in inputs]
    assert values(inputs, text.last_line) == [s.split("\n")[-1] for s in inputs]


def test_prompt_is_trimmed_for_the_tagged_set_only(values):
    inputs = ["A: x\nB: hello", "x", ""]
    assert values(inputs, lambda c: text.trim_prompt(c, text.SPEAKER_TAGGED_SET)) == [" hello", "", ""]
    assert values(inputs, lambda c: text.trim_prompt(c, "NCM")) == inputs


def test_missing_values(values):
    assert values(["a", None], text.missing_as_text) == ["a", "nan"]
    assert values(["NA", "", "nan", "Nan", "a"], text.na_to_null) == [None, None, None, "Nan", "a"]
    assert values([1.0, math.nan, None], text.nan_to_null, "double") == [1.0, None, None]


@pytest.mark.parametrize("word", text.NA_TOKENS)
def test_every_missing_word(values, word):
    assert values([word], text.na_to_null) == [None]
