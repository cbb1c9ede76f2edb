import random

import pytest

from dialogmeter.operators.dialogs import last_turns, prompt_lengths, reply_examples, turn_neighbours
from tests.test_tokens import count_by_rules


def brute(rows, history):
    by_turn = {(c, t): x for c, t, _, x in rows}
    out = {}
    for c, t, _, _ in rows:
        before = [by_turn[(c, u)] for u in range(t - history, t) if (c, u) in by_turn]
        out[(c, t)] = ("\n".join(before) if before else None, by_turn.get((c, t + 1)))
    return out


@pytest.mark.parametrize("block", [4, 5, 7, 256])
def test_blocks_do_not_change_the_neighbours(spark, block):
    # One long dialogue, short ones, and one with a missing turn.
    rows = [(1, t, "user", f"a{t}") for t in range(40)]
    rows += [(c, t, "user", f"{c}.{t}") for c in range(2, 9) for t in range(c)]
    rows = [r for r in rows if (r[0], r[1]) != (1, 13)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = turn_neighbours(df, history=3, block=block).collect()
    assert len(got) == len(rows)
    assert {(r.conv_id, r.turn): (r.context, r.ref) for r in got} == brute(rows, 3)


def test_history_must_fit_a_block(spark):
    with pytest.raises(ValueError):
        turn_neighbours(spark.createDataFrame([], "conv_id long, turn long, text string"), history=4, block=4)


def test_reply_examples(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (2, 0, "assistant", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in reply_examples(df).collect()] == [(1, 1, "q", "r", "a")]


def test_one_shuffle_of_the_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    plan = reply_examples(df, history=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_whole_history_over_several_blocks(spark):
    rows = [(1, t, f"t{t}") for t in range(40) if t != 13] + [(1, 20, None)] + [(2, 0, "a"), (2, 1, "b"), (3, 9, "late"), (4, 1, None), (4, 2, "x")]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, text string")
    got = {(r.conv_id, r.turn): r for r in turn_neighbours(turns, block=4).where("text is not null").collect()}
    for conv, turn, text in rows:
        if text is None:
            continue
        before = [x for c, t, x in sorted(rows, key=lambda r: r[:2]) if c == conv and t < turn and x is not None]
        assert got[conv, turn].context == ("\n".join(before) if before else None)
    assert got[1, 39].ref is None and got[1, 3].ref == "t4" and got[1, 12].ref is None


def test_whole_history_has_no_window_over_a_dialogue(spark):
    turns = spark.createDataFrame([(1, 0, "a")], "conv_id int, turn int, text string")
    plan = turn_neighbours(turns)._jdf.queryExecution().optimizedPlan().toString()
    assert all("_block" in line for line in plan.split("\n") if "Window [" in line)


LINES = ["one two", "a-", "-", "5-", "5 x -", "3.5, 4", "&am-", "p; q", "", "x -\n", "end.", "...", None, "tail  "]


def lengths_by_text(rows):
    """context_tokens of each (conv, turn) with every context built as text."""
    out = {}
    for conv, turn, _, _ in rows:
        before = [x for c, t, _, x in sorted(rows, key=lambda r: (r[0], r[1])) if c == conv and t < turn and x is not None]
        out[conv, turn] = count_by_rules("\n".join(before)) if before else None
    return out


def test_prompt_lengths_equal_counts_of_the_whole_text(spark):
    rng = random.Random(3)
    rows = [(c, t, "user", rng.choice(LINES)) for c in range(6) for t in range(40) if rng.random() < 0.9]
    rows += [(7, t, "user", "glued-") for t in range(25)] + [(8, t, "user", None) for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for block in (4, 256):
        got = {(r.conv_id, r.turn): r.context_tokens for r in prompt_lengths(df, block=block).collect()}
        assert got == lengths_by_text(rows)


def test_prompt_lengths_of_a_long_dialogue(spark):
    rows = [(1, t, "user", f"turn {t}, of many." + "-" * (t % 97 == 0)) for t in range(5000)]
    got = {r.turn: r.context_tokens for r in prompt_lengths(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for turn in (1, 97, 98, 99, 256, 257, 3000, 4999):
        assert got[turn] == count_by_rules("\n".join(r[3] for r in rows[:turn]))
    assert got[0] is None and len(got) == 5000


def test_last_turns_have_the_last_line_of_whole_contexts(spark):
    rng = random.Random(4)
    rows = [(c, t, "assistant", rng.choice(["a\nb", "c", None, None, None])) for c in range(8) for t in range(60) if rng.random() < 0.8]
    rows += [(None, t, "assistant", "n") for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {}
    for conv, turn, _, _ in rows:
        before = [x for c, t, _, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) if c == conv and t < turn and x is not None]
        want[conv, turn] = before[-1] if before else None
    got = last_turns(df, block=4).collect()
    assert {(r.conv_id, r.turn): r.context for r in got} == want and len(got) == len(rows)
    refs = {(r.conv_id, r.turn): r.ref for r in turn_neighbours(df.where("conv_id is not null"), block=4).collect()}
    assert {(r.conv_id, r.turn): r.ref for r in got if r.conv_id is not None} == refs
