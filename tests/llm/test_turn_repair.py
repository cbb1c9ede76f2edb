import hashlib
import itertools
import random
import re
import zlib

import pytest

from dialogmeter.llm import turn_repair

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
PATTERN = re.compile(r"(s?(ua)+)?")
KIND = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0d]+$", "", text)
        out.append("b" if not body else "d" if (role, text) in seen else "-" if body[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def by_enumeration(rows):
    """Every sequence of edits with at most two insertions before a row, each written out as text."""
    best = None
    kinds = faults(rows)
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    choices = [["D"] if k in "bd" else ["D", "K", "user", "assistant"] for k in kinds]
    for edits in itertools.product(*choices):
        for before in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for i in range(len(rows) + 1):
                for role in before[i]:
                    cost, audit, out = cost + 5, audit + "I", [*out, (role, "")]
                if i == len(rows):
                    break
                if edits[i] == "D":
                    cost, audit = cost + 2, audit + "D"
                    continue
                late = 5 * (kinds[i] == "t")
                if edits[i] == "K":
                    cost, audit, out = cost + late, audit + "K", [*out, rows[i]]
                else:
                    cost, audit, out = cost + 1 + late, audit + "R", [*out, (edits[i], rows[i][1])]
            if PATTERN.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                key = (cost, audit, tuple(out))
                best = key if best is None or key[:2] < best[:2] else best
    return best


def by_tuples(rows):
    """The same for long conversations: costs and whole audits, compared as such."""
    ends = {"": (0, "", ()), "a": (0, "", ()), "u": (5, "I", (("assistant", ""),)), "s": (10, "II", (("user", ""), ("assistant", "")))}
    after = ends
    for (role, text), kind in reversed(list(zip(rows, faults(rows), strict=True))):
        here = {}
        for q in ends:
            options = [(after[q][0] + 2, "D" + after[q][1], after[q][2])]
            if kind not in "bd":
                for letter, new in (("K", role), ("R", "user"), ("R", "assistant")):
                    if (q, new[:1]) in STEP:
                        o = after[STEP[q, new[:1]]]
                        options.append((o[0] + (letter == "R") + 5 * (kind == "t"), letter + o[1], ((new, text), *o[2])))
            here[q] = min(options)
        for _ in range(3):
            for q, new in itertools.product(ends, ("user", "assistant")):
                if (q, new[0]) in STEP:
                    o = here[STEP[q, new[0]]]
                    here[q] = min(here[q], (o[0] + 5, "I" + o[1], ((new, ""), *o[2])))
        after = here
    return after[""]


def searched(rows, chunk):
    kinds = [r[:1].ljust(1) + (k if k in "bd" else "-") + ("t" if k == "t" else "-") for (r, _), k in zip(rows, faults(rows), strict=True)]
    parts = [kinds[i : i + chunk] for i in range(0, len(kinds), chunk)]
    cost, audit = turn_repair.least_repair([(len(p), [x for to in turn_repair.chunk_paths(tuple(p)) for x in to]) for p in parts])
    out, state = [], 0
    for i, part in enumerate(turn_repair.split_audit(audit, [len(p) for p in parts])):
        made, state = turn_repair.apply_edits(part, state, rows[i * chunk : (i + 1) * chunk])
        out += made
    return cost, audit, tuple(out)


def some_rows(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", " "], ["a.", "b.", "c", "", "d!", "e"]
    return [(rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_least_repair_equals_enumeration():
    rng = random.Random(1)
    for _ in range(60):
        rows = some_rows(rng, rng.randint(1, 3))
        assert searched(rows, 256) == by_enumeration(rows) == by_tuples(rows)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7])
def test_chunks_give_the_whole_conversations_repair(chunk):
    rng = random.Random(chunk)
    for _ in range(150):
        rows = some_rows(rng, rng.randint(1, 25))
        assert searched(rows, chunk) == by_tuples(rows)


def expected(table):
    convs = {}
    for conv, turn, role, text in table:
        own = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        plain = [(r, t) for _, r, t in rows]
        cost, audit, repaired = by_tuples(plain)
        kinds, turns = faults(plain), [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:], strict=False))
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out[conv] = (gaps, *(kinds.count(k) for k in "bdt"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def check(spark, rows):
    got = turn_repair.damage_and_repair(spark.createDataFrame(rows, KIND)).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected(rows)


def test_query_equals_plain_repair(spark):
    rng = random.Random(4)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randint(1, 9)):
            role, text = rng.choice(["user", "assistant", "system", None]), rng.choice(["Yes.", "No!", "Hm", "", None, "é ü?", "x" * 30])
            rows.append((conv, rng.choice([turn, turn, turn, None]), role, text))
    check(spark, rows + rows[:20])


def test_long_conversations_and_texts(spark):
    rng = random.Random(5)
    roles = ["user", "assistant"]
    rows = [(1, t, roles[(t + (rng.random() < 0.1)) % 2], f"{t % 50}" + "." * (rng.random() < 0.8)) for t in range(2000)]
    rows += [(2, 0, "user", "long " * 300_000 + "."), (2, 1, "assistant", "b." * 400_000), (2, 2, "user", "c.")]
    rows += [(3, 7, "user", "same.")] * 900
    check(spark, rows)


def test_dropped_conversations_and_empty_tables(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    check(spark, [(dropped, 0, "user", "a.")])
    assert turn_repair.damage_and_repair(spark.createDataFrame([], KIND)).count() == 0


def test_other_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, 2, "user", "a.", 5, "x"), (1, 3, "assistant", "b.", 5, "y")], KIND + ", times int, chunk string")
    assert {r.conv_id: tuple(r)[1:] for r in turn_repair.damage_and_repair(df).collect()} == expected([(1, 2, "user", "a."), (1, 3, "assistant", "b.")])
