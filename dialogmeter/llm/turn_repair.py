"""Operator 13: repair the structure of conversations at the least cost.

A conversation is well formed when its role initials read ``(s?(ua)+)?``. Rows may be kept (0),
given the role user or assistant (1) or deleted (2; blank rows and duplicates must be), empty turns of
either role may be inserted (5), and a truncated row that stays costs 5 more. Of the cheapest
repairs the one whose audit, the initials of its edits, comes first in ASCII order is taken.

Every path of the search is one integer: its high digits are the cost, its low digits, of fixed
width, the audit's letters from the left, with zeros behind the last one. So the smaller integer is
the cheaper repair or, at equal cost, the one with the lesser audit, and an ordinary minimum over the
edges of a graph (row x state of the pattern) decides everything. The graph is searched from its
end, where an edge adds its cost to the high digits and its letter before the others.

Rows are sorted over the whole table, conversations of any length run on over many tasks, and each
run of at most ``CHUNK`` rows is searched by itself, from every state to every state. Only these few
integers and counts of a conversation's chunks meet in one task, a few bytes a row, as its audit is
one value; texts don't. Insertions stand before a row or at the very end, so no audit of a chunk is
the beginning of another one's between the same states, and the least of the parts gives the least
of the whole.

Rows of a conversation are ordered by turn (nulls first), then role and a digest of the text. A null
id is a conversation of its own; a null role or text is one space, so such a text is blank; a role
with another initial than s, u or a can't be kept. Repeated rows are duplicates. Texts move whole and
are not cut. An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyspark.sql.types as T
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmeter.llm.store import ship, stored

#: Rows of a chunk, and characters after which one is closed early.
CHUNK, CHUNK_CHARS = 256, 1 << 20
#: Chunks sent on at a time.
SENT = 64
NOT_BLANK = r"[^\x20\x09-\x0D]"
# Costs and audit letters, the letters in ASCII order.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LETTERS = ".DIKR"
_D, _I, _K, _R = 1, 2, 3, 4
BITS = 3
#: States of the pattern (nothing yet, after s, after u, after a) and what each initial leads to.
STATES = range(4)
STEP = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
#: What is inserted at the very end: nothing, or the turns that are missing.
END = ["", "II", "I", ""]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times of ``rows`` after the damage that a digest of conversation and turn decides."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", blank)
    return rows.where(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 3, 2).otherwise(1).alias("times"),
    )


# ------------------------------------------------------------------ the search


def _edge(path: int, width: int, cost: int, letter: int) -> int:
    """A path with an edge of ``cost`` and ``letter`` set before it."""
    low = path & ((1 << BITS * width) - 1)
    return (((path >> BITS * width) + cost) << BITS * width) | (letter << BITS * (width - 1)) | (low >> BITS)


def _row_edges(state: int, kind: str) -> list[tuple[int, int, int]]:
    """(cost, letter, next state) of what can be done with a row: kind is its initial, fault and truncation."""
    edges = [(DELETE, _D, state)]
    if kind[1] != "-":
        return edges
    late = TRUNCATED * (kind[2] == "t")
    if kind[0] in STEP[state]:
        edges.append((late, _K, STEP[state][kind[0]]))
    return edges + [(REROLE + late, _R, STEP[state][r]) for r in "ua" if r in STEP[state]]


@lru_cache(maxsize=20_000)
def chunk_paths(kinds: tuple[str, ...]) -> tuple[tuple[int | None, ...], ...]:
    """[to][from]: the least path over the rows from state to state, None where there is none."""
    width = 3 * len(kinds)
    out = []
    for to in STATES:
        best: list[int | None] = [0 if q == to else None for q in STATES]
        for kind in reversed(kinds):
            here: list[int | None] = []
            for q in STATES:
                made = [_edge(best[n], width, c, x) for c, x, n in _row_edges(q, kind) if best[n] is not None]
                here.append(min(made, default=None))
            best = []
            for q in STATES:
                # Up to two turns are inserted before a row; more would lead back to a state.
                made, at = ([] if here[q] is None else [here[q]]), [q]
                for n in (1, 2):
                    at = [STEP[p][r] for p in at for r in "ua" if r in STEP[p]]
                    for p in at:
                        if here[p] is not None:
                            path = here[p]
                            for _ in range(n):
                                path = _edge(path, width, INSERT, _I)
                            made.append(path)
                best.append(min(made, default=None))
        out.append(tuple(best))
    return tuple(out)


def _joined(a: int, a_width: int, b: int, b_width: int) -> int:
    """The path ``a`` followed by the path ``b``, both with their own width."""
    low_a, low_b = a & ((1 << BITS * a_width) - 1), b & ((1 << BITS * b_width) - 1)
    empty = (low_a & -low_a).bit_length() - 1 if low_a else BITS * a_width
    empty -= empty % BITS  # bits of the zero digits behind the last letter of a
    cost = (a >> BITS * a_width) + (b >> BITS * b_width)
    return (cost << BITS * (a_width + b_width)) | (low_a << BITS * b_width) | (low_b << empty)


def letters(path: int, width: int) -> str:
    low = path & ((1 << BITS * width) - 1)
    text = format(low, "o").zfill(width) if width else ""
    return "".join(LETTERS[int(x)] for x in text.rstrip("0"))


def least_repair(chunks: list[tuple[int, list[int | None]]]) -> tuple[int, str]:
    """(cost, audit) over the chunks (rows, least paths from state to state) of one conversation."""
    width = 2
    after: list[int | None] = []
    for end in END:
        path = 0
        for _ in end:
            path = _edge(path, width, INSERT, _I)
        after.append(path)
    for rows, paths in reversed(chunks):
        here = []
        for q in STATES:
            made = [_joined(paths[4 * to + q], 3 * rows, after[to], width) for to in STATES if paths[4 * to + q] is not None]
            here.append(min(made, default=None))
        after, width = here, width + 3 * rows
    return after[0] >> BITS * width, letters(after[0], width)


def split_audit(audit: str, rows: list[int]) -> list[str]:
    """The audit's parts by the rows of each chunk; what is inserted at the end goes to the last one."""
    ends = [m.end() for m in re.finditer("[^I]", audit)]
    cuts, seen = [0], 0
    for n in rows[:-1]:
        seen += n
        cuts.append(ends[seen - 1])
    cuts.append(len(audit))
    return [audit[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def apply_edits(audit: str, state: int, rows: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], int]:
    """(repaired rows, state after them): the pattern and the audit alone decide every role."""
    out, at = [], 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        if letter == "K":
            role, text = rows[at]
        else:
            # Only one of the two fits a state; nothing but a user turn can begin a conversation.
            role, text = ("assistant" if "a" in STEP[state] else "user"), ("" if letter == "I" else rows[at][1])
        state = STEP[state][role[:1]]
        at += letter != "I"
        out.append((role, text))
    return out, state


# ------------------------------------------------------------------ over tables


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows in order over the whole table, with ``times`` and whether role and text come earlier."""
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    same = ["conv_id", "turn", "role", "digest"]
    rows = stored(rows.groupBy(same).agg(F.first("text").alias("text"), F.sum("times").alias("times")), "repair-rows")
    firsts = rows.groupBy(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest")).agg(
        F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns"))
    # Stored, so that the join starts from scans and its hot keys can be split.
    firsts = stored(firsts.where("turns > 1").drop("turns"), "repair-firsts")
    joined = rows.join(firsts, rows["conv_id"].eqNullSafe(firsts["f_conv"]) & (rows["role"] == firsts["f_role"])
                       & (rows["digest"] == firsts["f_digest"]), "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    last = F.regexp_extract("text", rf"(?s)({NOT_BLANK})[\x20\x09-\x0D]*$", 1)
    flat = joined.select(
        *same, "times", later.alias("later"), ~F.col("text").rlike(NOT_BLANK).alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut"), "text")
    return flat.repartitionByRange(*same).sortWithinPartitions(*same)


@dataclass
class _Chunk:
    conv: object
    kinds: list[str]
    roles: list[str]
    texts: list[str]
    turns: list[int]
    chars: int = 0

    def row(self, number: int) -> tuple:
        paths = [None if p is None else p.to_bytes((p.bit_length() + 8) // 8, "big") for to in chunk_paths(tuple(self.kinds)) for p in to]
        initials = [r[:1] for r in self.roles]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        faults = [sum(k[1] == f for k in self.kinds) for f in "bd"] + [sum(k[1:] == "-t" for k in self.kinds)]
        turns = [self.turns[0], self.turns[-1], len(set(self.turns))] if self.turns else [None, None, 0]
        return (self.conv, number, len(self.kinds), paths, *faults, illegal, initials[0], initials[-1], *turns, self.roles, self.texts)


def _chunks(rows: DataFrame) -> DataFrame:
    """A row for each run of at most ``CHUNK`` rows of a conversation, in the order of the column ``chunk``."""
    schema = T.StructType([
        rows.schema["conv_id"], T.StructField("chunk", T.LongType()), T.StructField("rows", T.LongType()),
        T.StructField("paths", T.ArrayType(T.BinaryType())), *(T.StructField(c, T.LongType()) for c in ("blank", "duplicate", "truncated", "illegal")),
        T.StructField("first_initial", T.StringType()), T.StructField("last_initial", T.StringType()),
        *(T.StructField(c, T.LongType()) for c in ("first_turn", "last_turn", "turns")),
        T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType())),
    ])
    arrow = {"bigint": pa.int64(), "string": pa.string(), "array<binary>": pa.list_(pa.binary()), "array<string>": pa.list_(pa.string())}

    def batch_of(made: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
        kinds = [conv_type, *(arrow[f.dataType.simpleString()] for f in schema.fields[1:])]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made, chunk, conv_type = TaskContext.get().partitionId() << 40, [], None, None
        for batch in batches:
            conv_type = batch.schema.field(0).type
            conv, turn, role, _, times, later, blank, cut, text = (batch.column(i) for i in range(batch.num_columns))
            for i in range(batch.num_rows):
                c, r, t, x = conv[i].as_py(), role[i].as_py(), turn[i].as_py(), text[i].as_py()
                own = "b" if blank[i].as_py() else "d" if later[i].as_py() else "-"
                end = "t" if cut[i].as_py() else "-"
                for copy in range(times[i].as_py()):
                    if chunk is None or chunk.conv != c or len(chunk.kinds) == CHUNK or chunk.chars > CHUNK_CHARS:
                        if chunk is not None:
                            made.append(chunk.row(number))
                            number += 1
                        if len(made) == SENT:
                            yield batch_of(made, conv_type)
                            made = []
                        chunk = _Chunk(c, [], [], [], [])
                    fault = "d" if copy and own == "-" else own
                    chunk.kinds.append(r[:1].ljust(1) + fault + end)
                    chunk.roles.append(r)
                    # What must be deleted needs no text any more.
                    chunk.texts.append(x if fault == "-" else "")
                    chunk.chars += len(x) if fault == "-" else 0
                    if t is not None:
                        chunk.turns.append(t)
        if chunk is not None:
            yield batch_of([*made, chunk.row(number)], conv_type)

    return rows.mapInArrow(run, schema)


def _decisions(chunks: DataFrame) -> DataFrame:
    """A row per chunk: its part of the audit and the state before it; the first chunk's row also has the conversation's figures."""
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([
        chunks.schema["conv_id"], T.StructField("d_chunk", T.LongType()), T.StructField("part", T.StringType()), T.StructField("state", T.IntegerType()),
        T.StructField("first", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in figures), T.StructField("audit", T.StringType()),
    ])
    narrow = chunks.drop("roles", "texts")

    def decided(own: list[dict]) -> list[tuple]:
        paths = [(c["rows"], [None if p is None else int.from_bytes(p, "big") for p in c["paths"]]) for c in own]
        cost, audit = least_repair(paths)
        pairs = list(zip(own, own[1:], strict=False))
        illegal = sum(c["illegal"] for c in own) + sum(a["last_initial"] + b["first_initial"] not in ("su", "ua", "au") for a, b in pairs)
        dated = [c for c in own if c["turns"]]
        gaps = 0
        if dated:
            shared = sum(a["last_turn"] == b["first_turn"] for a, b in zip(dated, dated[1:], strict=False))
            gaps = dated[-1]["last_turn"] - dated[0]["first_turn"] + 1 - (sum(c["turns"] for c in dated) - shared)
        totals = (gaps, *(sum(c[f] for c in own) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit)
        out, state = [], 0
        for k, (c, part) in enumerate(zip(own, split_audit(audit, [c["rows"] for c in own]), strict=True)):
            out.append((c["conv_id"], c["chunk"], part, state, k == 0, *(totals if k == 0 else (None,) * 7)))
            # Kept rows alone tell the state they lead to.
            state = apply_edits(part, state, c["initials"])[1]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[dict] = []
        made: list[tuple] = []
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int32(), pa.bool_(), *[pa.int64()] * 6, pa.string()]
            for row in batch.to_pylist():
                row["initials"] = [(r, "") for r in row["initials"]]
                if own and own[0]["conv_id"] != row["conv_id"]:
                    made += decided(own)
                    own = []
                own.append(row)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], schema.names)
                made = []
        if own:
            made = decided(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], schema.names)

    narrow = chunks.select(*narrow.columns, F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials"))
    return narrow.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(run, schema)


@dataclass(frozen=True)
class Repair:
    """``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each one that has rows.
    ``turns``: conv_id, chunk, place, role, text of the repaired rows, in the order of chunk and place."""

    conversations: DataFrame
    turns: DataFrame


def repair(rows: DataFrame) -> Repair:
    """Repair the conversations of (conv_id, turn, role, text, times)."""
    ship(rows.sparkSession)
    chunks = stored(_chunks(_ordered(rows)), "repair-chunks")
    decisions = stored(_decisions(chunks), "repair-decisions")
    parts = decisions.select("d_chunk", "part", "state")
    texts = chunks.select("conv_id", "chunk", "roles", "texts").join(parts, F.col("chunk") == F.col("d_chunk"))
    schema = T.StructType([
        rows.schema["conv_id"], T.StructField("chunk", T.LongType()), T.StructField("place", T.IntegerType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                row = {k: one.column(k)[0].as_py() for k in ("chunk", "roles", "texts", "part", "state")}
                made, _ = apply_edits(row["part"], row["state"], list(zip(row["roles"], row["texts"], strict=True)))
                if made:
                    n = len(made)
                    conv = pa.array([one.column("conv_id")[0].as_py()] * n, one.schema.field("conv_id").type)
                    yield pa.RecordBatch.from_arrays([
                        conv, pa.array([row["chunk"]] * n, pa.int64()), pa.array(range(n), pa.int32()),
                        pa.array([r for r, _ in made], pa.string()), pa.array([t for _, t in made], pa.string())], schema.names)

    turns = texts.select("conv_id", "chunk", "roles", "texts", "part", "state").mapInArrow(run, schema)
    return Repair(decisions.where("first").drop("d_chunk", "part", "state", "first"), turns)


def digests(turns: DataFrame) -> DataFrame:
    """h_conv, sha256 of ``role:text`` lines; a conversation of any length streams through."""
    schema = T.StructType([T.StructField("h_conv", turns.schema["conv_id"].dataType), T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, kind, made = None, None, None, []
        for batch in batches:
            kind = batch.schema.field(0).type
            for c, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest is not None and c == conv:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        made.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256()
                digest.update(line.as_buffer() or b"")
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], kind), pa.array([m[1] for m in made])], schema.names)
                made = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], schema.names)

    line = F.concat(F.col("role"), F.lit(":"), F.col("text")).alias("line")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "place")
    return ordered.select("conv_id", line).mapInArrow(run, schema)


def damage_and_repair(table: DataFrame) -> DataFrame:
    """A row per conversation of ``table``: the figures of its repair after damage, and the digest of the repaired text."""
    done = repair(damaged(table))
    found = stored(done.conversations, "repair-conversations")
    hashed = stored(digests(done.turns), "repair-digests")
    ids = stored(table.select(F.col("conv_id").alias("i_conv")).distinct(), "repair-ids")
    joined = ids.join(found, ids["i_conv"].eqNullSafe(found["conv_id"]), "left").drop("conv_id")
    joined = joined.join(hashed, joined["i_conv"].eqNullSafe(hashed["h_conv"]), "left")

    def or_else(name: str, value: object) -> Column:
        return F.coalesce(F.col(name), F.lit(value)).alias(name)

    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        F.col("i_conv").alias("conv_id"), *zeros, or_else("audit", ""),
        F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
