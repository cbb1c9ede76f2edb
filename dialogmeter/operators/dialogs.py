"""Examples (context, candidate, next turn) from a table with one row per turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogmeter.functions.tokens import token_count, tokens_in_line
from dialogmeter.session import landed

BLOCK_TURNS = 256


def turn_neighbours(
    turns: DataFrame, dialog: str = "conv_id", turn: str = "turn", text: str = "text",
    history: int | None = None, block: int = BLOCK_TURNS,
) -> DataFrame:
    """Add ``context`` (the turns before, one per line) and ``ref`` (the next turn).

    All earlier turns are taken, or only those at most ``history`` turns back. Turns are
    shuffled by dialogue and block of ``block`` turns, so a dialogue of any length is worked on
    in pieces of bounded size; the few turns that a neighbouring block needs are copied to it.
    Without ``history`` the texts of a dialogue's earlier blocks are joined once for each of its
    blocks and set before the block's own turns. A context too long for a cell is an error.
    """
    if history is not None and history >= block:
        raise ValueError("history must be shorter than a block")

    def block_of(t: Column) -> Column:
        return F.floor(F.greatest(t, F.lit(0)) / F.lit(block))

    t = F.col(turn)
    homes = [block_of(t), block_of(t - 1)] + ([] if history is None else [block_of(t + history)])
    placed = turns.withColumn("_block", F.explode(F.array_distinct(F.array(*homes))))
    order = Window.partitionBy(dialog, "_block").orderBy(turn)
    first = Window.unboundedPreceding if history is None else -history
    before = F.collect_list(text).over(order.rangeBetween(first, -1))
    after = F.max(text).over(order.rangeBetween(1, 1))
    placed = (
        placed.withColumn("_before", before)
        .withColumn("ref", after)
        .where(F.col("_block") == block_of(t))
        .withColumn("context", F.when(F.size("_before") > 0, F.array_join("_before", "\n")))
        .drop("_before")
    )
    if history is None:
        placed = placed.join(_earlier_blocks(turns, dialog, turn, text, block_of(t)), [dialog, "_block"], "left")
        # concat_ws leaves out what is null: a first block has no earlier text, its first turn no own.
        both = F.concat_ws("\n", "_earlier", "context")
        placed = placed.withColumn("context", F.when(F.coalesce("_earlier", "context").isNotNull(), both)).drop("_earlier")
    return placed.select(*turns.columns, "ref", "context")


def _earlier_blocks(turns: DataFrame, dialog: str, turn: str, text: str, block_of: Column) -> DataFrame:
    """dialog, _block, _earlier: the text of all earlier blocks, for blocks that have any.

    Only the blocks' texts meet here, never the turns of a whole dialogue.
    """
    blocks = turns.where(F.col(text).isNotNull()).groupBy(F.col(dialog), block_of.alias("_block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, text))), lambda x: x[text]), "\n").alias("_text")
    )
    last = turns.groupBy(dialog).agg(F.max(block_of).alias("_last")).where("_last > 0")
    pieces = blocks.join(last, dialog).where(F.col("_block") < F.col("_last")).select(
        dialog, F.explode(F.sequence(F.col("_block") + 1, F.col("_last"))).alias("_for"), "_block", "_text"
    )
    return pieces.groupBy(dialog, F.col("_for").alias("_block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_text"))), lambda x: x["_text"]), "\n").alias("_earlier")
    )


def _block_of(turn: Column, block: int) -> Column:
    return F.floor(F.greatest(turn, F.lit(0)) / F.lit(block))


def _with_earlier(rows: DataFrame, dialog: str, at: str, ends: dict[str, Column], total: bool = False) -> DataFrame:
    """Add ``<name>_before``: the last (or, as a ``total``, the sum) of what ``ends`` gives of each earlier block.

    Blocks are few beside rows, and those without anything earlier are left out of the join.
    """
    blocks = rows.groupBy(F.col(dialog).alias("_b_dialog"), F.col(at).alias("_b_at")).agg(*[c.alias(n) for n, c in ends.items()])
    before = Window.partitionBy("_b_dialog").orderBy("_b_at").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"{n}_before" for n in ends]
    seen = [(F.sum(n) if total else F.last(n, ignorenulls=True)).over(before).alias(f"{n}_before") for n in ends]
    earlier = blocks.select("_b_dialog", "_b_at", *seen).where(" or ".join(f"{n} is not null" for n in names))
    same = rows[dialog].eqNullSafe(F.col("_b_dialog")) & (rows[at] == F.col("_b_at"))
    return rows.join(earlier, same, "left").drop("_b_dialog", "_b_at")


def last_turns(turns: DataFrame, dialog: str = "conv_id", turn: str = "turn", text: str = "text", block: int = BLOCK_TURNS) -> DataFrame:
    """Add ``context`` (the last turn before that has a text) and ``ref`` (the next turn), without the whole context.

    Dialogues are worked on in blocks of turns. Where no turn of a block has a text before a row,
    the last text of the blocks before is taken; of each block only that one row meets the others'.
    """
    t = F.col(turn)
    ends = turns.withColumn("_block", _block_of(t, block))
    placed = turns.withColumn("_block", F.explode(F.array_distinct(F.array(_block_of(t, block), _block_of(t - 1, block)))))
    order = Window.partitionBy(dialog, "_block").orderBy(turn)
    placed = (
        placed.withColumn("_own", F.last(text, ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, -1)))
        .withColumn("ref", F.max(text).over(order.rangeBetween(1, 1)))
        .where(F.col("_block") == _block_of(t, block))
    )
    last = ends.groupBy(F.col(dialog).alias("_b_dialog"), F.col("_block").alias("_b_at")).agg(
        F.max_by(text, F.when(F.col(text).isNotNull(), t)).alias("_end"))
    before = Window.partitionBy("_b_dialog").orderBy("_b_at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = last.select("_b_dialog", "_b_at", F.last("_end", ignorenulls=True).over(before).alias("_earlier")).where("_earlier is not null")
    joined = placed.join(earlier, placed[dialog].eqNullSafe(F.col("_b_dialog")) & (placed["_block"] == F.col("_b_at")), "left")
    return joined.select(*turns.columns, "ref", F.coalesce("_own", "_earlier").alias("context"))


def prompt_lengths(turns: DataFrame, dialog: str = "conv_id", turn: str = "turn", text: str = "text", block: int = BLOCK_TURNS) -> DataFrame:
    """dialog, turn, ``tokens`` (of the turn) and ``context_tokens``: the number of tokens of all turns before, joined by line ends.

    No context is built: counts are summed within blocks of turns, and the blocks' sums over the
    blocks. A token does not run over a line end, but a hyphen before one joins two lines: turns
    that end with a hyphen are put together with the turn after them and counted as one text.
    ``context_tokens`` is null where nothing was said before. A turn stands for one row.
    """
    said = F.col(text).isNotNull()
    numbers = turns.select(
        F.col(dialog).alias("d"), F.col(turn).alias("t"), _block_of(F.col(turn), block).alias("b"),
        F.when(said, F.col(text).endswith("-")).alias("hyphen"), token_count(F.col(text)).alias("tokens"),
        # What the turn counts as long as it is the last one, and when another one follows.
        token_count(F.col(text)).alias("open"), tokens_in_line(F.col(text)).alias("closed"),
    )
    numbers = landed(numbers, "turn-lengths")
    if not numbers.where("hyphen").isEmpty():
        numbers = landed(_glued(numbers, turns.select(F.col(dialog).alias("x_d"), F.col(turn).alias("x_t"), F.col(text).alias("x"))), "glued-lengths")
    order = Window.partitionBy("d", "b").orderBy("t")
    summed = _with_earlier(numbers, "d", "b", {"closed_sum": F.sum("closed")}, total=True)
    before = F.coalesce(F.sum("closed").over(order.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.coalesce("closed_sum_before", F.lit(0))
    reached = landed(summed.withColumn("reached", before + F.col("open")).drop("closed_sum_before"), "running-lengths")
    reached = _with_earlier(reached, "d", "b", {"end": F.max_by("reached", F.when(F.col("reached").isNotNull(), F.col("t")))})
    own = F.last("reached", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, -1))
    return reached.select(F.col("d").alias(dialog), F.col("t").alias(turn), "tokens", F.coalesce(own, "end_before").alias("context_tokens"))


def _glued(numbers: DataFrame, texts: DataFrame) -> DataFrame:
    """The numbers with those of turns joined by hyphens replaced: open by the count of the run so far, closed by 0 but for its end."""
    order = Window.partitionBy("d", "b").orderBy("t")
    said = numbers.where("hyphen is not null")
    flagged = _with_earlier(said, "d", "b", {"last_hyphen": F.max_by("hyphen", "t")})
    joined = F.coalesce(F.lag("hyphen").over(order), F.col("last_hyphen_before"), F.lit(False))
    flagged = landed(flagged.withColumn("joined", joined).drop("last_hyphen_before"), "joined-turns")
    begun = _with_earlier(flagged, "d", "b", {"run": F.max(F.when(~F.col("joined"), F.col("t")))})
    first = F.last(F.when(~F.col("joined"), F.col("t")), ignorenulls=True).over(order)
    runs = begun.withColumn("run", F.coalesce(first, "run_before"))
    runs = runs.where("hyphen or joined").select(F.col("d").alias("r_d"), F.col("t").alias("r_t"), "run", F.col("hyphen").alias("r_hyphen"))
    parts = runs.join(texts, runs["r_d"].eqNullSafe(texts["x_d"]) & (runs["r_t"] == texts["x_t"]))
    so_far = F.array_join(F.collect_list("x").over(Window.partitionBy("r_d", "run").orderBy("r_t")), "\n")
    counted = parts.withColumn("so_far", so_far).select(
        "r_d", "r_t", token_count(F.col("so_far")).alias("r_open"), F.when(F.col("r_hyphen"), 0).otherwise(tokens_in_line(F.col("so_far"))).alias("r_closed"))
    both = numbers.join(counted, numbers["d"].eqNullSafe(F.col("r_d")) & (numbers["t"] == F.col("r_t")), "left")
    return both.withColumns({"open": F.coalesce("r_open", "open"), "closed": F.coalesce("r_closed", "closed")}).drop("r_d", "r_t", "r_open", "r_closed")


def reply_examples(turns: DataFrame, role: str = "assistant", history: int | None = None, context: str = "whole") -> DataFrame:
    """One example for each reply of ``role`` that has something said before it.

    With ``context="last"`` the context is the last turn alone: enough wherever only its last line counts.
    """
    if context not in ("whole", "last"):
        raise ValueError("context must be 'whole' or 'last'")
    return (
        (last_turns(turns) if context == "last" else turn_neighbours(turns, history=history))
        .where((F.col("role") == role) & F.col("context").isNotNull())
        .select("conv_id", "turn", "context", "ref", F.col("text").alias("cand"))
    )
