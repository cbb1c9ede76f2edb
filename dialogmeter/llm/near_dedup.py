"""Operator 6: near duplicates by ProbMinHash, banding and verification.

Elements are runs of five words (of all words in a shorter text), weighted 1 + log of how often
they occur. Each element's arrivals are a Poisson process with its weight as rate, each arrival
at a random register; a register keeps the element that came first, and an element's process ends
once its next arrival is later than every register's. Two texts agree in a register with the
probability that is their probability Jaccard similarity. Texts that agree in all registers of a
band are candidates; those whose registers agree often enough are verified exactly, by the
probability Jaccard similarity of all their elements, and linked from ``SIMILAR`` on. Classes are
the connected components.

Texts with the same words (ASCII letters lower-cased) are one text from the start. Within a band's
bucket the members are verified against a few pivots first, the smallest of all there, which
overlapping buckets share; so most of a large group is one class after one round. What is left to
compare are members of one bucket that are in different classes. They meet in blocks of bounded
size, where numpy compares a longer sketch of each (``SKETCH`` more registers). The pairs that can be
linked leave the block packed, as one meeting of at most two tiles of members; a meeting gets each of its
members' texts once, verifies its pairs, the likeliest first, while they are in different classes, and
gives only the links that unite classes. So a group gives rows by its members, not by its pairs.

Null and empty texts are one class. Repeated rows are members of one class; null ids are ids that
sort last. All words of a text count, however long it is. An empty table gives an empty result; other columns pass through ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmeter.llm.store import ship, stored
from dialogmeter.llm.textbuf import WHITESPACE, mix64, words_by_text

WORDS, SIMILAR = 5, 0.8
REGISTERS, BAND = 128, 4
#: Registers of the longer sketch, 8 bits of each.
SKETCH = 1024
#: Pairs whose sketches agree less often are not verified: five standard deviations below ``SIMILAR``, so
#: at a similarity of 0.8 or more a share this small has a probability of 1e-6 at most.
LEAST_AGREEMENT = SIMILAR - 5 * (SIMILAR * (1 - SIMILAR) / SKETCH) ** 0.5
#: Pivots of a bucket.
PIVOTS = 4
#: Groups of so many members are paired many at a time, larger ones row by row.
SMALL = 64
#: Members of a block at most, roughly.
BLOCK = 2048
#: Pairs of sketches compared at a time.
COMPARED = 1 << 13
#: Members of a tile at most, and their words together, but for a tile of one.
TILE, TILE_WORDS = 256, 1 << 20
#: Packed pairs held at a time, roughly.
PACKED = 1 << 18
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, weight) of consecutive texts' distinct word runs, ordered by text."""
    texts = len(counts)
    ends = np.cumsum(counts)
    starts = ends - counts
    owner, element = [], []
    if len(words) >= WORDS:
        run = np.zeros(len(words) - WORDS + 1, np.uint64)
        for k in range(WORDS):
            run = run * _A + words[k : k + len(run)]
        of = np.searchsorted(ends, np.arange(len(run)), "right")
        whole = np.arange(len(run)) + WORDS <= ends[of]
        owner.append(of[whole])
        element.append(mix64(run[whole]))
    for i in np.flatnonzero((counts > 0) & (counts < WORDS)):
        run = np.uint64(counts[i])
        with np.errstate(over="ignore"):
            for w in words[starts[i] : ends[i]]:
                run = run * _B + w
        owner.append(np.array([i]))
        element.append(mix64(np.array([run], np.uint64)))
    if not owner:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    owner, element = np.concatenate(owner), np.concatenate(element)
    bits = np.uint64(max(1, int(texts - 1).bit_length()))
    # Text and element share a word for sorting; the element keeps its leading bits, 48 at least.
    keep = np.uint64(16)
    if int(bits) > 16:
        raise ValueError("too many texts at a time")
    key, times = np.unique((owner.astype(np.uint64) << np.uint64(48)) | (element >> keep), return_counts=True)
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), 1 + np.log(times)


def registers(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, size: int = REGISTERS, seed: int = 0) -> np.ndarray:
    """texts x size: the element that arrived first in each register (0 for a text without elements)."""
    first = np.full(texts * size, np.inf)
    winner = np.zeros(texts * size, np.uint64)
    seed = mix64(element * _A + _B + np.uint64(seed))
    at, clock, step = np.arange(len(owner)), np.zeros(len(owner)), 0
    while len(at):
        # The fewer elements are left, the more arrivals of each at a time.
        block = int(np.clip((1 << 14) // len(at), 1, 64))
        ahead = np.arange(step, step + block, dtype=np.uint64) * _B
        draw = mix64(seed[at][:, None] + ahead)
        gap = -np.log((draw >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) / weight[at][:, None]
        time = clock[:, None] + np.cumsum(gap, 1)
        slot = (owner[at][:, None] * size + (draw & np.uint64(size - 1)).astype(np.int64)).ravel()
        flat = time.ravel()
        np.minimum.at(first, slot, flat)
        won = flat == first[slot]
        winner[slot[won]] = np.repeat(element[at], block)[won]
        last = first.reshape(texts, size).max(1)
        going = time[:, -1] < last[owner[at]]
        at, clock, step = at[going], time[going, -1], step + block
    return winner.reshape(texts, size)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), same (digest of the words), bands of every row."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    names = ["doc_id", "key", "same", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, words, counts in words_by_text(batch.column(2)):
                n, ends = len(counts), np.cumsum(counts)
                same = [hashlib.blake2b(words[e - c : e].tobytes(), digest_size=16).digest() for c, e in zip(counts, ends, strict=True)]
                found = registers(*shingles(words, counts), n)
                bands = np.zeros((n, REGISTERS // BAND), np.uint64)
                for k in range(BAND):
                    bands = mix64(bands * _A + found[:, k::BAND])
                bands = mix64(bands + np.arange(REGISTERS // BAND, dtype=np.uint64))
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (REGISTERS // BAND))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, n), batch.column(1).slice(start, n), pa.array(same, pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(bands.view(np.int64).ravel())),
                ], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, key bigint, same binary, bands array<bigint>")


def sketches(texts: DataFrame) -> DataFrame:
    """node, sketch, words of (node, text): ``SKETCH`` registers of 8 bits, apart from those of the bands, and the number of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, words, counts in words_by_text(batch.column(1)):
                n = len(counts)
                found = mix64(registers(*shingles(words, counts), n, SKETCH, 1)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, n), pa.array([f.tobytes() for f in found], pa.binary()), pa.array(counts.astype(np.int64))],
                    ["node", "sketch", "words"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, sketch binary, words bigint")


def _matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def likely(pairs: DataFrame) -> DataFrame:
    """a, b of the pairs with columns ``sketch_a`` and ``sketch_b`` that agree often enough."""
    least = LEAST_AGREEMENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, COMPARED):
                part = batch.slice(first, COMPARED)
                enough = (_matrix(part.column(2), np.uint8, SKETCH) == _matrix(part.column(3), np.uint8, SKETCH)).mean(1) >= least
                yield pa.RecordBatch.from_arrays(part.columns[:2], ["a", "b"]).filter(pa.array(enough))

    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a bigint, b bigint")


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability Jaccard similarity of two weighted sets of (sorted elements, weights)."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = a[1][i], b[1][j]
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    # For each common element: the sum over all elements of the larger of both scaled weights.
    from_here = np.cumsum(x[::-1])[::-1]
    before = np.cumsum(y) - y
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    return float((1 / ((from_here + only_a) / x + (before + only_b) / y)).sum())


def elements(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted elements, weights) of each text."""
    out = []
    for _, words, counts in words_by_text(column, WHITESPACE):
        owner, element, weight = shingles(words, counts)
        ends = np.searchsorted(owner, np.arange(len(counts) + 1))
        out += [(element[s:e], weight[s:e]) for s, e in zip(ends, ends[1:], strict=False)]
    return out


def similarities(pairs: DataFrame) -> DataFrame:
    """a, b, similar of pairs with columns ``text_a`` and ``text_b``; all elements of both texts count."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                found = [probability_jaccard(x, y) for x, y in zip(elements(part.column(2)), elements(part.column(3)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.float64())], ["a", "b", "similar"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, similar double")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component, for the nodes that have an edge (a, b)."""
    edges = stored(edges.select("a", "b").distinct(), "edges", narrow=True)
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("up")), "parents", narrow=True)
        if labels is None:
            labels = parent.withColumnRenamed("up", "root")
        else:
            up = parent.select(F.col("node").alias("p_node"), "up")
            labels = labels.join(up, labels["root"] == up["p_node"], "left").select("node", F.coalesce("up", "root").alias("root"))
        labels = stored(labels, "labels", narrow=True)
        up_a, up_b = (parent.select(F.col("node").alias(f"n_{k}"), F.col("up").alias(f"u_{k}")) for k in "ab")
        # Each node moves to its smallest neighbour; edges between what they moved to remain.
        moved = edges.join(up_a, edges["a"] == up_a["n_a"]).join(up_b, F.col("b") == up_b["n_b"])
        a, b = F.least("u_a", "u_b"), F.greatest("u_a", "u_b")
        kept = moved.select(a.alias("a"), b.alias("b"))
        edges = stored(kept.where("a <> b").distinct(), "edges", narrow=True)
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``pairs`` with ``column`` of both nodes as ``<column>_a`` and ``<column>_b``."""
    for k in "ab":
        side = table.select(F.col("node").alias(f"n_{k}"), F.col(column).alias(f"{column}_{k}"))
        pairs = pairs.join(side, pairs[k] == F.col(f"n_{k}")).drop(f"n_{k}")
    return pairs


def links(pairs: DataFrame, texts: DataFrame, label: str) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough, verified by all their elements."""
    found = similarities(_both(pairs.select("a", "b"), texts, "text"))
    return stored(found.where(F.col("similar") >= SIMILAR).select("a", "b"), f"{label}-links")


def _texts_of(nodes: DataFrame, live: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text of the nodes that share a bucket with another."""
    wanted = nodes.select("node", "doc_id", "key").join(live.select(F.col("node").alias("w")).distinct(), F.col("node") == F.col("w"), "left_semi")
    wanted = wanted.select("node", F.col("doc_id").alias("w_id"), F.col("key").alias("w_key"))
    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    texts = texts.join(wanted, (texts["key"] == wanted["w_key"]) & texts["doc_id"].eqNullSafe(wanted["w_id"]))
    texts = stored(texts.select("node", "text"), "near-texts")
    # Rows that repeat both id and text are the same text.
    repeated = not texts.groupBy("node").count().where("count > 1").isEmpty()
    return texts.dropDuplicates(["node"]) if repeated else texts


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _blocks(members: DataFrame) -> DataFrame:
    """bucket, block, own (its class, if there is no other in it) and the members' columns.

    A class of over ``BLOCK`` members of a bucket has blocks of its own; the others are dealt by class.
    """
    classes_ = members.groupBy(F.col("bucket").alias("c_bucket"), F.col("root").alias("c_root")).agg(F.count("*").alias("n"))
    classes_ = stored(classes_, "bucket-classes", narrow=True)
    sizes = classes_.groupBy(F.col("c_bucket").alias("z_bucket")).agg(
        F.count("*").alias("classes"), F.sum(F.when(F.col("n") <= BLOCK, F.col("n"))).alias("small")).where("classes > 1")
    sizes = stored(sizes, "bucket-sizes", narrow=True)
    large = classes_.where(F.col("n") > BLOCK).select(F.col("c_bucket").alias("l_bucket"), F.col("c_root").alias("l_root"), F.col("n").alias("large"))
    large = stored(large, "large-classes", narrow=True)
    open_ = members.join(sizes.drop("classes"), members["bucket"] == sizes["z_bucket"]).drop("z_bucket")
    placed = open_.join(large, (open_["bucket"] == F.col("l_bucket")) & (open_["root"] == F.col("l_root")), "left")

    def slot(column: str, size: str) -> Column:
        return F.pmod(F.xxhash64(column), F.ceil(F.col(size) / BLOCK))

    own = F.when(F.col("large").isNotNull(), F.col("root"))
    block = F.when(F.col("large").isNotNull(), F.xxhash64("root", slot("node", "large"))).otherwise(slot("root", "small"))
    return placed.select("bucket", "node", "root", block.alias("block"), own.alias("own"))


def across_classes(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b of all pairs of ``meetings``, a row each."""
    pair = F.explode(F.arrays_zip(F.col("i"), F.col("j")))
    pairs = meetings(members, nodes).select("nodes", pair.alias("p")).select(F.expr("nodes[p.i]").alias("x"), F.expr("nodes[p.j]").alias("y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def meetings(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes, roots, i, j: the members (bucket, node, root) of one bucket that can be linked and differ in ``root``, packed.

    Every such pair is compared by its sketches, in groups of one or two blocks; it leaves the first
    bucket that both share, and only if it agrees often enough. A row has the pairs of two tiles of members:
    those in some pair, their classes, and the pairs' places among them, those that agree most first.
    ``nodes`` has node, sketch, bands and, for tiles of few words, words.
    """
    ship(members.sparkSession)
    placed = stored(_blocks(members), "blocks", narrow=True)
    blocks = stored(placed.select("bucket", "block", "own").distinct(), "block-list", narrow=True)
    other = blocks.select(F.col("bucket").alias("o_bucket"), F.col("block").alias("other"), F.col("own").alias("o_own"))
    meet = blocks.join(other, (blocks["bucket"] == other["o_bucket"]) & (blocks["block"] <= other["other"]))
    meet = meet.where(F.col("own").isNull() | F.col("o_own").isNull() | (F.col("own") != F.col("o_own")))
    meet = meet.select(F.col("bucket").alias("m_bucket"), F.col("block").alias("first"), F.col("other").alias("second"))
    sides = meet.select("m_bucket", "first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("m_block"))
    sides = stored(sides, "block-pairs", narrow=True)
    rows = placed.join(sides, (placed["bucket"] == sides["m_bucket"]) & (placed["block"] == sides["m_block"]))
    rows = rows.select("bucket", "first", "second", (F.col("block") == F.col("first")).alias("left"), "node", "root")
    words = F.col("words") if "words" in nodes.columns else F.lit(1).cast("long")
    sketch = nodes.select(F.col("node").alias("s_node"), "sketch", "bands", words.alias("words"))
    rows = rows.join(sketch, rows["node"] == sketch["s_node"]).drop("s_node")
    keys = ["bucket", "first", "second"]
    small, least, tile, tile_words, most = SMALL, LEAST_AGREEMENT, TILE, TILE_WORDS, PACKED

    def pairs_of(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of the pairs of consecutive groups, a bounded number at a time."""
        for size in np.unique(sizes[(sizes > 1) & (sizes <= small)]):
            i, j = np.triu_indices(size, 1)
            at = starts[sizes == size]
            step = max(1, COMPARED // len(i))
            for k in range(0, len(at), step):
                yield (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
        for start, size in zip(starts[sizes > small], sizes[sizes > small], strict=True):
            for i in range(start, start + size - 1):
                yield np.full(start + size - 1 - i, i), np.arange(i + 1, start + size)

    def packed(found: list[np.ndarray], tiles: np.ndarray, node: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        """A row for each two tiles that have pairs (first place, second place, agreement)."""
        i, j, agree = (np.concatenate(x) for x in zip(*found, strict=True))
        key = tiles[i] * len(node) + tiles[j]
        order = np.lexsort((-agree, key))
        i, j, key = i[order], j[order], key[order]
        out = []
        for part in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1):
            # A member may be in several buckets.
            both = np.concatenate([i[part], j[part]])
            held, first, at = np.unique(node[both], return_index=True, return_inverse=True)
            out.append((held, root[both[first]], *np.split(at.astype(np.int32), 2)))
        columns = []
        for lists in zip(*out, strict=True):
            cuts = pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
            columns.append(pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(lists))))
        return pa.RecordBatch.from_arrays(columns, ["nodes", "roots", "i", "j"])

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """The pairs of whole groups."""
        table = table.combine_chunks()
        key = np.stack([table.column(k).to_numpy() for k in keys], 1)
        starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
        sizes = np.diff(np.append(starts, len(key)))
        bucket, one = key[:, 0], key[:, 1] == key[:, 2]
        left, node, root = (table.column(k).to_numpy() for k in ("left", "node", "root"))
        sketch = _matrix(table.column("sketch"), np.uint8, SKETCH)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(key), -1)
        ends = np.cumsum(table.column("words").to_numpy())
        tiles = np.cumsum(np.append(0, np.diff(np.arange(len(key)) // tile) + np.diff(ends // tile_words) > 0))
        found, held = [], 0
        for i, j in pairs_of(starts, sizes):
            differ = (root[i] != root[j]) & (one[i] | (left[i] != left[j]))
            i, j = i[differ], j[differ]
            if not len(i):
                continue
            agree = (sketch[i] == sketch[j]).mean(1)
            enough = agree >= least
            i, j, agree = i[enough], j[enough], agree[enough]
            if not len(i):
                continue
            shared = bands[i] == bands[j]
            here = bands[i, shared.argmax(1)] == bucket[i]
            found.append((i[here], j[here], agree[here]))
            held += int(here.sum())
            if held >= most:
                yield packed(found, tiles, node, root)
                found, held = [], 0
        if held:
            yield packed(found, tiles, node, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # rows of the last group, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
            same = np.all([batch.column(k).to_numpy() == v for k, v in zip(keys, last, strict=True)], 0)
            begin = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if begin or (waiting and [waiting[-1].column(k)[0].as_py() for k in keys] != last):
                yield from compared(pa.Table.from_batches([*waiting, batch.slice(0, begin)]))
                waiting = []
            waiting.append(batch.slice(begin))
        if waiting:
            yield from compared(pa.Table.from_batches(waiting))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "nodes array<bigint>, roots array<bigint>, i array<int>, j array<int>")


def uniting(met: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: links between members of ``meetings`` that unite their classes as all links would."""
    ship(met.sparkSession)
    met = stored(met.withColumn("meet", F.monotonically_increasing_id()), "meetings")
    member = met.select("meet", F.posexplode("nodes").alias("place", "m_node"))
    text = texts.select(F.col("node").alias("t_node"), "text")
    member = member.join(text, member["m_node"] == text["t_node"]).select("meet", "place", "text")
    # A meeting's own row stands before those of its members.
    own = met.withColumns({"place": F.lit(-1), "text": F.lit(None).cast("string")})
    rows = own.unionByName(member, allowMissingColumns=True).select("meet", "place", "text", "nodes", "roots", "i", "j")

    def judged(meeting: list[np.ndarray], held: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        nodes, roots, i, j = meeting
        at = np.unique(roots, return_inverse=True)[1].tolist()
        up, links_ = list(range(len(at))), []

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = top(at[x]), top(at[y])
            if a != b and probability_jaccard(held[x], held[y]) >= SIMILAR:
                up[a] = b
                links_.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in links_], pa.int64()) for k in range(2)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting, held = None, {}
        for batch in batches:
            places = batch.column(1).to_numpy()
            heads = np.flatnonzero(places < 0).tolist()
            for first, after in zip([0, *heads], [*heads, len(places)], strict=True):
                if first < after and places[first] < 0:
                    if meeting:
                        yield judged(meeting, held)
                    meeting, held = [batch.column(k)[first].values.to_numpy() for k in range(3, 7)], {}
                    first += 1
                held.update(zip(places[first:after].tolist(), elements(batch.column(2).slice(first, after - first)), strict=True))
        if meeting:
            yield judged(meeting, held)

    return rows.repartition("meet").sortWithinPartitions("meet", "place").mapInArrow(run, "a bigint, b bigint")


def linked(live: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame | None:
    """node, root of the nodes that are linked to another; None without links."""
    sketch = stored(sketches(texts), "sketches")
    known = stored(sketch.join(nodes.select(F.col("node").alias("k_node"), "bands"), F.col("node") == F.col("k_node")).drop("k_node"), "known")
    # The smallest node of each of a bucket's slots is a pivot, so buckets that overlap share pivots.
    pivots = live.groupBy(F.col("bucket").alias("p_bucket"), F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("slot")).agg(F.min("node").alias("pivot"))
    pivots = stored(pivots.drop("slot"), "pivots", narrow=True)
    beside = live.join(pivots, live["bucket"] == pivots["p_bucket"]).where("node <> pivot")
    pairs = beside.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    close = stored(likely(_both(pairs, sketch, "sketch")), "pivot-pairs", narrow=True)
    found = [links(close, texts, "pivot")]
    roots = None if found[0].isEmpty() else components(found[0])
    members = live if roots is None else live.join(roots.select(F.col("node").alias("r_node"), "root"), live["node"] == F.col("r_node"), "left")
    members = members.select("bucket", "node", F.coalesce("root", "node").alias("root")) if roots is not None else members.withColumn("root", F.col("node"))
    met = meetings(stored(members, "members", narrow=True), known)
    more = stored(uniting(met, texts), "class-links", narrow=True)
    if not more.isEmpty():
        roots = components(_union([*found, more]))
    return roots


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, key, same_rows (rows with the same id and text), class_id, class_size, kept of every row.

    ``class_id`` is the smallest id of a class; ``kept`` marks one row of each class.
    """
    rows = stored(signatures(docs).withColumn("row", F.monotonically_increasing_id()), "signatures")
    groups = stored(rows.groupBy("same").agg(F.min("row").alias("node")), "same-words", narrow=True)
    leaders = groups.select(F.col("node").alias("l_node"))
    nodes = rows.join(leaders, rows["row"] == leaders["l_node"], "left_semi").withColumnRenamed("row", "node")
    nodes = stored(nodes.select("node", "doc_id", "key", "bands"), "texts")
    member = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select(F.col("bucket").alias("s_bucket"))
    # Stored, so that the join starts from scans and its hot keys can be split.
    shared = stored(shared, "shared-buckets", narrow=True)
    live = stored(member.join(shared, member["bucket"] == shared["s_bucket"], "left_semi"), "buckets", narrow=True)
    roots = linked(live, nodes, _texts_of(nodes, live, docs))
    if roots is None:
        roots = nodes.select("node", F.col("node").alias("root")).limit(0)
    # Rows to texts to classes; nodes without link are their own root.
    own = rows.select("row", "doc_id", "key", "same")
    own = own.join(groups.select(F.col("same").alias("g_same"), "node"), own["same"] == F.col("g_same")).drop("same", "g_same")
    labels = roots.select(F.col("node").alias("r_node"), "root")
    own = stored(own.join(labels, own["node"] == labels["r_node"], "left").select("row", "doc_id", "key", F.coalesce("root", "node").alias("root")), "rows-classes", narrow=True)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    found = own.groupBy(F.col("root").alias("c_root")).agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min_by("row", order).alias("keep_row"))
    found = stored(found, "classes", narrow=True)
    return own.join(found, own["root"] == found["c_root"]).select(
        "doc_id", "key", "class_id", "class_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, kept of every row."""
    return classes(docs).drop("key")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each class, with all its columns."""
    found = stored(classes(docs).select("doc_id", "key", "kept"), "near-kept", narrow=True)
    kept = found.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"))
    gone = found.where("not kept")
    keyed = docs.select(
        F.struct("*").alias("x_row"), F.col("doc_id").alias("x_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("x_key")
    )
    left = keyed.join(kept, keyed["x_id"].eqNullSafe(kept["kept_id"]) & (keyed["x_key"] == kept["kept_key"]), "left_semi")
    repeated = gone.join(kept, gone["doc_id"].eqNullSafe(kept["kept_id"]) & (gone["key"] == kept["kept_key"]), "left_semi")
    if not repeated.isEmpty():
        left = left.dropDuplicates(["x_id", "x_key"])
    return left.select("x_row.*")
