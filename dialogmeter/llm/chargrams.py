"""Hashed character n-grams of whole texts, and the bounded labelled samples that models are fitted on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogmeter.llm.store import ship
from dialogmeter.llm.textbuf import mix64

#: Letters hashed at a time; a longer text goes through in pieces that overlap by the longest n-gram.
PIECE = 1 << 18
#: Rows whose results are held at a time.
ROWS = 200
_STEP = np.uint64(0x100000001B3)


def grams(text: str | None, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram numbers below 2**bits, their counts) of the lower-cased text with a blank at either end."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = f" {text.lower()} "
    if len(text) <= PIECE:
        return np.unique(np.concatenate(_hashes(text, sizes, bits)), return_counts=True)
    total = np.zeros(1 << bits, np.int64)
    longest = max(sizes)
    for at in range(0, len(text), PIECE):
        for n, h in zip(sizes, _hashes(text[at : at + PIECE + longest - 1], sizes, bits), strict=True):
            h = h[: max(0, min(PIECE, len(text) - at - n + 1))]
            total += np.bincount(h, minlength=1 << bits)
    found = np.flatnonzero(total)
    return found, total[found]


def _hashes(text: str, sizes: tuple[int, ...], bits: int) -> list[np.ndarray]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes[(codes >= 9) & (codes <= 13)] = 32
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(sizes) + 1):
        if len(codes) < n:
            out += [np.zeros(0, np.int64)] * (n in sizes)
            continue
        h = (h[: len(codes) - n + 1] * _STEP) + codes[n - 1 :] + np.uint64(1)
        if n in sizes:
            out.append((mix64(h + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64))
    return out


def in_fold(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether a row is held out: crc32 of its id as text, modulo ``folds``. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def bounded_sample(ids: DataFrame, id_col: str, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` rows of ``ids``, those whose hashed id is smallest, so the choice is the same in every run."""
    order = F.xxhash64(F.col(id_col), F.lit(seed))
    return ids.orderBy(order, F.col(id_col)).limit(rows)


def map_texts(df: DataFrame, schema: T.StructType, each: Callable[[str | None], tuple], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, followed by what ``each`` returns for its ``text``."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [ARROW[f.dataType.simpleString()] for f in schema.fields[len(keep) :]]
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                rows = [each(t.as_py()) for t in part.column(0)]
                made = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names)

    ship(df.sparkSession)
    return df.select("text", *keep).mapInArrow(run, schema)


ARROW = {
    "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32()), "array<bigint>": pa.list_(pa.int64()),
    "binary": pa.binary(),
}
