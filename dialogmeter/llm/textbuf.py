"""Vectorised word hashes over the UTF-8 buffers of Arrow text columns.

Texts are handled in slices of at most ``SLICE`` bytes, cut at a word boundary, so the working
arrays stay small whatever a batch or a single text holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
#: Texts of a slice at most.
ROWS = 1 << 15
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = []

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything but ASCII letters, digits and the bytes of other characters.
NOT_WORD = np.ones(256, bool)
NOT_WORD[48:58] = NOT_WORD[65:91] = NOT_WORD[97:123] = NOT_WORD[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null text is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        forward, back = np.full(size, _P, np.uint64), np.full(size, _P_INVERSE, np.uint64)
        forward[0] = back[0] = 1
        _powers[:] = [np.cumprod(forward), np.cumprod(back)]
    return _powers[0], _powers[1]


def hash_words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after) of each word of ``data``, ASCII letters lower-cased."""
    outside = breaks[data]
    edge = np.flatnonzero(np.diff(outside.view(np.int8), prepend=1, append=1))
    start, end = edge[0::2], edge[1::2]
    forward, back = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data].astype(np.uint64) * forward[: len(data)] + forward[: len(data)], out=sums[1:])
    return mix64((sums[end] - sums[start]) * back[start]), start, end


def _cut(data: np.ndarray, at: int, stop: int, breaks: np.ndarray) -> int:
    """Where the slice beginning at ``at`` ends: before a word, unless one word is longer than a slice."""
    end = min(at + SLICE, stop)
    if end == stop:
        return stop
    free = np.flatnonzero(breaks[data[at:end]])
    if len(free):
        return at + int(free[-1]) + 1
    ahead = end
    while ahead < stop:
        free = np.flatnonzero(breaks[data[ahead : ahead + SLICE]])
        if len(free):
            return ahead + int(free[0]) + 1
        ahead += SLICE
    return stop


def slices(offsets: np.ndarray, data: np.ndarray, breaks: np.ndarray) -> Iterator[tuple[int, int, int, int, bool]]:
    """(first text, text after, first byte, byte after, last of its text) of consecutive slices.

    Short texts share a slice; a text longer than a slice is cut before words.
    """
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1
        if stop > row:
            stop = min(stop, n, row + ROWS)
            yield row, stop, int(offsets[row]), int(offsets[stop]), True
            row = stop
            continue
        at = int(offsets[row])
        while at < offsets[row + 1]:
            end = _cut(data, at, int(offsets[row + 1]), breaks)
            yield row, row + 1, at, end, end == offsets[row + 1]
            at = end
        row += 1


def words_by_text(column: pa.Array, breaks: np.ndarray = WHITESPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, word count of each text) for runs of consecutive texts, each text whole."""
    data, offsets = text_bytes(column)
    held: list[np.ndarray] = []
    for first, after, at, end, last in slices(offsets, data, breaks):
        part = data[at:end]
        if after - first == 1:
            held.append(hash_words(part, breaks)[0])
            if last:
                words = np.concatenate(held)
                held = []
                yield first, words, np.array([len(words)])
            continue
        # A break between two texts keeps the last word of one from joining the first of the next.
        bounds = offsets[first : after + 1] - at
        gaps = np.insert(part, bounds[1:-1], 32)
        words, start, _ = hash_words(gaps, breaks)
        shifted = bounds + np.arange(len(bounds))
        shifted[-1] = len(gaps)
        counts = np.diff(np.searchsorted(start, shifted))
        yield first, words, counts
