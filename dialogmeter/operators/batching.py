"""Texts put together for the calls of a learned model."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd

from dialogmeter.session import send_with_jobs

send_with_jobs(__name__)


@dataclass(frozen=True)
class Batching:
    """What one call of a model may hold.

    A model pads the texts of a call to the longest one, so texts of about equal length go
    together: ``rows`` texts at most, and ``padded`` characters when each counts as long as the
    longest; a longer text is a call of its own. ``window`` characters are held at a time to find
    texts of equal length among them.
    """

    rows: int = 64
    padded: int = 1 << 16
    window: int = 1 << 23


def calls(lengths: Sequence[int], batching: Batching) -> list[list[int]]:
    """Positions of the texts of each call, shortest texts first."""
    out: list[list[int]] = []
    for at in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        call = out[-1] if out else None
        if call is None or len(call) == batching.rows or (len(call) + 1) * lengths[at] > batching.padded:
            out.append([at])
        else:
            call.append(at)
    return out


def windows(batches: Iterable[tuple[pd.Series, pd.Series]], most: int) -> Iterator[list[tuple[pd.Series, pd.Series]]]:
    """Runs of Arrow batches that hold about ``most`` characters together, one batch at least."""
    held, size = [], 0
    for cands, variants in batches:
        held.append((cands, variants))
        size += int(cands.str.len().fillna(0).sum())
        size += sum(len(r) for lists in variants for refs in lists if refs is not None for r in refs if r is not None)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def scored(batches: Sequence[tuple[pd.Series, pd.Series]], model, batching: Batching) -> Iterator[pd.Series]:
    """For each batch the scores of its rows: one per list of references, null where a text is missing."""
    jobs, out = [], []
    for at, (cands, variants) in enumerate(batches):
        out.append([[None] * len(lists) for lists in variants])
        for row, (cand, lists) in enumerate(zip(cands, variants, strict=True)):
            for slot, refs in enumerate(lists):
                present = [] if refs is None else [r for r in refs if r is not None]
                if cand is not None and present:
                    jobs.append((at, row, slot, cand, present))
    lengths = [max(len(cand), *map(len, refs)) for _, _, _, cand, refs in jobs]
    for call in calls(lengths, batching):
        values = model([jobs[i][3] for i in call], [jobs[i][4] for i in call])
        for i, value in zip(call, values, strict=True):
            at, row, slot = jobs[i][:3]
            out[at][row][slot] = float(value)
    for rows in out:
        yield pd.Series(rows, dtype=object)
