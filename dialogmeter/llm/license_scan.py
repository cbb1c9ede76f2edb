"""Operator 8: licence notices by a trained paragraph classifier.

Lines are cut into sentences; a sentence's words and word pairs are the features of a sparse
multinomial logistic regression whose classes are licence families and "unknown". It is trained
on variants of each family's notices against sentences of the corpus, and calibrated by one
temperature, so that what looks like neither stays unknown. A prediction counts when the words of
one of the family's notices, in order, are nearly all in the sentence. Neighbouring lines of a
paragraph that may hold a notice wrapped over them are joined and judged the same way, the fewest
lines first; lines without words, such as empty comment lines, end a paragraph.

The unknown class learns from the sentences of at most ``fit_rows`` documents; every sentence of
every text is classified, however long: it goes through in slices cut between lines. A null or empty text has no notice. Other columns don't matter; repeated
rows are scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmeter.llm.chargrams import bounded_sample
from dialogmeter.llm.langid import fit_temperature, train_ftrl
from dialogmeter.llm.store import ship
from dialogmeter.llm.textbuf import NOT_WORD, hash_words, mix64, slices, text_bytes

#: Usual wordings of licence notices, by family.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0", "This project is released under the Apache 2.0 license",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License", "Released under the BSD license", "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0",
        "Content is available under the Creative Commons Attribution license",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Available under the Creative Commons Attribution NonCommercial license",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Text is available under the Creative Commons Attribution ShareAlike License",
    ],
    "cc0": [
        "This work is dedicated to the public domain under CC0 1.0", "Released into the public domain",
        "To the extent possible under law, the author has waived all copyright and related rights to this work",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3", "Licensed under the GPL version 2 or later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 3", "Released under the LGPL license"],
    "mit": [
        "Released under the MIT License", "Licensed under the MIT license", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0",
    ],
    "proprietary": [
        "All rights reserved", "No part of this publication may be reproduced without the prior written permission of the publisher",
        "Unauthorized copying of this file, via any medium, is strictly prohibited",
    ],
}
#: Sentences with the same words that grant nothing.
NOT_NOTICES = (
    "She renewed her driver license at the public office", "The general said that no part of the public was free to copy",
    "He holds a fishing license, version and all", "Permission to enter was granted by the author of the source",
    "All rights and duties were reserved for later", "The Apache helicopter was released in the public domain of the park",
)
FAMILIES = ["", *sorted(NOTICES)]
BITS = 18
#: Probability and share of a notice's words from which a prediction counts.
LEAST_PROBABILITY, LEAST_MATCH = 0.5, 0.8
#: Bytes before and after a cut in a long text in which a wrapped notice can lie.
AROUND = 1 << 14
_LINE = np.zeros(256, bool)
_LINE[10] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 59, 63]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


@dataclass(frozen=True)
class LicenceModel:
    weights: np.ndarray  # features x families
    constants: np.ndarray
    temperature: float


def sentence_features(data: np.ndarray, starts_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, sentence of each feature, first byte, byte after of each sentence) of UTF-8 bytes."""
    words, start, end = hash_words(data, NOT_WORD)
    if not len(words):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    ends = (data == 10).astype(np.int64)
    ends[:-1] |= _STOP[data[:-1]] & _SPACE[data[1:]]
    number = np.cumsum(ends)[start] + np.searchsorted(starts_of_texts, start, "right")
    first = np.flatnonzero(np.diff(number, prepend=number[0] - 1))
    sentence = np.repeat(np.arange(len(first)), np.diff(first, append=len(words)))
    pairs = np.flatnonzero(sentence[1:] == sentence[:-1])
    joint = mix64(words[pairs] * np.uint64(0x9E3779B97F4A7C15) + words[pairs + 1])
    feature = np.concatenate([words, joint]) >> np.uint64(64 - BITS)
    of = np.concatenate([sentence, sentence[pairs]])
    order = np.argsort(of, kind="stable")
    last = np.append(first[1:], len(words)) - 1
    return feature[order].astype(np.int64), of[order], start[first], end[last]


def _row(sentence: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(sentence.encode().replace(b"\n", b" "), np.uint8)
    feature, *_ = sentence_features(np.where(_STOP[data], 32, data).astype(np.uint8), np.zeros(1, np.int64))
    found, counts = np.unique(feature, return_counts=True)
    return found, counts / np.sqrt(max(1, counts.sum()))


def match(sentence: str, family: str) -> float:
    """The largest share of a notice's words that the sentence has in the same order."""
    have = _WORD.findall(sentence.lower())
    best = 0.0
    for notice in NOTICES[family]:
        want = _WORD.findall(notice.lower())
        if len(have) * 2 < len(want):
            continue
        row = [0] * (len(want) + 1)
        for h in have:
            diagonal = 0
            for i, w in enumerate(want, 1):
                diagonal, row[i] = row[i], diagonal + 1 if h == w else max(row[i], row[i - 1])
        best = max(best, row[-1] / len(want))
    return best


def variants(notice: str, others: list[str], rng: random.Random, n: int = 24) -> list[str]:
    """The notice with words dropped, or with words of other sentences around it."""
    words, out = notice.split(), [notice]
    for _ in range(n):
        kept = [w for w in words if len(words) < 4 or rng.random() > 0.12]
        if others and rng.random() < 0.5:
            extra = rng.choice(others).split()
            kept = extra[: rng.randint(0, 4)] + kept + extra[-rng.randint(1, 4) :]
        out.append(" ".join(kept))
    return out


def fit(spark: SparkSession, docs: DataFrame, fit_rows: int = 300, seed: int = 8) -> LicenceModel:
    """Train on the notices and on the sentences of a bounded sample of documents."""
    picked = F.broadcast(bounded_sample(docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id"), "doc_id", fit_rows, seed).distinct())
    lines = docs.select("doc_id", "text").join(picked, "doc_id").select(F.explode(F.split("text", r"\n|(?<=[.!?;])\s")).alias("line"))
    lines = lines.where(F.length("line") > 0)
    # At most 20 sentences a document's worth: fit_rows * 20 lines reach the driver.
    sample = [r.line for r in lines.orderBy(F.xxhash64("line"), "line").limit(fit_rows * 20).collect()]
    rng = random.Random(seed)
    plain = [s for s in sample if max(match(s, f) for f in FAMILIES[1:]) < 0.5]
    rows = [(*_row(s), 0) for s in [*plain, *NOT_NOTICES * 8]]
    for y, family in enumerate(FAMILIES[1:], 1):
        rows += [(*_row(v), y) for notice in NOTICES[family] for v in variants(notice, plain, rng)]
    rng.shuffle(rows)
    check, train = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    weights, constants = train_ftrl(train, len(FAMILIES), 1 << BITS, l1=1e-3)
    logits = np.array([weights[:, g] @ v + constants for g, v, _ in check])
    return LicenceModel(np.ascontiguousarray(weights.T, np.float32), constants.astype(np.float32), fit_temperature(logits, np.array([r[2] for r in check])))


_WANTED = [(frozenset(w), len(set(w)) - int((1 - LEAST_MATCH) * len(w) + 1e-9)) for f in NOTICES for w in (_WORD.findall(n.lower()) for n in NOTICES[f])]
_NOTICE_WORDS = frozenset().union(*(w for w, _ in _WANTED))
#: Lines that a notice can be spread over: each has a word of it.
MOST_LINES = max(len(_WORD.findall(n.lower())) for f in NOTICES for n in NOTICES[f])


def judge(text: str, model: LicenceModel) -> tuple[str, float, float] | None:
    """(family, probability, match) of a text that is a notice."""
    feature, value = _row(text)
    logits = value @ model.weights[feature] + model.constants
    best = int(logits.argmax())
    p = np.exp((logits - logits.max()) / model.temperature)
    if best == 0 or p[best] / p.sum() < LEAST_PROBABILITY:
        return None
    share = match(text, FAMILIES[best])
    return (FAMILIES[best], float(p[best] / p.sum()), share) if share >= LEAST_MATCH else None


def wrapped(part: np.ndarray, bounds: np.ndarray, start: np.ndarray, end: np.ndarray, single: dict[int, str], model: LicenceModel) -> Iterator[tuple[int, int, tuple[str, float, float], str]]:
    """(first unit, last unit, judgement, text) of notices spread over lines; ``single`` has the family of units that are one."""
    lines = np.cumsum(part == 10)
    stops = np.append(_STOP[part[:-1]] & _SPACE[part[1:]], False).cumsum()
    text = np.searchsorted(bounds, start, "right")
    between = lambda sums: sums[start[1:] - 1] - sums[end[:-1] - 1]
    soft = (between(lines) == 1) & (between(stops) == 0) & (text[1:] == text[:-1])
    edge = np.flatnonzero(np.diff(soft.astype(np.int8), prepend=0, append=0))
    for i, j in zip(edge[0::2], edge[1::2], strict=True):  # units i to j
        said = [part[s:e].tobytes().decode(errors="replace") for s, e in zip(start[i : j + 1], end[i : j + 1], strict=True)]
        words = [_NOTICE_WORDS.intersection(_WORD.findall(t.lower())) for t in said]
        if not any(len(w & set().union(*words)) >= least for w, least in _WANTED):
            continue
        used = {(k - i, single[k]) for k in range(i, j + 1) if k in single}
        for n in range(2, min(len(said), MOST_LINES) + 1):
            for k in range(len(said) - n + 1):
                if not words[k] or not words[k + n - 1]:
                    continue
                here = set().union(*words[k : k + n])
                if not any(len(w & here) >= least for w, least in _WANTED):
                    continue
                joined = " ".join(said[k : k + n])
                found = judge(joined, model)
                if found and not any((u, found[0]) in used for u in range(k, k + n)):
                    used.update((u, found[0]) for u in range(k, k + n))
                    yield int(i) + k, int(i) + k + n - 1, found, joined


def notices(column: pa.Array, model: LicenceModel) -> list[list[tuple[str, float, float, str]]]:
    """For each text its confirmed notices as (family, probability, match, sentence)."""
    data, offsets = text_bytes(column)
    out: list[list[tuple[str, float, float, str]]] = [[] for _ in range(len(column))]
    for first, after, at, stop, _ in slices(offsets, data, _LINE):
        part = data[at:stop]
        bounds = np.zeros(1, np.int64)
        if after - first > 1:  # a line end between two texts keeps their words apart
            bounds = offsets[first:after] - at
            part = np.insert(part, bounds[1:], 10)
            bounds = bounds + np.arange(len(bounds))
        feature, sentence, start, end = sentence_features(part, bounds)
        if not len(feature):
            continue
        heads = np.flatnonzero(np.diff(sentence, prepend=-1))
        sizes = np.diff(heads, append=len(feature))
        single: dict[int, str] = {}
        logits = np.add.reduceat(model.weights[feature], heads, 0) / np.sqrt(sizes)[:, None] + model.constants
        for i in np.flatnonzero(logits.argmax(1) > 0):
            z = logits[i] / model.temperature
            p = np.exp(z - z.max())
            best = int(z.argmax())
            probability = float(p[best] / p.sum())
            if probability < LEAST_PROBABILITY:
                continue
            text = part[start[i] : end[i]].tobytes().decode(errors="replace")
            share = match(text, FAMILIES[best])
            if share >= LEAST_MATCH:
                single[int(i)] = FAMILIES[best]
                row = first if after - first == 1 else first + int(np.searchsorted(bounds, start[i], "right")) - 1
                out[row].append((FAMILIES[best], probability, share, text))
        for i, _, found, text in wrapped(part, bounds, start, end, single, model):
            row = first if after - first == 1 else first + int(np.searchsorted(bounds, start[i], "right")) - 1
            out[row].append((*found, text))
        if after - first == 1 and at > offsets[first]:
            # Lines around the cut between two slices of a long text.
            low, high = max(int(offsets[first]), at - AROUND), min(at + AROUND, int(offsets[first + 1]))
            part = data[low:high]
            feature, sentence, start, end = sentence_features(part, np.zeros(1, np.int64))
            if len(feature):
                for i, j, found, text in wrapped(part, np.zeros(1, np.int64), start, end, {}, model):
                    if low + start[i] < at <= low + start[j]:
                        out[first].append((*found, text))
    return out


def scan(spark: SparkSession, docs: DataFrame, fit_rows: int = 300) -> DataFrame:
    """doc_id and ``found``, the list of (family, probability, match, sentence), of every row."""
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(spark, docs, fit_rows))
    kind = pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("match", pa.float64()), ("sentence", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = notices(batch.column(1), shared.value)
            rows = [[dict(zip(("family", "probability", "match", "sentence"), n, strict=True)) for n in r] for r in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found array<struct<family:string,probability:double,match:double,sentence:string>>"
    )


def licences(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, families (sorted, each once), n_notices, score (of the surest notice; 0 without) of every row."""
    return scan(spark, docs).select(
        "doc_id", F.array_sort(F.array_distinct(F.transform("found", lambda n: n["family"]))).alias("families"),
        F.size("found").cast("long").alias("n_notices"),
        F.coalesce(F.array_max(F.transform("found", lambda n: n["probability"])), F.lit(0.0)).alias("score"),
    )
