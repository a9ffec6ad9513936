"""License scan: MinHash bands over overlapping windows of words, then exact containment.

Templates of any length are grouped with those of like length.  For each group, windows of words
slide over the text so that every occurrence of a template, with up to half of its length put in
between, lies whole in one of them.  A band is one minimum over the window's shingles; a window
whose minimum is a template's in any band is a candidate.  The number of bands follows from the
least similarity that a window with 0.8 of a template can have, so that it is missed with
probability MISS at most.  A candidate is verified by the exact share of the template's shingles
that the window holds.  Shingles have five words; a template of fewer words is one shingle.

Words are compared without case and ASCII punctuation.

Defined cases: null and empty texts match nothing, nor do texts shorter than a template's
shingle; a template without words is an error; a text of any length is scanned whole; a template
that occurs several times gives one row with the number of its places; equal texts give equal
rows; rows are scanned one by one, so repeated rows are repeated; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import small_batches, tidy
from .words import hashed_blocks, shingles

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-4
#: How much longer than its shortest template a group's longest may be, and the room for words put in.
LIKE, ROOM = 2.0, 1.5
BLANK = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_TOP = np.uint64(48)


def _odd(n: int) -> np.ndarray:
    """Odd multipliers, one a band."""
    return np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


# Notices and opening passages of public licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-line": "Licensed under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSD-3-Clause-line": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0-sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-sentence": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}


@dataclass(frozen=True)
class Group:
    """Templates of like length: words of a shingle, window stride and length in words, and for each band the minima."""

    shingle: int
    stride: int
    window: int
    names: tuple[str, ...]
    sets: tuple[np.ndarray, ...]
    odd: np.ndarray
    minima: np.ndarray  # bands x templates
    marks: np.ndarray  # bands x 65536: leading bits of the minima


def bands_needed(similarity: float) -> int:
    return max(1, math.ceil(math.log(MISS) / math.log(1 - similarity)))


def _words(text: str) -> np.ndarray:
    return next(hashed_blocks([text], BLANK))[1]


def prepared(templates: Mapping[str, str], containment: float = CONTAINMENT) -> list[Group]:
    words = sorted(((name, _words(text)) for name, text in templates.items()), key=lambda x: len(x[1]))
    if words and not len(words[0][1]):
        raise ValueError(f"template {words[0][0]!r} has no words")
    groups: list[list[tuple[str, np.ndarray]]] = []
    for name, w in words:
        low = len(groups[-1][0][1]) if groups else 0
        like = len(w) <= LIKE * low and min(len(w), SHINGLE) == min(low, SHINGLE)
        groups[-1].append((name, w)) if like else groups.append([(name, w)])
    return [_group(g, containment) for g in groups]


def _group(members: list[tuple[str, np.ndarray]], containment: float) -> Group:
    low, high = len(members[0][1]), len(members[-1][1])
    n = min(low, SHINGLE)
    stride = max(1, (low + 1) // 3)
    window = -(-(math.ceil(high * ROOM) + stride - 1) // stride) * stride
    sets = tuple(np.unique(shingles(w, n)) for _, w in members)
    inside = window - n + 1
    bands = bands_needed(min(containment * len(s) / (inside + (1 - containment) * len(s)) for s in sets))
    odd = _odd(bands)
    minima = np.array([[(s * k).min() for s in sets] for k in odd], np.uint64)
    marks = np.zeros((bands, 1 << 16), bool)
    for k in range(bands):
        marks[k, (minima[k] >> _TOP).astype(np.int64)] = True
    return Group(n, stride, window, tuple(name for name, _ in members), sets, odd, minima, marks)


def _window_minima(h: np.ndarray, g: Group) -> np.ndarray:
    """Minimum of the shingles of each window, one window each stride."""
    n = -(-len(h) // g.stride)
    full = np.full(n * g.stride, np.iinfo(np.uint64).max, np.uint64)
    full[: len(h)] = h
    if g.stride <= 8:
        low = full[0 :: g.stride].copy()
        for k in range(1, g.stride):
            np.minimum(low, full[k :: g.stride], out=low)
    else:
        low = full.reshape(n, g.stride).min(axis=1)
    out = low.copy()
    for k in range(1, min(-(-(g.window - g.shingle + 1) // g.stride), n)):
        np.minimum(out[: n - k], low[k:], out=out[: n - k])
    return out


def _matches(words: np.ndarray, cut: np.ndarray, groups: list[Group], containment: float):
    """(text, template, containment, first word, last word, places) of a block of texts."""
    found: dict[tuple[int, str], list] = {}
    hashed = {n: shingles(words, n) for n in {g.shingle for g in groups} if len(words) >= n}
    products: dict[tuple[int, int], np.ndarray] = {}
    candidates: set[tuple[int, int, int]] = set()
    for k in range(max((len(g.odd) for g in groups), default=0)):
        products.clear()
        for gi, g in enumerate(groups):
            if k >= len(g.odd) or g.shingle not in hashed:
                continue
            key = (g.shingle, int(g.odd[k]))
            if key not in products:
                products[key] = hashed[g.shingle] * g.odd[k]
            m = _window_minima(products[key], g)
            for w in np.flatnonzero(g.marks[k].take((m >> _TOP).astype(np.int64))):
                candidates.update((gi, int(w) * g.stride, int(t)) for t in np.flatnonzero(g.minima[k] == m[w]))
    for gi, start, t in sorted(candidates):
        g = groups[gi]
        span = hashed[g.shingle][start : start + g.window - g.shingle + 1]
        at = np.flatnonzero(np.isin(span, g.sets[t]))
        texts = np.searchsorted(cut, start + at, side="right") - 1
        ends = np.searchsorted(cut, start + at + g.shingle - 1, side="right") - 1
        for text in np.unique(texts):
            mine = at[(texts == text) & (ends == text)]
            share = len(np.unique(span[mine])) / len(g.sets[t])
            if share >= containment:
                found.setdefault((int(text), g.names[t]), []).append((share, start + int(mine[0]), start + int(mine[-1]) + g.shingle))
    for (text, name), spans in sorted(found.items()):
        places, reach = 0, -1
        for _, a, b in sorted(spans, key=lambda x: x[1]):
            places += a >= reach
            reach = max(reach, b)
        share, a, b = max(spans, key=lambda x: (x[0], -x[1]))
        yield text, name, share, a - int(cut[text]), b - int(cut[text]), places


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, first_word, end_word, places) of every template in every text."""
    small_batches(docs.sparkSession)
    groups = prepared(templates, containment)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for first, words, cut in hashed_blocks(batch.column(1).to_pylist(), BLANK):
                rows += [(first + text, *rest) for text, *rest in _matches(words, cut, groups, containment)]
            cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], [], [], []]
            ids = batch.column(0).take(pa.array(cols[0], pa.int64()))
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True)]], names=["doc_id", "license", "containment", "first_word", "end_word", "places"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, license string, containment double, first_word long, end_word long, places long")
