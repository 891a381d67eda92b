"""License scans by patience alignment of a text's windows with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import text_batches

# Public license texts and notices; words only count, punctuation and case do not.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    "BSD line": "Use of this source code is governed by a BSD-style license",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "GPL-2.0 notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or (at
        your option) any later version.""",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0 notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT line": "Released under the MIT License",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    "MPL-2.0 notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}

# Words that say nothing about a license.
PLAIN = set("a above all an and any appear are as at be by can code copies copy files following for form forms free from if in into is it list may met not of one or other person persons provided purpose see shall so source subject that the this to use used was whom with without work you your".split())

COVERAGE = 0.8
#: Words that may be put in between two telling words of one copy: a part of the template's length, and at least so many.
INSERTED, LEAST_INSERTED = 0.5, 8

_word = re.compile(r"\w+(?:[.-]\w+)*")


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-case words and where each stands."""
    found = [(m.group().lower(), m.span()) for m in _word.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matching positions of two lists of words by patience alignment.

    Equal heads and tails match; words that occur once on both sides are anchors, of which a longest increasing
    sequence stays; every gap between anchors is aligned in the same way.
    """
    out: list[tuple[int, int]] = []
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        i, m, j, n = open_.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        ours, theirs = _once(a, i, m), _once(b, j, n)
        anchors = [(x, theirs[w]) for w, x in ours.items() if w in theirs]
        anchors = [anchors[k] for k in increasing([y for _, y in anchors])]
        if not anchors:
            continue
        x, y = i, j
        for p, q in [*anchors, (m, n)]:
            open_.append((x, p, y, q))
            if p < m:
                out.append((p, q))
            x, y = p + 1, q + 1
    return sorted(out)


def _once(items: list[str], start: int, stop: int) -> dict[str, int]:
    """Words that occur once in a stretch, in order, with their positions."""
    found: dict[str, int] = {}
    for k in range(start, stop):
        found[items[k]] = -1 if items[k] in found else k
    return {w: k for w, k in found.items() if k >= 0}


class Scanner:
    """Templates prepared for the search of windows."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.lists = {name: words(text)[0] for name, text in templates.items()}
        self.counts = {name: Counter(items) for name, items in self.lists.items()}
        self.places: dict[str, list[tuple[str, int]]] = {}
        for name, items in self.lists.items():
            telling = [k for k, w in enumerate(items) if w not in PLAIN]
            if len(items) - len(telling) >= coverage * len(items):
                raise ValueError(f"{name}: too few telling words to reach the coverage only with one of them")
            for k in telling:
                self.places.setdefault(items[k], []).append((name, k))
        self.parts = {p for w in self.places for p in re.split(r"[.-]", w)}

    def __call__(self, text: str) -> list[dict]:
        """License, coverage of its template, and span in code points, by start and license."""
        if self.parts.isdisjoint(re.split(r"[\W_]+", text.lower())):
            return []
        items, spans = words(text)
        starts: dict[str, list[int]] = {}
        hits: dict[str, list[int]] = {}
        for at, w in enumerate(items):
            for name, k in self.places.get(w, ()):
                starts.setdefault(name, []).append(at - k)
                hits.setdefault(name, []).append(at)
        out = []
        for name, found in starts.items():
            size = len(self.lists[name])
            slack = max(1, size // 8)
            close = [(first - slack, last + size + slack) for first, last in _clusters(sorted(set(found)), slack)]
            whole = list(self._aligned(name, items, close))
            spread = _spreads(hits[name], size, [(a, b) for a, b, _ in whole])
            whole += self._aligned(name, items, spread)
            out += [(spans[a][0], spans[b - 1][1], name, n / size, n) for a, b, n in whole]
        return _best(out)

    def _aligned(self, name: str, items: list[str], windows: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """Places and matched words of the template in windows of words, where the coverage suffices."""
        template = self.lists[name]
        least = self.coverage * len(template)
        for low, high in windows:
            window = items[max(0, low) : high]
            common = self.counts[name] & Counter(window)
            if common.total() >= least and len(matched := align(template, window)) >= least:
                first = max(0, low)
                yield first + matched[0][1], first + matched[-1][1] + 1, len(matched)


def _clusters(starts: list[int], slack: int) -> Iterator[tuple[int, int]]:
    """Runs of possible starts of which each is within ``slack`` of the one before, no run longer than twice that."""
    first = last = starts[0]
    for s in starts[1:]:
        if s - last > slack or s - first > 2 * slack:
            yield first, last
            first = s
        last = s
    yield first, last


def _spreads(hits: list[int], size: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Windows for copies with words put in: stretches of telling words, each at most ``INSERTED`` of the template's
    length (or ``LEAST_INSERTED`` words) behind the one before, outside what is found.

    A stretch longer than twice the template is walked in windows of three lengths, a length apart.
    """
    ends = sorted(taken)
    gap = max(LEAST_INSERTED, int(size * INSERTED))
    run: list[int] = []
    k = 0
    for at in [*hits, None]:
        while at is not None and k < len(ends) and ends[k][1] <= at:
            k += 1
        if at is not None and k < len(ends) and ends[k][0] <= at:
            continue
        if run and (at is None or at - run[-1] > gap):
            # A window does not reach into what is found: its words would no longer be unique.
            low = max(run[0] - size, max((e for _, e in ends[max(0, k - 2) : k] if e <= run[0]), default=0))
            high = min(run[-1] + size, min((s for s, _ in ends[max(0, k - 2) : k + 1] if s > run[-1]), default=run[-1] + size))
            yield from ((i, min(high, i + 3 * size + gap)) for i in range(low, max(low + 1, high - 2 * size), size))
            run = []
        if at is not None and (not run or run[-1] != at):
            run.append(at)


def _best(found: list[tuple[int, int, str, float, int]]) -> list[dict]:
    """Of overlapping spans that of the most matched words stays, the shortest of equals."""
    out: list[tuple[int, int, str, float, int]] = []
    for x in sorted(set(found), key=lambda x: (-x[4], x[1] - x[0], x[2], x[0])):
        # What stays does not overlap, so that only the neighbours of a place can.
        k = bisect_left(out, x)
        if (not k or out[k - 1][1] <= x[0]) and (k == len(out) or x[1] <= out[k][0]):
            out.insert(k, x)
    return [{"license": n, "coverage": c, "start": a, "end": b} for a, b, n, c, _ in out]


SPAN = "struct<license:string,coverage:double,start:int,end:int>"
_SPANS = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(df: DataFrame, *, text: str = "text", out: str = "licenses", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``df`` without its text, with the licenses whose template the text covers to at least ``coverage``.

    Null and empty texts have none; equal texts have equal ones; every row and all other columns stay (one of the
    output's name is replaced). Where spans overlap, that of the most matched words stays. A text is searched whole: windows
    open wherever a telling word of a template stands, and each is aligned with the template; then longer windows over
    what is left, for copies with words put in. The work grows with the text's length and the hits, not their square.
    """
    kept = [c for c in df.columns if c not in (text, out)]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema]
    chosen = TEMPLATES if templates is None else templates

    def run(batches):
        scanner = Scanner(chosen, coverage)
        for batch, texts in text_batches(batches, text):
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array([scanner(t) for t in texts], _SPANS)], names=[*kept, out])

    return df.select(*kept, text).mapInArrow(run, ", ".join([*fields, f"`{out}` array<{SPAN}>"]))
