"""License texts and notices in documents, found by patience alignment.

A stretch of a document is aligned with a license template: words that are unique in both are
anchors, the longest increasing run of them is kept, and the gaps between anchors are aligned the
same way. The aligned words' share of the template, or of the stretch where that has more words, is
the coverage; a stretch counts from a coverage of 0.8 on, for a template of fewer than twelve words
only if all are aligned and none stands between. Words that set a license apart (its version,
NonCommercial, Lesser and the like) must be there if the template has them and not if it does not.
A license inside the longer text of another one is part of that.

Stretches are where the template's words lie close together, so a document of any length is
aligned a few template lengths at a time, and a license that occurs twice is found twice. Null and
empty texts have no licenses. Places count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame, types as T

from .common import map_text

COVERAGE = 0.8
#: A shorter template must be covered wholly: one other word may name another license.
WHOLE_BELOW = 12
#: Notices and short texts of common licenses, by SPDX identifier and part: fixed values.
TEMPLATES = {
    "MIT#notice": "Released under the MIT License.",
    "MIT#line": "Licensed under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
           "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
           "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
           "Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0#notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                  "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0#notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
               "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
                    "conditions and the following disclaimer.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
               "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
           "provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0#notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0#notice": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
                    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
                    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
                    "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                    "promote products derived from this software without specific prior written permission.",
    "CC0-1.0#notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                 "compile, sell, or distribute this software",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
}
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License "
        "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
for _id, _name, _version in [("GPL-2.0", "General", "2"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3")]:
    TEMPLATES[_id] = _GNU.format(_name, _version)
    TEMPLATES[_id + "#notice"] = f"This work is licensed under the GNU {_name} Public License, version {_version}."
for _id, _name in [("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                   ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]:
    TEMPLATES[f"CC-{_id}-4.0#name"] = f"This work is licensed under a Creative Commons {_name} 4.0 International License."
    TEMPLATES[f"CC-{_id}-4.0#notice"] = f"Licensed under CC {_id} 4.0."
TEMPLATES["CC-BY-4.0#line"] = "Licensed under CC BY 4.0."
#: Words that set a license apart from others, besides numbers.
MARKS = frozenset("noncommercial nc non commercial sharealike sa alike noderivatives noderivs nd derivatives lesser library affero documentation "
                  "general public attribution mozilla eclipse apache".split())
_WORD = re.compile(r"[a-z0-9]+")


def _lower(text: str) -> str:
    """A-Z in lower case, nothing else, so that places stay."""
    return text.translate(_CASE)


_CASE = {c: c + 32 for c in range(65, 91)}


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two word lists, in order."""
    out = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if once_b[w] == 1 and once_a[w] == 1}
        anchors = _longest_rise([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if w in place])
        if not anchors:
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1)] + anchors, anchors + [(a1, b1)]):
            gaps.append((i + 1, k, j + 1, m))
    return sorted(out)


def _longest_rise(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, ordered by the first place, whose second places rise."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before[k] = ends[at - 1] if at else -1
        if at == len(tops):
            tops.append(j)
            ends.append(k)
        else:
            tops[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


@dataclass
class Template:
    name: str
    words: list[str]
    #: Aligned words that a stretch needs.
    least: int
    #: More different words than may be missing: one of them is in every text with enough coverage.
    needles: list[str]
    #: Its words that set it apart.
    marks: frozenset[str]

    def fits(self, words: list[str], pairs: list[tuple[int, int]]) -> bool:
        """Whether what sets a license apart is the same in the aligned stretch of ``words``."""
        if not self.marks <= {self.words[j] for _, j in pairs}:
            return False
        inside = words[pairs[0][0]:pairs[-1][0] + 1]
        if any(w in MARKS and w not in self.marks for w in inside):
            return False
        return not any(v.isdigit() and v not in self.marks for u, v in zip(inside, inside[1:]) if u in ("version", "v"))

    def share(self, pairs: list[tuple[int, int]]) -> float:
        return len(pairs) / max(len(self.words), pairs[-1][0] - pairs[0][0] + 1)

    def trimmed(self, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Without aligned words at the ends that stand too far off to raise the share."""
        pairs = pairs[:max(range(1, len(pairs) + 1), key=lambda k: (self.share(pairs[:k]), k))]
        return pairs[max(range(len(pairs)), key=lambda k: (self.share(pairs[k:]), -k)):]

    @classmethod
    def of(cls, name: str, text: str, coverage: float) -> "Template":
        words = _WORD.findall(_lower(text))
        counts = Counter(words)
        least = len(words) if len(words) < WHOLE_BELOW else ceil(coverage * len(words) - 1e-9)
        missing, needles = len(words) - least, []
        for w in sorted(counts, key=lambda w: (-len(w), w)):
            needles.append(w)
            missing -= counts[w]
            if missing < 0:
                break
        return cls(name, words, least, needles, frozenset(w for w in words if w in MARKS or w.isdigit()))


def _stretches(places: list[int], words: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Ranges of words in which the template may lie: runs of its words without a wide gap, long runs in overlapping pieces."""
    size = len(template)
    wide = 3 + size // 4
    runs, a = [], 0
    for k in range(1, len(places) + 1):
        if k == len(places) or places[k] - places[k - 1] > wide:
            runs.append((places[a], places[k - 1] + 1))
            a = k
    out = []
    for a, b in runs:
        if b - a <= 2 * size:
            out.append((a, b))
        else:
            out += [(s, min(b, s + 2 * size)) for s in range(a, b - size, max(1, size // 2))]
    # begin at the template's first word where there is one, so that what stands before does not blur the anchors
    first = template[0]
    return out + [(i, min(b, i + n)) for a, b in runs for i in range(a, b) if words[i] == first for n in (size, size + wide)]


def find(text: str, templates: list[Template]) -> list[tuple[str, int, int, float]]:
    """(license, start, end, coverage) of all stretches that are covered enough, without overlaps for one license."""
    lower = text.lower()
    wanted = [t for t in templates if any(w in lower for w in t.needles)]
    if not wanted:
        return []
    lower = _lower(text)
    spans = [m.span() for m in _WORD.finditer(lower)]
    words = [lower[a:b] for a, b in spans]
    present = set(words)
    found = []
    for t in wanted:
        counts = Counter(t.words)
        if sum(c for w, c in counts.items() if w in present) < t.least:
            continue
        places = [i for i, w in enumerate(words) if w in counts]
        for a, b in _stretches(places, words, t.words):
            if b - a < t.least:
                continue
            pairs = patience(words[a:b], t.words)
            if len(pairs) < t.least:
                continue
            pairs = t.trimmed(pairs)
            share = t.share(pairs)
            if share * len(t.words) >= t.least - 1e-9 and t.fits(words[a:b], pairs):
                found.append((share, spans[a + pairs[0][0]][0], spans[a + pairs[-1][0]][1], t.name.split("#")[0]))
    kept: list[tuple[str, int, int, float]] = []
    for share, start, end, name in sorted(found, key=lambda x: (-(x[2] - x[1]) * x[0], x[1], x[3])):
        if not any(start < b and a < end if name == other else a <= start and end <= b for other, a, b, _ in kept):
            kept.append((name, start, end, share))
    return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


LICENSES = T.StructType([T.StructField("licenses", T.ArrayType(T.StructType([
    T.StructField("license", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("coverage", T.DoubleType())])))])


def find_licenses(df: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, keep: list[str] | None = None) -> DataFrame:
    """``licenses``: license, start, end and coverage of every licensed stretch of each text, by place."""

    def make():
        known = [Template.of(name, t, coverage) for name, t in templates.items()]
        return lambda texts: [[[{"license": n, "start": a, "end": b, "coverage": c} for n, a, b, c in find(t, known)] for t in texts]]

    return map_text(df, text, make, LICENSES, keep)
