"""License scan by patience alignment.

A text window is aligned to a license template like patience diff does: words
that occur once in both are anchors, the longest increasing subsequence of
their places is kept, and the gaps between anchors are aligned the same way.
A gap without anchors is cut in the middle of its text side and the better of
the two halves is taken, of equals the one next to an anchor.
Coverage is the share of the template's words that are matched.

A text of any length is scanned in windows of 2.5 template lengths, one
template length apart, so every place of up to 1.5 template lengths lies whole
in some window. A window is aligned again on both sides of a find. Where it gives
less than the whole template, it is also aligned from each word that the coverage lets a
find start with, 1.5 template lengths on, so that copies side by side, whose words
are unique nowhere in the window, don't hide each other. Windows (and whole
texts) are skipped only where too few words of the template occur to reach
``COVERAGE``, which is exact. An alignment may end in words of the next copy; so
each of its stretches that reaches the coverage by itself is a find as well, and
the disjoint finds that match the most words together stay.

Templates are a parameter; the default ones are short notices and the
customary notice paragraphs of well-known licenses.

Defined cases: null and empty texts have no finds (the document still gets its
row in ``op3`` with an empty list). Repeated rows give repeated results; equal
coverage goes to the earlier place and the first template by name. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdikt.llm.common import arrow_udf, prepare, table, utf8

COVERAGE = 0.8
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")

# The public notice texts of these licenses.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT notice": "Released under the MIT License",
    "MIT permission": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions"
    ),
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
        back.append(ends[k - 1] if k else -1)
    out = []
    i = ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[bytes], a0: int, a1: int, b: list[bytes], b0: int, b1: int, late: bool = False) -> list[tuple[int, int]]:
    """Pairs (place in text a, place in template b) of matched words, both rising.
    ``late``: of equal halves of the text the second is taken (it is next to an anchor)."""
    if a0 >= a1 or b0 >= b1:
        return []
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    if not in_a.keys() & in_b.keys():
        return []
    place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a[w] == 1}
    anchors = [(i, place[a[i]]) for i in range(a0, a1) if a[i] in place]
    if not anchors:
        if a1 - a0 == 1:
            return [(a0, b.index(a[a0], b0, b1))]
        middle = (a0 + a1) // 2
        first, second = align(a, a0, middle, b, b0, b1, late), align(a, middle, a1, b, b0, b1, late)
        return second if len(second) + late > len(first) else first
    kept = [anchors[k] for k in increasing([j for _, j in anchors])]
    out = []
    i0, j0 = a0, b0
    for i, j in [*kept, (a1, b1)]:
        out += align(a, i0, i, b, j0, j, i < a1)
        if i < a1:
            out.append((i, j))
        i0, j0 = i + 1, j + 1
    return out


def densest(pairs: list[tuple[int, int]], span: int) -> list[tuple[int, int]]:
    """The most pairs whose text places lie within ``span`` words."""
    best, low = (0, 0), 0
    for high in range(len(pairs)):
        while pairs[high][0] - pairs[low][0] >= span:
            low += 1
        if high - low + 1 > best[1] - best[0]:
            best = (low, high + 1)
    return pairs[best[0] : best[1]]


def stretches(pairs: list[tuple[int, int]], least: float) -> list[list[tuple[int, int]]]:
    """The alignment, and each stretch of it between places where the text runs
    ahead of the template, that has at least ``least`` pairs: what comes after
    such a place may belong to the next copy."""
    cut = [0, *(k for k in range(1, len(pairs)) if pairs[k][0] - pairs[k - 1][0] > pairs[k][1] - pairs[k - 1][1] + 1), len(pairs)]
    return [pairs[a:b] for x, a in enumerate(cut) for b in cut[x + 1 :] if b - a >= least]


def disjoint(found: list[tuple]) -> list[tuple]:
    """Of (name, start, end, coverage, matches) disjoint finds that match the most
    words together; of equals those that cover the fewest words, then the most
    of their templates, then the first by place and name."""
    found = sorted(found, key=lambda f: (f[2], -f[1], f[0]))
    ends = [f[2] for f in found]
    best: list[tuple] = [(0, 0, 0.0)]  # by the number of finds that may be used
    taken: list[int] = [-1]
    for k, f in enumerate(found):
        before = bisect_right(ends, f[1], 0, k)
        words, length, share = best[before]
        with_f = words + f[4], length - (f[2] - f[1]), share + f[3]
        if with_f > best[k]:
            best.append(with_f)
            taken.append(k)
        else:
            best.append(best[k])
            taken.append(taken[k])
    out = []
    k = taken[-1]
    while k >= 0:
        out.append(found[k])
        k = taken[bisect_right(ends, found[k][1], 0, k)]
    return out[::-1]


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = [(name, words_of(t.encode())) for name, t in sorted(templates.items())]
        self.counts = [Counter(t) for _, t in self.templates]
        self.vocabulary = frozenset(w for c in self.counts for w in c)

    def scan(self, text: bytes | None) -> list[tuple[str, int, int, float]]:
        """(template, first word, end, coverage) of the finds in a text."""
        words = words_of(text)
        present = self.vocabulary.intersection(words)
        if not present:
            return []
        found = []
        for (name, template), count in zip(self.templates, self.counts):
            if sum(n for w, n in count.items() if w in present) >= self.coverage * len(template):
                found += [(name, *f, round(f[2] * len(template))) for f in self.finds(words, template, count)]
        return [f[:4] for f in disjoint(found)]

    def finds(self, words: list[bytes], template: list[bytes], count: Counter) -> list[tuple[int, int, float]]:
        size = len(template)
        width, span, least = -(-5 * size // 2), -(-3 * size // 2), self.coverage * size
        hits = [i for i, w in enumerate(words) if w in count]
        openers = frozenset(template[: size - math.ceil(least) + 1])
        out: set[tuple[int, int, float]] = set()

        def enough(start: int, end: int) -> bool:
            """Can the words there reach the coverage?"""
            own = hits[bisect_left(hits, start) : bisect_left(hits, end)]
            return len(own) >= least and (Counter(words[i] for i in own) & count).total() >= least

        def best(start: int, end: int) -> list[tuple[int, int]]:
            pairs = densest(align(words, start, end, template, 0, size), span)
            if pairs and len(pairs) >= least:
                for p in stretches(pairs, least):
                    out.add((p[0][0], p[-1][0] + 1, len(p) / size))
                return pairs
            return []

        rest = [(s, min(s + width, len(words))) for s in sorted({max(0, h // size - k) * size for h in hits for k in range(3)})]
        while rest:
            start, end = rest.pop()
            if not enough(start, end):
                continue
            pairs = best(start, end)
            if len(pairs) < size:
                # A find starts with one of the words that the coverage lets it start with.
                for h in hits[bisect_left(hits, start) : bisect_left(hits, end)]:
                    if words[h] in openers and enough(h, min(h + span, end)):
                        best(h, min(h + span, end))
            if pairs:
                rest += [(start, pairs[0][0]), (pairs[-1][0] + 1, end)]
        return sorted(out)


FINDS = T.ArrayType(T.StructType().add("license", "string").add("first_word", "long").add("end_word", "long").add("coverage", "double"))


def finds_udf(templates: dict[str, str] | None = None, coverage: float = COVERAGE):
    scanner = Scanner(templates or TEMPLATES, coverage)  # bounded by the template parameter
    kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("coverage", pa.float64())]))
    names = [f.name for f in kind.value_type]

    def finds(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(names, f)) for f in scanner.scan(x)] for x in utf8(texts)], kind)

    return arrow_udf(finds, FINDS)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its finds, and how many words they cover."""
    prepare(spark)
    x = table(spark, sf_dir, "documents").select("doc_id", finds_udf()("text").alias("finds"))
    covered = F.aggregate("finds", F.lit(0).cast("long"), lambda n, f: n + f["end_word"] - f["first_word"])
    return x.select("doc_id", F.to_json("finds").alias("finds"), F.size("finds").alias("n_finds"), covered.alias("covered_words"))
