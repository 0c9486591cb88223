"""Operator 5: license scans by patience alignment with known texts.

Words that occur once in the template and once in the stretch of text are anchors; the longest
increasing subsequence of their places fixes the frame, and the gaps between are aligned in the
same way, after common beginnings and ends. Coverage is the share of the template's words that
the alignment matches in a compact stretch.

A license counts only if the words that tell it from others (``license_texts.NAMES``) are matched
in a row. Where different licenses match the same words, the one that matches most is reported.

A text can cover a template only if it holds one of its longest words, as many of which are
tried as could be missing, and one more. Texts are scanned whole, in overlapping windows that
hold every stretch which may count; where words repeat in a window, as in copies back to back,
stretches that start where a probe word places the template are aligned too.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scanhouse.llm.common import table
from scanhouse.llm.license_texts import NAMES, SHORT, whole_texts

MIN_COVERAGE = 0.8

# Short public license texts and notices.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "MIT notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version.""",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}

WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


# --- alignment ------------------------------------------------------------------------


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience sorting with back links)."""
    tops, at, back = [], [], []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of two word lists, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        frame = [anchors[i] for i in longest_increasing([j for _, j in anchors])]
        if frame:
            out += frame
            for (i0, j0), (i1, j1) in zip([(a0 - 1, b0 - 1), *frame], [*frame, (a1, b1)], strict=True):
                todo.append((i0 + 1, i1, j0 + 1, j1))
    return sorted(out)


#: After a version that goes on, or a name that does, another license is meant.
GOES_ON = re.compile(r"(?:\.0)*\.[1-9]|-(?!only|or\b)[^\W_]")
#: Words that tell licenses apart, beside those of the templates: none of them is an unreadable word of a name.
TELLING = frozenset("lesser library affero free documentation european union v1 v2 v3 one two three ii iii".split())


class Template:
    def __init__(self, name: str, text: str, min_coverage: float, phrases: list[str] | None = None, known: frozenset[str] = TELLING):
        self.known = known  # words that are readable
        self.name, self.words, self.min_coverage = name, words_of(text), min_coverage
        n = Counter(self.words)
        self.least = math.ceil(min_coverage * len(self.words))  # words to match
        self.most = int(1.5 * len(self.words)) + 2  # matched words lie compactly: half as long again as the template
        spare, probes = len(self.words) - self.least, []
        for w in sorted(n, key=lambda w: (-len(w), w)):  # so many words can't all be missing
            probes.append(w)
            spare -= n[w]
            if spare < 0:
                break
        self.counts, self.probes = n, frozenset(probes)
        self.single = [w for w, k in n.items() if k == 1]
        self.places = {w: [i for i, x in enumerate(self.words) if x == w] for w in probes}
        self.phrases = [[at for alternative in p.split("|") for at in self.phrase(alternative.split())] for p in phrases or []]
        held = [[{self.words[i + k] for k, free in enumerate(loose) if not free} for i, loose in places] for places in self.phrases]
        self.must = frozenset(w for sets in held if sets for w in set.intersection(*sets))  # no text counts without these

    def phrase(self, words: list[str]) -> list[tuple[int, list[bool]]]:
        """Places of a phrase in the template, and which of its words may be unreadable."""
        plain, k = [w.rstrip("?") for w in words], len(words)
        return [(i, [w.endswith("?") for w in words]) for i in range(len(self.words) - k + 1) if self.words[i : i + k] == plain]

    def named(self, pairs: list[tuple[int, int]], words: list[str], goes_on) -> bool:
        at = dict(pairs)

        def held(i: int, loose: list[bool]) -> bool:
            start = next((at[i + k] - k for k in range(len(loose)) if i + k in at), -1)
            stop = start + len(loose)
            lost = [k for k in range(len(loose)) if at.get(i + k) != start + k]
            if start < 0 or stop > len(words) or len(lost) > max(1, len(loose) // 5) or goes_on(stop - 1):
                return False
            return all(loose[k] and i + k not in at and not readable(words[start + k]) for k in lost)

        def readable(w: str) -> bool:
            return w in self.known or any(c.isdigit() for c in w)

        return all(any(held(*p) for p in places) for places in self.phrases)

    def enough(self, words: list[str]) -> Counter | None:
        here = Counter(w for w in words if w in self.counts)
        return here if self.must <= here.keys() and sum(min(k, self.counts[w]) for w, k in here.items()) >= self.least else None

    def best(self, words: list[str], goes_on) -> tuple[float, list[int]] | None:
        """Coverage of the template and places of its words in a window, or None below the threshold or
        without its name. ``goes_on``: whether the name's last word, at a place, is continued."""
        pairs = patience(self.words, words)
        if len(pairs) < self.least:
            return None
        most, span, lo = 0, None, 0
        for hi in range(len(pairs)):
            while pairs[hi][1] - pairs[lo][1] >= self.most:
                lo += 1
            if hi - lo + 1 > most:
                most, span = hi - lo + 1, (lo, hi + 1)
        found = pairs[slice(*span)]
        if most < self.least or not self.named(found, words, goes_on):
            return None
        return most / len(self.words), [j for _, j in found]

    def find(self, words: list[str], goes_on) -> list[tuple[float, list[int]]]:
        """Coverage and places of each license in a text, in order of place, without overlaps."""
        n, found, tried = len(self.words), [], set()

        def align(lo: int, hi: int) -> float:
            lo, hi = max(0, lo), min(hi, len(words))
            if (lo, hi) in tried:
                return 0.0
            tried.add((lo, hi))
            some = self.enough(words[lo:hi]) and self.best(words[lo:hi], lambda j: goes_on(lo + j))
            if some:
                found.append((some[0], [lo + j for j in some[1]]))
            return some[0] if some else 0.0

        near = [i for i, w in enumerate(words) if w in self.probes]
        step = max(1, n // 8)
        for k in sorted({k for i in near for k in range(max(0, i - self.most + 1) // n, i // n + 1)}):
            lo, hi = k * n, min(k * n + n + self.most, len(words))
            here = self.enough(words[lo:hi])
            if not here:
                continue
            align(lo, hi)
            if 10 * sum(here[w] > 1 for w in self.single) < len(self.single):
                continue  # nearly all anchors are left
            inside = near[bisect_left(near, lo) : bisect_left(near, hi)]
            for start in sorted({(i - q) // step * step for i in inside for q in self.places[words[i]]}):
                if align(start, start + n + step - 1) < 1:
                    for s in range(start - (n // 2 + 2) // step * step, start + n - self.least + 1, step):
                        for long in (n, n + n // 4, self.most):
                            align(s, s + long + step - 1)
        taken: dict[int, tuple[float, list[int]]] = {}
        firsts: list[int] = []
        for c, at in sorted(found, key=lambda f: (-f[0], f[1][-1] - f[1][0], f[1][0])):
            k = bisect_left(firsts, at[0])
            if (k == len(firsts) or firsts[k] > at[-1]) and (k == 0 or taken[firsts[k - 1]][1][-1] < at[0]):
                firsts.insert(k, at[0])
                taken[at[0]] = (c, at)
        return list(taken.values())


def most_matched(found: list[tuple[Template, float, list[int]]]) -> list[tuple[Template, float, list[int]]]:
    """Without those that share half of their words with another license that matches more."""
    out: list[tuple[Template, float, list[int]]] = []
    holders: dict[int, list[tuple[str, int]]] = {}  # by place of a word
    for t, c, at in sorted(found, key=lambda f: (-len(f[2]), -f[1], f[0].name)):
        license = t.name.split()[0]
        shared = Counter(h for j in at for h in holders.get(j, []) if h[0] != license)
        if all(2 * k < len(at) for k in shared.values()):
            for j in at:
                holders.setdefault(j, []).append((license, len(out)))
            out.append((t, c, at))
    return out


class Templates:
    def __init__(self, texts: dict[str, str], names: dict[str, list[str]], min_coverage: float):
        self.by_probe: dict[str, list[Template]] = {}
        known = TELLING.union(*map(words_of, texts.values()))
        for name, text in texts.items():
            t = Template(name, text, min_coverage, names.get(name), known)
            for w in t.probes:
                self.by_probe.setdefault(w, []).append(t)
        self.probes = frozenset(self.by_probe)


def scan(text: str, templates: Templates) -> list[tuple[str, float, int, int]]:
    """``(license, coverage, start, stop)`` of each license in a text, in code points, without overlaps
    of one template; of stretches that overlap the best coverage counts, then the shortest."""
    low = text.lower()
    words = WORD.findall(low)
    if templates.probes.isdisjoint(words):
        return []
    held, spans = Counter(words), []

    def goes_on(i: int) -> bool:
        return GOES_ON.match(low, spans[i][1]) is not None

    found = []
    for t in {t.name: t for w in templates.probes.intersection(held) for t in templates.by_probe[w]}.values():
        if len(words) >= t.least and t.must <= held.keys() and sum(min(k, held[w]) for w, k in t.counts.items() if w in held) >= t.least:
            spans = spans or [m.span() for m in WORD.finditer(low)]
            found += [(t, c, at) for c, at in t.find(words, goes_on)]
    out = [(t.name, c, spans[at[0]][0], spans[at[-1]][1]) for t, c, at in most_matched(found)]
    return sorted(out, key=lambda f: (f[2], -f[1], f[0]))




# --- query ----------------------------------------------------------------------------

FOUND = "licenses array<struct<license string, coverage double, start bigint, stop bigint>>"
FOUND_ARROW = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())]))


def scan_kernel(texts: dict[str, str], phrases: dict[str, list[str]], min_coverage: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(texts, phrases, min_coverage)
        names = ["license", "coverage", "start", "stop"]
        for batch in batches:
            found = [[dict(zip(names, f, strict=True)) for f in scan(t.as_py() or "", templates)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, FOUND_ARROW)], names=["doc_id", "licenses"])

    return rows


def all_templates() -> dict[str, str]:
    return TEMPLATES | SHORT | whole_texts()


def license_scan(
    docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE, names: dict[str, list[str]] | None = None
) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, licenses (license, coverage, start,
    stop in code points of the lower-cased text, in order of place).

    A NULL or empty text, or one without a license, has an empty list. Repeated rows and NULL
    ids are scanned like others; other columns are not read. Templates are a small table that
    travels with the tasks; ``names`` has the phrases that a found text must hold, for templates
    that need them (see ``license_texts.NAMES``, which goes with the templates of the query).
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    if templates is None:
        templates, names = all_templates(), NAMES if names is None else names
    kernel = scan_kernel(templates, names or {}, min_coverage)
    return docs.select("doc_id", "text").mapInArrow(kernel, f"doc_id {id_type}, {FOUND}")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
