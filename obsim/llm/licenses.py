"""License scans: winnowed fingerprints find candidates, banded alignment measures them.

Templates are winnowed into an inverted index (fingerprint -> template, place), small and fixed by the template list, so
every task holds it. A text's own winnowed fingerprints look up candidates and their diagonals; around each, a banded
alignment of words gives the template words matched and the span in the text. Texts stay where they are read: no shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shingles import WordCodes, windows

# Words of a fingerprint, and how many neighbouring fingerprints winnowing chooses one from: equal runs of
# GRAM + WINDOW - 1 words share one.
GRAM = 3
WINDOW = 2
# Share of a template's words that must be matched.
COVERAGE = 0.8
# Words that an alignment may drift from its diagonal.
BAND = 6

# Notices that name a license, and opening or central passages of common licenses.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "MIT (notice)": "Released under the MIT License",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "GPL-3.0 (notice)": "licensed under the GNU General Public License, version 3",
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 (notice)": "licensed under a Creative Commons Attribution 4.0 International License",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version."
    ),
}
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


class Plain(WordCodes):
    """Codes of words without case and outer punctuation."""

    def __missing__(self, word: str) -> int:
        code = self[word] = super().__missing__(_EDGE.sub("", word).lower() or word)
        return code


def winnow(codes: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen fingerprints and their places: the smallest of every ``window`` neighbours, the last among equals."""
    prints = windows(codes, gram)
    if len(prints) <= window:
        at = np.arange(len(prints)) if len(prints) < window else np.array([len(prints) - 1 - int(np.argmin(prints[::-1]))])
        return prints[at], at
    view = np.lib.stride_tricks.sliding_window_view(prints, window)[:, ::-1]
    at = np.unique(np.arange(len(view)) + window - 1 - view.argmin(axis=1))
    return prints[at], at


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """``(matched, start, end)``: most template words matched in order, within ``band`` of the diagonal.

    The diagonal is place in the text minus place in the template; the span runs from the first to the last match.
    """
    best: dict[int, tuple[int, int, int]] = {}  # shift -> (matched, -first, last) of the best path that stands there
    shifts = range(-band, band + 1)
    for i, code in enumerate(template):
        fresh: dict[int, tuple[int, int, int]] = {}
        # From the least place on, so that a skipped text word carries a path to the next shift.
        for s in shifts:
            at = i + diagonal + s
            here = best.get(s, (0, 0, -1))  # the words of this diagonal before i
            skipped = best.get(s + 1, (0, 0, -1))  # template word i is left out
            passed = fresh.get(s - 1, (0, 0, -1))  # text word is left out
            found = max(skipped, passed)
            if 0 <= at < len(words) and words[at] == code:
                found = max(found, (here[0] + 1, here[1] if here[0] else -at, at))
            else:
                found = max(found, here)
            fresh[s] = found
        best = fresh
    matched, first, last = max(best.values(), default=(0, 0, -1))
    return matched, -first, last + 1


class Scanner:
    """Finds templates in one text."""

    def __init__(self, templates: Mapping[str, str], gram: int, window: int, coverage: float, band: int):
        self.codes = Plain()
        self.gram, self.window, self.coverage, self.band = gram, window, coverage, band
        self.names = list(templates)
        self.templates = [self.codes.of(t.split()) for t in templates.values()]
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, template in enumerate(self.templates):
            # Every place of a template is indexed, and texts are winnowed, so that short notices are not missed.
            for place, h in enumerate(windows(template, gram).tolist()):
                self.index[h].append((k, place))
        self.known = np.sort(np.fromiter(self.index, np.uint64, len(self.index)))

    def spans(self, text: str) -> list[tuple[str, int, int, float]]:
        """``(template, first word, end word, coverage)``, best first where spans of a template overlap."""
        words = text.split()
        if len(words) < self.gram:
            return []
        codes = self.codes.of(words)
        prints, at = winnow(codes, self.gram, self.window)
        place = np.minimum(np.searchsorted(self.known, prints), len(self.known) - 1)
        hits = np.flatnonzero(self.known[place] == prints)
        diagonals: dict[int, set[int]] = defaultdict(set)
        for h in hits.tolist():
            for k, offset in self.index[int(prints[h])]:
                diagonals[k].add(int(at[h]) - offset)
        out = []
        for k, shifts in diagonals.items():
            template, found, reached = self.templates[k], [], None
            for d in sorted(shifts):
                # Diagonals inside the band of an aligned one are covered by it.
                if reached is not None and d - reached <= self.band:
                    continue
                reached = d
                matched, start, end = align(template, codes, d, self.band)
                if matched >= self.coverage * len(template):
                    found.append((matched / len(template), start, end))
            taken: list[tuple[int, int]] = []
            for share, start, end in sorted(found, key=lambda f: (-f[0], f[1])):
                if all(end <= a or start >= b for a, b in taken):
                    taken.append((start, end))
                    out.append((self.names[k], start, end, share))
        return sorted(out, key=lambda s: (s[1], s[0]))


def licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Mapping[str, str] = TEMPLATES,
             gram: int = GRAM, window: int = WINDOW, coverage: float = COVERAGE, band: int = BAND) -> DataFrame:
    """``(doc_id, license, first_word, end_word, coverage)`` for every template found in a text, words counted from 0.

    Case and outer punctuation of words do not matter. A template is found where at least ``coverage`` of its words are
    matched in order within ``band`` of a diagonal that shares a fingerprint. Null, empty and very short texts hold none;
    rows are read one by one, so repeated rows and null ids repeat their results; an empty table gives an empty result.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    settings = (dict(templates), gram, window, coverage, band)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*settings)
        for batch in batches:
            rows, found = [], []
            for row, text_value in enumerate(batch.column(1)):
                value = text_value.as_py()
                for span in scanner.spans(value) if value else ():
                    rows.append(row)
                    found.append(span)
            cols = list(zip(*found)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()),
                 pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64())],
                ["doc_id", "license", "first_word", "end_word", "coverage"],
            )

    return docs.select(f"`{doc_id}`", f"`{text}`").mapInArrow(
        run, f"doc_id {kind}, license string, first_word int, end_word int, coverage double"
    )
