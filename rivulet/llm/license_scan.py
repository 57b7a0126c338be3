"""Licence scans with a generalised suffix automaton.

The automaton is built over the word sequences of licence templates and phrases. A text is streamed through it once:
after each word the state and length are the longest stretch of words ending there that stands in some template (the
matching statistics), and the state's suffix links give the longest one of every other template. A match ends where
its own template goes on with another word than the text. Matches of `least` words or more are chained: a chain runs
forward in text and template, at most `gap` words of the text between two matches, and of all chains the one that
covers most words of its template is taken, by dynamic programming over the matches in order of their ends. A template
is reported where a chain covers `covered` of its words or more; a span's share of its template is its score.

Base phrases are found by the same walk: a phrase ends where its own state is the state reached or on its chain of
suffix links. Words are runs of 0-9, a-z and bytes above 0x7F after A-Z are lower-cased.

Null text counts as empty: no words, no places, no labels, score 0. Repeated rows are scanned each.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Well-known passages of licences and of the notices that refer to them.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License",
        "Licensed under the MIT License",
        "SPDX-License-Identifier: MIT",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program",
        "This work is licensed under the GNU General Public License, version 3",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Licensed under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "cc": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under the Creative Commons Attribution License",
    ],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without prior written permission"],
}


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(LETTERS))


@dataclass
class Automaton:
    """Generalised suffix automaton over several word sequences; state 0 is the empty stretch."""

    step: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])  # (sequence, words up to the end)

    def _new(self, length: int, step: dict[bytes, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.step) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """A state of its own for the stretches of q that p + word reaches."""
        clone = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: int, words: list[bytes]) -> int:
        """The state of the whole sequence."""
        last, path = 0, []
        for word in words:
            p, q = last, self.step[last].get(word)
            if q is None:
                last = self._new(self.length[last] + 1, {}, 0)
                while p >= 0 and word not in self.step[p]:
                    self.step[p][word] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.step[p][word]
                    self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            else:
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            path.append(word)
        state = 0
        for i, word in enumerate(path):
            state = self.step[state][word]
            self.ends[state].add((sequence, i + 1))
        return state

    def close(self) -> None:
        """Ends of a state are also those of every longer stretch that ends with it."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[v]] |= self.ends[v] if self.link[v] > 0 else set()


class Scanner:
    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str], least: int = 4, gap: int = 3, covered: float = 0.75):
        self.least, self.gap, self.covered = least, gap, covered
        self.auto, self.sequences = Automaton(), []
        texts_of: list[list[bytes]] = []  # words of each template and phrase
        for label, texts in templates.items():
            for text in texts:
                words = words_of(text)
                self.auto.add(len(self.sequences), words)
                self.sequences.append((label, len(words)))
                texts_of.append(words)
        own = {}
        for phrase, label in phrases.items():
            words = words_of(phrase)
            self.auto.add(len(self.sequences), words)
            self.sequences.append((label, len(words)))
            texts_of.append(words)
            own[phrase] = (words, label)
        self.auto.close()
        self.phrase: dict[int, tuple[int, str]] = {}  # of the state of the phrase itself
        for words, label in own.values():
            state = 0
            for w in words:
                state = self.auto.step[state][w]
            self.phrase[state] = (len(words), label)
        self.base: list[list[tuple[int, int, str]]] = []  # of each state: (words needed, words, label)
        for v in range(len(self.auto.link)):
            found, u = [], v
            while u > 0:
                if u in self.phrase:
                    found.append((self.phrase[u][0], *self.phrase[u]))
                u = self.auto.link[u]
            self.base.append(found)
        self.known = set(self.auto.step[0])
        self.texts = texts_of
        # of each state: (sequence, words up to the end, words) of the longest stretch that ends there, of each place
        self.places: list[list[tuple[int, int, int]]] = []
        for v in range(len(self.auto.link)):
            found, u = {}, v
            while u > 0 and self.auto.length[u] >= least:
                for place in self.auto.ends[u]:
                    found.setdefault(place, self.auto.length[u])
                u = self.auto.link[u]
            self.places.append([(*place, k) for place, k in sorted(found.items())])

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        step, link, length = self.auto.step, self.auto.link, self.auto.length
        base, matches = [], []  # base: (start, label); matches: (end, sequence, words of it up to the end, words)
        state = n = 0
        known, places, least, texts = self.known, self.places, self.least, self.texts
        at = -2
        for i in [i for i, w in enumerate(words) if w in known]:
            word = words[i]
            if i != at + 1:  # a word of no template lay between
                state = n = 0
            while state and word not in step[state]:
                state = link[state]
                n = length[state]
            state, n = step[state][word], n + 1
            for need, k, label in self.base[state]:
                if n >= need:
                    base.append((i + 1 - k, label))
            if n >= least:
                ahead = words[i + 1] if i + 1 < len(words) else None
                for sequence, place, k in places[state]:
                    own = texts[sequence]
                    if min(n, k) >= least and (place == len(own) or own[place] != ahead):
                        matches.append((i + 1, sequence, place, min(n, k)))
            at = i
        spans = self.chain(matches)
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": min((s for s, _ in base), default=None),
            "last_word": max((s for s, _ in base), default=None),
            "base_labels": sorted({x for _, x in base}),
            "labels": sorted({x for _, x in base} | {s[0] for s in spans}),
            "score": max([float(bool(base)) * 0.5, *(s[3] for s in spans)]),
            "spans": spans,
        }

    def chains(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(sequence, words covered, first word, word after the last) of the best chain that ends with each match.

        Where two matches overlap, in the text or in the template, the later one counts from where they part."""
        recent: dict[int, list[tuple[int, int, int, int]]] = {}  # of each sequence: (end, place, covered, first)
        out = []
        for end, sequence, place, n in matches:
            start, best = end - n, (n, end - n)
            held = [x for x in recent.get(sequence, ()) if x[0] >= end - self.sequences[sequence][1] - self.gap]
            for e, p, covered, first in held:
                shared = max(0, e - start, p - (place - n))
                if shared < n and e < end and p < place and start + shared - e <= self.gap and (covered + n - shared, first) > best:
                    best = (covered + n - shared, first)
            held.append((end, place, *best))
            recent[sequence] = held
            out.append((sequence, *best, end))
        return out

    def chain(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, covered share) of template spans in a text; the best first where
        spans of a template overlap."""
        taken: dict[int, list[tuple[int, int]]] = {}
        spans = set()
        rated = ((covered / self.sequences[q][1], first, end, q) for q, covered, first, end in self.chains(matches))
        for share, first, end, q in sorted((x for x in rated if x[0] >= self.covered), key=lambda x: (-x[0], x[2] - x[1], x[1])):
            own = taken.setdefault(q, [])
            at = bisect(own, (first, end))
            if (at == 0 or own[at - 1][1] <= first) and (at == len(own) or own[at][0] >= end):
                own.insert(at, (first, end))
                spans.add((self.sequences[q][0], first, end, min(1.0, share)))
        return sorted(spans)


SPAN = "array<struct<label:string,start:long,end:long,share:double>>"


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, text_col: str = "text", **rules) -> Column:
    """Struct of n_words, n_base, first_word, last_word, base_labels, labels, score and the spans found."""
    own: list[Scanner] = []

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not own:
            own.append(Scanner(templates or TEMPLATES, PHRASES if phrases is None else phrases, **rules))
        for texts in batches:
            rows = [own[0].scan(t) for t in texts]
            for r in rows:
                r["spans"] = [dict(zip(("label", "start", "end", "share"), s, strict=True)) for s in r["spans"]]
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    kind = f"n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans {SPAN}"
    return F.pandas_udf(run, kind)(text_or_empty(text_col))
