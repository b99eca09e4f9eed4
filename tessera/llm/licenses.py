"""Licence scans with a generalised suffix automaton of licence words.

Operator: ``license_scan``. One automaton holds every word run of every template. A text's words stream
through it and give matching statistics: at each word the longest run ending there that some
template holds. Long maximal matches are chained, in order and with small gaps, into spans of a
template, those that cover most of it first; a template covered enough gives its label. A run that stands in
a template several times may be chained at any of its places. Short phrases are templates too: their
places are the words at which the automaton's state ends with the phrase.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case.

Edge cases: a null or empty text has no words, null first_word and last_word, empty labels and score 0;
repeated rows give repeated results; chains that cover as much as another are taken from the front; long texts are read in
blocks; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import id_type, text_of, utf8_slices

# Phrases, and notices of public licences.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
        "furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from "
        "out of or in connection with the software or the use or other dealings in the software",
    ),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org "
        "licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions "
        "of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain "
        "the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and "
        "the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any "
        "express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the "
        "copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods "
        "or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or "
        "otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
        "notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability "
        "and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
]

#: Bytes to words: what isn't part of one becomes a space, A-Z lower case.
TO_WORDS = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Automaton:
    """Suffix automaton of several word sequences, with each state's places in them."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.own: list[list[tuple[int, int]]] = [[]]  # (sequence, last word) of the beginnings that lead to the state
        for k, words in enumerate(sequences):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, w)
                self.own[last].append((k, at))
        self.below: list[list[int]] = [[] for _ in self.link]
        for s in range(1, len(self.link)):
            self.below[self.link[s]].append(s)

    def ends(self, s: int) -> list[tuple[int, int]]:
        """(sequence, last word) of every place where the state's runs stand: those of all states whose runs end with its own."""
        out, todo = [], [s]
        while todo:
            t = todo.pop()
            out += self.own[t]
            todo += self.below[t]
        return out

    def _state(self, length: int, link: int, follows: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(follows)
        self.own.append([])
        return len(self.length) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return new

    def find(self, words: list[int]) -> int:
        s = 0
        for w in words:
            s = self.next[s][w]
        return s


@dataclass(frozen=True)
class Span:
    label: str
    first: int
    last: int
    coverage: float


class Scanner:
    """Finds phrases and template spans in word sequences. Kept by each worker."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]], least: int, gap: int, coverage: float):
        self.phrases = list(phrases.items())
        self.templates = templates
        self.least, self.gap, self.coverage = least, gap, coverage
        texts = [p.encode().translate(TO_WORDS).split() for p, _ in self.phrases] + [t.encode().translate(TO_WORDS).split() for _, t in templates]
        self.ids = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        sequences = [[self.ids[w] for w in t] for t in texts]
        self.sizes = [len(t) for t in sequences]
        self.automaton = a = Automaton(sequences)
        own: dict[int, list[int]] = {}
        for k in range(len(self.phrases)):
            own.setdefault(a.find(sequences[k]), []).append(k)
        self.ending: list[list[int]] = [[] for _ in a.link]  # phrases that a state's runs may end with
        for s in sorted(range(len(a.link)), key=a.length.__getitem__):
            self.ending[s] = own.get(s, []) + (self.ending[a.link[s]] if s else [])
        self.shortest = min(self.sizes[: len(self.phrases)] + [least])

    def runs(self, data: bytes, block: int = 1 << 22):
        """Number of words, and the runs of known words (start, ids); long texts are read in blocks."""
        n, out, at = 0, [], 0
        while at < len(data):
            end = min(at + block, len(data))
            while end < len(data) and TO_WORDS[data[end]] != 32:
                end += 1
            words = data[at:end].translate(TO_WORDS).split()
            at = end
            known = np.fromiter((self.ids.get(w, -1) for w in words), dtype=np.int32, count=len(words))
            there = np.concatenate([[False], known >= 0, [False]])
            change = np.nonzero(there[1:] != there[:-1])[0]
            for a, b in zip(change[::2], change[1::2], strict=True):
                if out and a == 0 and out[-1][0] + len(out[-1][1]) == n:
                    out[-1][1].extend(known[a:b].tolist())
                elif b - a >= self.shortest or a == 0 or b == len(words):
                    out.append((n + int(a), known[a:b].tolist()))
            n += len(words)
        return n, out

    def matches(self, runs: list[tuple[int, list[int]]]) -> tuple[list[tuple[int, str]], dict[int, list[tuple[int, int, int]]]]:
        """Phrase places (start, label), and by template its matches (first word, first word in the template, words)."""
        a = self.automaton
        places: list[tuple[int, str]] = []
        found: dict[int, list[tuple[int, int, int]]] = {}
        for start, ids in runs:
            s = size = 0
            for k, w in enumerate([*ids, -1]):
                to = a.next[s].get(w)
                if to is None:
                    if size >= self.least:
                        for t, end in a.ends(s):
                            if t >= len(self.phrases):
                                found.setdefault(t - len(self.phrases), []).append((start + k - size, end - size + 1, size))
                    while s and w not in a.next[s]:
                        s = a.link[s]
                        size = a.length[s]
                    to = a.next[s].get(w)
                    if to is None:
                        s = size = 0
                        continue
                s = to
                size += 1
                for p in self.ending[s]:
                    if size >= self.sizes[p]:
                        places.append((start + k - self.sizes[p] + 1, self.phrases[p][1]))
        return places, found

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, str]], list[Span], float]:
        """Number of words, phrase places (start, label), template spans, and the best coverage of any template."""
        n, runs = self.runs(data)
        places, matches = self.matches(runs)
        spans, best = [], 1.0 if places else 0.0
        for t, found in matches.items():
            size = self.sizes[len(self.phrases) + t]
            for covered, first, last in self.chains(found):
                best = max(best, covered / size)
                if covered >= self.coverage * size:
                    spans.append(Span(self.templates[t][0], first, last, covered / size))
        return n, places, spans, min(1.0, best)

    def chains(self, found: list[tuple[int, int, int]]):
        """(words covered, first, last) of matches joined that follow each other in the text and in the template with small gaps; those that cover most first, none over another."""
        found = sorted(found)
        longest = max(size for _, _, size in found)
        total, before = [], []
        begin = 0
        for k, (at, place, size) in enumerate(found):
            best, link = size, -1
            while found[begin][0] + longest + self.gap < at:
                begin += 1
            for j in range(begin, k):
                at2, place2, size2 = found[j]
                over = max(0, at2 + size2 - at, place2 + size2 - place)
                gap = max(at + over - at2 - size2, place + over - place2 - size2)
                if over < size and gap <= self.gap and place > place2 and total[j] + size - over > best:
                    best, link = total[j] + size - over, j
            total.append(best), before.append(link)
        taken: list[tuple[int, int]] = []
        for k in sorted(range(len(found)), key=lambda k: (-total[k], found[k])):
            first, last, j = found[k][0], found[k][0] + found[k][2] - 1, k
            while before[j] >= 0:
                j = before[j]
                first = found[j][0]
            if not any(first <= b and a <= last for a, b in taken):
                taken.append((first, last))
                yield total[k], first, last


def license_scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, least: int = 4, gap: int = 8, coverage: float = 0.75) -> DataFrame:
    """(id, n_words, phrase_starts, phrase_labels, spans, score) for every row.

    phrase_starts and phrase_labels are parallel; spans are (label, first, last, coverage) of chained
    matches of at least `least` words with gaps of at most `gap` words that cover at least `coverage` of
    a template; score is the largest share of any template covered, 1 where a phrase stands.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    span = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("coverage", T.DoubleType())])
    out = T.StructType([T.StructField(id_column, id_type(df, id_column)), T.StructField("n_words", T.LongType()), T.StructField("phrase_starts", T.ArrayType(T.LongType())), T.StructField("phrase_labels", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(span)), T.StructField("score", T.DoubleType())])
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())])), pa.float64()]

    def run(batches):
        scanner = Scanner(phrases, templates, least, gap, coverage)
        for batch in batches:
            for a, texts in utf8_slices(batch, 1):
                rows = []
                for data in texts:
                    n, places, spans, score = scanner.scan(data)
                    rows.append((n, [p for p, _ in places], [x for _, x in places], [vars(s) for s in spans], score))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), *(pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], out.names)

    return df.select(F.col(id_column), text_of(text_column).alias("text")).mapInArrow(run, out)
