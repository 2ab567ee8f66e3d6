"""Licence scans with a generalised suffix automaton of licence tokens.

The token sequences of all licence templates go into one suffix automaton.  A text is
streamed through it: each token extends the current match or falls back along suffix links,
which gives, at every position, the longest stretch of some template that ends there
(matching statistics).  Maximal matches of at least ``MIN_MATCH`` tokens are chained per
template in increasing order of text and template, and a template whose chained matches
cover at least ``MIN_COVER`` of it gives its label and a span, if the parts that decide on the
label (name, version, terms) are each found whole.

A match of ``MIN_MATCH`` tokens consists of template grams, so only stretches of such grams,
found with numpy, are streamed through the automaton.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K
from .common import table

MIN_MATCH = 4
MIN_COVER = 0.8
#: Tokens of a text that may lie between two chained matches.
MAX_GAP = 12

BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Labels follow SPDX in lower case where one fits.  What stands in square brackets decides on
#: the label (name, version, terms) and must be found whole, in one piece.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "released under the [mit license]"),
    ("mit", "licensed under the [mit license]"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    ("apache-2.0", "licensed under the [apache license version 2 0]"),
    (
        "apache-2.0",
        "licensed under the [apache license version 2 0] the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    ("gpl-3.0", "licensed under the [gnu general public license version 3]"),
    ("gpl-2.0", "licensed under the [gnu general public license version 2]"),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the [gnu general public license version 2 as published by the free software foundation]"),
    ("gpl-3.0-or-later", "under the terms of the [gnu general public license either version 3 or any later version]"),
    *(
        (label, f"this {work} is free software you can redistribute it and or modify it under the terms of the [gnu {name} license as published by the free software foundation either version {version} of the license] or at your option any later version")
        for label, work, name, version in (
            ("gpl-2.0-or-later", "program", "general public", "2"), ("gpl-3.0-or-later", "program", "general public", "3"), ("agpl-3.0-or-later", "program", "affero general public", "3"),
            ("lgpl-2.1-or-later", "library", "lesser general public", "2 1"), ("lgpl-3.0-or-later", "library", "lesser general public", "3"),
        )
    ),
    ("lgpl", "licensed under the [gnu lesser general public license]"),
    ("agpl-3.0", "licensed under the [gnu affero general public license version 3]"),
    ("cc-by-nc-4.0", "licensed under [cc by nc 4 0]"),
    ("cc-by-nc-sa-4.0", "licensed under [cc by nc sa 4 0]"),
    ("cc-by-4.0", "licensed under [cc by 4 0]"),
    ("cc-by-sa-4.0", "licensed under [cc by sa 4 0]"),
    ("cc-by", "licensed under a [creative commons attribution license]"),
    *(
        (f"cc-by{short}-4.0", f"[creative commons attribution{terms} 4 0 international] license")
        for short, terms in (("", ""), ("-sa", " sharealike"), ("-nd", " noderivatives"), ("-nc", " noncommercial"), ("-nc-sa", " noncommercial sharealike"), ("-nc-nd", " noncommercial noderivatives"))
    ),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    (
        "bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "neither the name of the copyright holder nor the names of its contributors [may be used to endorse or promote products derived from this software without specific prior written permission]",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("bsl-1.0", "permission is hereby granted free of charge to any [person or organization obtaining a copy of the software and accompanying documentation covered by this license] the software to use reproduce display distribute execute and transmit the software"),
    ("mpl-2.0", "subject to the terms of the [mozilla public license v 2 0]"),
    ("epl-2.0", "made available under the terms of the [eclipse public license 2 0]"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,start_word:long,end_word:long,cover:double>>"
)

_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True


class SuffixAutomaton:
    """Suffix automaton of several token sequences; each state knows one end per template."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[dict[int, int]] = [{}]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].setdefault(k, at + 1)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.ends[self.link[state]]
            for k, end in self.ends[state].items():
                up[k] = min(up.get(k, end), end)

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            q = self.next[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        cur, p = self._state(self.length[last] + 1, 0, {}), last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][token]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return cur

    def statistics(self, tokens: Sequence[int]) -> Iterator[tuple[int, int]]:
        """(length of the longest match that ends here, its state) for each token."""
        state = length = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state = self.next[state][token]
                length += 1
            yield length, state


def _parsed(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Tokens of a template and the bounds of its parts in square brackets."""
    tokens, needed, begin = [], [], 0
    for word in text.split():
        if word.startswith("["):
            begin = len(tokens)
        tokens.append(word.strip("[]"))
        if word.endswith("]"):
            needed.append((begin, len(tokens)))
    return tokens, needed


class Scanner:
    """Templates as an automaton, with base phrases; picklable and built once per task."""

    def __init__(self, templates=TEMPLATES, base=BASE, min_match=MIN_MATCH, min_cover=MIN_COVER, max_gap=MAX_GAP):
        self.labels = [label for label, _ in templates]
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap
        token_lists, self.needed = zip(*(_parsed(text) for _, text in templates))
        phrases = [(phrase.split(), label) for phrase, label in base]
        vocabulary = sorted({w for ts in token_lists for w in ts} | {w for ts, _ in phrases for w in ts})
        raw = np.frombuffer(" ".join(vocabulary).encode(), np.uint8)
        ends = np.flatnonzero(np.append(raw == 32, True))
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = K.word_hashes(raw, starts, ends)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes & K._U(0xFFFF)).astype(np.int64)] = True
        number = {w: i for i, w in enumerate(vocabulary)}
        self.sizes = [len(ts) for ts in token_lists]
        self.phrases = [([number[w] for w in ts], label) for ts, label in phrases]
        sequences = [[number[w] for w in ts] for ts in token_lists]
        self.automaton = SuffixAutomaton(sequences)
        # grams of template tokens as numbers in base len(vocabulary); no longer than fit in 62 bits
        self.base = max(2, len(vocabulary))
        self.gram = max(1, min(min_match, int(62 / np.log2(self.base))))
        self.codes = np.unique(np.concatenate([self._codes(np.array(q, np.int64), np.arange(max(0, len(q) - self.gram + 1))) for q in sequences]))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of word hashes, -1 for other words."""
        out = np.full(len(hashes), -1, np.int32)
        at = np.flatnonzero(self.maybe[(hashes & K._U(0xFFFF)).astype(np.int64)])
        some = hashes[at]
        k = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
        hit = self.hashes[k] == some
        out[at[hit]] = self.ids[k[hit]]
        return out

    def _codes(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The gram at each place as one number."""
        out = np.zeros(len(at), np.int64)
        for j in range(self.gram):
            out = out * self.base + ids[at + j]
        return out

    def stretches(self, ids: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where (first word, end) grams of templates follow each other: matches of ``min_match`` tokens lie nowhere else."""
        m = len(ids) - self.gram + 1
        if m <= 0:
            return
        known = np.arange(m) + self.gram <= last[:m]
        for j in range(self.gram):
            known &= ids[j : m + j] >= 0
        at = np.flatnonzero(known)
        codes = self._codes(ids, at)
        k = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        at = at[self.codes[k] == codes]
        if len(at):
            cuts = np.flatnonzero(np.diff(at) > 1) + 1
            yield from zip(at[np.append(0, cuts)].tolist(), (at[np.append(cuts - 1, len(at) - 1)] + self.gram).tolist())

    def spans(self, stretches: list[tuple[int, list[int]]]) -> list[tuple[str, int, int, float]]:
        """Covered template spans of one text from its stretches (first word, numbers)."""
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for first, tokens in stretches:
            before = (0, 0)
            for at, now in enumerate([*self.automaton.statistics(tokens), (0, 0)]):
                if before[0] >= self.min_match and now[0] <= before[0]:
                    for k, end in self.automaton.ends[before[1]].items():
                        matches.setdefault(k, []).append((first + at - before[0], end - before[0], before[0]))
                before = now
        best: dict[tuple[str, int], tuple[str, int, int, float]] = {}
        for k, found in matches.items():
            for start, end, covered, whole in self._chains(found, self.needed[k]):
                if covered >= self.min_cover * self.sizes[k] and len(whole) == len(self.needed[k]):
                    span = (self.labels[k], start, end, min(1.0, covered / self.sizes[k]))
                    key = (self.labels[k], start)
                    if key not in best or best[key][2:] < span[2:]:
                        best[key] = span
        return sorted(best.values(), key=lambda s: (s[1], s[0]))

    def _chains(self, found: list[tuple[int, int, int]], needed: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, set[int]]]:
        """Chain matches (text start, template start, length) in order; overlaps count once.

        Of each chain: start, end, tokens covered, and which ``needed`` parts one match covers.
        """
        chain: tuple[int, int, int, int, set[int]] | None = None  # start, end, end in the template, covered, parts
        for at, place, n in sorted(found):
            parts = {i for i, (a, b) in enumerate(needed) if place <= a and b <= place + n}
            if chain and at - chain[1] <= self.max_gap and at + n > chain[1] and place + n > chain[2]:
                fresh = min(at + n - max(at, chain[1]), place + n - max(place, chain[2]))
                if fresh > 0 and at >= chain[0]:
                    chain = (chain[0], at + n, place + n, chain[3] + fresh, chain[4] | parts)
                    continue
            if chain:
                yield chain[0], chain[1], chain[3], chain[4]
            chain = (at, at + n, place + n, n, parts)
        if chain:
            yield chain[0], chain[1], chain[3], chain[4]

    def scan(self, t: K.Texts) -> list[tuple]:
        data = K.LOWER[t.data]
        starts, ends, firsts = K.words(t, _ALNUM[data])
        ids = self.numbers(K.word_hashes(data, starts, ends))
        n = len(ids)
        last = np.repeat(firsts[1:], np.diff(firsts))
        base: dict[int, list[tuple[int, str]]] = {}
        for numbers, label in self.phrases:
            m = len(numbers)
            if n < m:
                continue
            hit = np.ones(n - m + 1, bool)
            for j, number in enumerate(numbers):
                hit &= ids[j : n - m + 1 + j] == number
            at = np.flatnonzero(hit)
            at = at[at + m <= last[at]]
            for a, d in zip(at.tolist(), (np.searchsorted(firsts, at, "right") - 1).tolist()):
                base.setdefault(d, []).append((a - int(firsts[d]), label))
        stretches: dict[int, list[tuple[int, list[int]]]] = {}
        for a, b in self.stretches(ids, last):
            d = int(np.searchsorted(firsts, a, "right")) - 1
            stretches.setdefault(d, []).append((a - int(firsts[d]), ids[a:b].tolist()))
        out = []
        for d in range(len(t)):
            places = base.get(d, [])
            spans = self.spans(stretches[d]) if d in stretches else []
            at = [p for p, _ in places]
            base_labels = {x for _, x in places}
            labels = base_labels | {s[0] for s in spans}
            score = max([0.5 if places else 0.0, *(s[3] for s in spans)])
            out.append((int(firsts[d + 1] - firsts[d]), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, [dict(zip(("label", "start_word", "end_word", "cover"), s)) for s in spans]))
        return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Licence labels and spans of every whole text; one row per row of ``docs``.

    Words are maximal runs of ASCII letters, digits and non-ASCII characters after A-Z are
    lower-cased.  Null and empty texts have no words, empty label strings and score 0; ids
    may be null or repeated; extra columns are ignored.  ``score`` is the largest covered
    share of a template, at least 0.5 where a base phrase occurs.  Positions are word
    numbers from 0; ``end_word`` is exclusive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(**options)
        for batch in batches:
            for t in K.slices(batch.column(1)):
                columns = list(zip(*scanner.scan(t)))
                ids = batch.column(0).slice(t.first, len(t))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), f.type) for c, f in zip(columns, _ARROW))], names=["doc_id", *(f.name for f in _ARROW)])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)


_ARROW = [
    pa.field("n_words", pa.int64()), pa.field("n_base", pa.int64()), pa.field("first_word", pa.int64()), pa.field("last_word", pa.int64()),
    pa.field("base_labels", pa.string()), pa.field("labels", pa.string()), pa.field("score", pa.float64()),
    pa.field("spans", pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64())]))),
]


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
