"""Licence scans by a generalised suffix automaton.

The automaton holds every run of words of the licence templates.  A text's words stream
through it, which gives for each place the longest piece ending there that some template
holds (its matching statistics).  A piece that the next word doesn't lengthen is a match;
it counts for each template with the longest part that ends there in that template.  Matches
are chained per template, forward in the text and in the template with short gaps, and a
chain that covers enough of a template's words is a span with the template's label.

Besides, the places of the base phrases are counted.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, after
lower-casing A-Z.  A null or empty text has no word, no span, no label and score 0; equal
texts give equal results; an empty table stays empty; other columns stay, and one named as
the output is replaced.  Texts of any length are read in pieces of bounded size; a word is
kept as a number.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Wordings of public licences, each with its label.  Names and years stay out.
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
        later version."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions."""),
    ("cc0", """The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his
        or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent
        allowed by law."""),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
]

LEAST = 3  # words of a match
GAP = 20  # words that may stand between two matches of a chain, in the text and in the template
COVERED = 0.8  # share of a template's words that a span covers

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")  # before lower-casing
PIECE = 1 << 20  # bytes of a text cut into words at a time


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece; pieces end where a word can't go on."""
    at = 0
    while at < len(text):
        cut = BREAK.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.end() if cut else len(text)
        yield WORD.findall(text[at:end].lower())
        at = end


class Automaton:
    """Suffix automaton of several sequences: state 0 is the empty piece."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self.extend(last, token, ends)
                ends[last].add((number, at + 1))
        # A state's places are also places of the shorter pieces it links to.
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                ends[self.link[state]] |= ends[state]
        self.ends = [sorted(e) for e in ends]

    def state(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append(set())
        return len(self.length) - 1

    def split(self, at: int, token: int, ends: list) -> int:
        """The state for the piece of ``at`` plus the token alone, where longer pieces share it."""
        old = self.next[at][token]
        if self.length[old] == self.length[at] + 1:
            return old
        copy = self.state(self.length[at] + 1, ends)
        self.next[copy] = dict(self.next[old])
        self.link[copy], self.link[old] = self.link[old], copy
        while at >= 0 and self.next[at].get(token) == old:
            self.next[at][token] = copy
            at = self.link[at]
        return copy

    def extend(self, last: int, token: int, ends: list) -> int:
        if token in self.next[last]:
            return self.split(last, token, ends)
        new = self.state(self.length[last] + 1, ends)
        at = last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self.split(at, token, ends)
        return new

    def statistics(self, tokens) -> Iterator[tuple[int, int]]:
        """After each token, the state and length of the longest piece ending there."""
        state = length = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state = self.next[state][token]
                length += 1
            yield state, length


class Scanner:
    def __init__(self, templates, phrases: dict[str, str], least: int, gap: int, covered: float):
        self.least, self.gap, self.covered = least, gap, covered
        wordings = [WORD.findall(wording.encode().lower()) for _, wording in templates]
        self.labels = [label for label, _ in templates]
        named = [(WORD.findall(phrase.encode().lower()), label) for phrase, label in phrases.items()]
        # 0 is a word that no template or phrase holds.
        self.number: dict[bytes, int] = {}
        for word in [w for wording in wordings for w in wording] + [w for phrase, _ in named for w in phrase]:
            if word not in self.number:
                self.number[word] = len(self.number) + 1
        self.phrases = [([self.number[w] for w in phrase], label) for phrase, label in named]
        self.templates = [[self.number[w] for w in wording] for wording in wordings]
        self.automaton = Automaton(self.templates)

    def numbers(self, text: bytes) -> np.ndarray:
        get = self.number.get
        parts = [np.fromiter((get(w, 0) for w in words), np.int32, len(words)) for words in words_of(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def phrase_places(self, numbers: np.ndarray) -> Iterator[tuple[int, str]]:
        for phrase, label in self.phrases:
            starts = np.flatnonzero(numbers == phrase[0])
            for i, word in enumerate(phrase[1:], 1):
                starts = starts[starts + i < len(numbers)]
                starts = starts[numbers[starts + i] == word]
            yield from ((int(s), label) for s in starts)

    def matches(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(template, end in the text, end in the template, length), in order of text ends."""
        known = np.flatnonzero(np.diff(np.r_[0, (numbers > 0).astype(np.int8), 0]))
        for start, end in known.reshape(-1, 2)[known[1::2] - known[::2] >= self.least]:
            state = length = 0
            for at, (next_state, next_length) in enumerate(self.automaton.statistics(numbers[start:end].tolist()), int(start)):
                if next_length <= length and length >= self.least:
                    yield from self.placed(state, length, at)
                state, length = next_state, next_length
            if length >= self.least:
                yield from self.placed(state, length, int(end))

    def placed(self, state: int, length: int, at: int) -> Iterator[tuple[int, int, int, int]]:
        """The match's places in each template, with its longest part that the template holds."""
        seen: set[int] = set()
        while length >= self.least:
            ends = self.automaton.ends[state]
            yield from ((template, at, end, length) for template, end in ends if template not in seen)
            seen.update(template for template, _ in ends)
            state = self.automaton.link[state]
            length = self.automaton.length[state]

    def spans(self, numbers: np.ndarray) -> tuple[list[tuple[int, int, str, float]], float]:
        """Covered spans (start, end, label, share), and the largest share of any chain."""
        best = 0.0
        found = []
        open_: dict[int, list[list]] = defaultdict(list)  # by template: [text end, template end, words, start, chain]
        chains: dict[int, dict[int, tuple[int, int, int]]] = defaultdict(dict)  # template, chain: words, start, end
        count = 0
        for template, at, end, length in self.matches(numbers):
            near = [m for m in open_[template] if m[0] >= at - length - self.gap]
            words, start, chain = length, at - length, None
            for m_at, m_end, m_words, m_start, m_chain in near:
                if m_at < at and m_end < end and abs((at - m_at) - (end - m_end)) <= self.gap and end - m_end - length <= self.gap:
                    more = m_words + min(length, at - m_at, end - m_end)
                    if more > words or (more == words and chain is None):
                        words, start, chain = more, m_start, m_chain
            if chain is None:
                chain, count = count, count + 1
            near.append([at, end, words, start, chain])
            open_[template] = near
            if words > chains[template].get(chain, (0, 0, 0))[0]:
                chains[template][chain] = (words, start, at)
        for template, of_template in chains.items():
            total = len(self.templates[template])
            for words, start, end in of_template.values():
                share = min(1.0, words / total)
                best = max(best, share)
                if share >= self.covered:
                    found.append((start, end, self.labels[template], share))
        return sorted(set(found)), best

    def scan(self, text: bytes) -> dict:
        numbers = self.numbers(text)
        places = list(self.phrase_places(numbers))
        spans, share = self.spans(numbers)
        base = sorted({label for _, label in places})
        return {
            "n_words": len(numbers), "n_base": len(places),
            "first_word": min((s for s, _ in places), default=None), "last_word": max((s for s, _ in places), default=None),
            "base_labels": base, "labels": sorted({*base, *(label for _, _, label, _ in spans)}),
            "score": 1.0 if places else share,
            "spans": [{"first_word": s, "end_word": e, "label": label, "covered": c} for s, e, label, c in spans],
        }


SPAN = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("covered", pa.float64())])
SCAN = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()), ("spans", pa.list_(SPAN)),
])
SCAN_SQL = """struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: array<string>, labels: array<string>,
    score: double, spans: array<struct<first_word: bigint, end_word: bigint, label: string, covered: double>>>"""


@functools.lru_cache(maxsize=4)
def scanner(templates: tuple, phrases: tuple, least: int, gap: int, covered: float) -> Scanner:
    return Scanner(list(templates), dict(phrases), least, gap, covered)


def with_scan(
    df: DataFrame, text: str = "text", out: str = "scan", templates=TEMPLATES, phrases=PHRASES, least: int = LEAST, gap: int = GAP, covered: float = COVERED
) -> DataFrame:
    """The rows with a struct of word count, phrase places, labels, score and spans.

    ``score`` is 1 where a phrase stands, else the largest covered share of a template.
    """
    made_of = tuple(map(tuple, templates)), tuple(phrases.items()), least, gap, covered

    @F.arrow_udf(SCAN_SQL)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = scanner(*made_of)
        for batch in batches:
            yield pa.array([of.scan(text.as_buffer().to_pybytes()) for text in batch], SCAN)

    return df.withColumn(out, scanned(F.coalesce(F.col(text).cast("binary"), F.lit(b""))))
