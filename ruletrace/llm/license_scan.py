"""Licence scan with a generalised suffix automaton over the words of licence templates.

Method: the automaton of all templates is built once; the words of a file stream through it and give
matching statistics (the length of the longest template part that ends at each word), and by its suffix links those of every
place of every template. A match of at least ``min_match`` words is kept where the template at that place does not go on
like the file, so a short template counts also where a longer one holds it. Matches are chained, in template order, into the
covered span of a template; a template whose chain covers ``min_cover`` of its words gives its label.

Defined results: null and empty texts have no words, no label and score 0. Repeated rows are judged
each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ruletrace.llm.common import ALNUM_WORDS, LOWERED, table, utf8

# Phrases of the base scan and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Opening words, notices and bodies of public licences, by label.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in "
               "compliance with the license you may obtain a copy of the license at http www apache org "
               "licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international "
                 "license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation either version 3 of the "
            "license or at your option any later version"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation "
            "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
            "permit persons to whom the software is furnished to do so subject to the following conditions the above "
            "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
            "software the software is provided as is without warranty of any kind express or implied including but not "
            "limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no "
            "event shall the authors or copyright holders be liable for any claim damages or other liability whether in "
            "an action of contract tort or otherwise arising from out of or in connection with the software or the use "
            "or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies the "
            "software is provided as is and the author disclaims all warranties with regard to this software including "
            "all implied warranties of merchantability and fitness in no event shall the author be liable for any "
            "special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data "
            "or profits whether in an action of contract negligence or other tortious action arising out of or in "
            "connection with the use or performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met redistributions of source code must retain the above copyright notice this "
            "list of conditions and the following disclaimer redistributions in binary form must reproduce the above "
            "copyright notice this list of conditions and the following disclaimer in the documentation and or other "
            "materials provided with the distribution"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
MIN_MATCH, MIN_COVER = 4, 0.8

_words = bytes(int(LOWERED[b]) if ALNUM_WORDS[b] else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and bytes from x80."""
    return text.translate(_words).split()


class Automaton:
    """Suffix automaton of several word sequences; ``ends`` gives where in which template a state ends."""

    def __init__(self, texts: Sequence[Sequence[int]]):
        self.next, self.link, self.length, self.ends = [{}], [-1], [0], [()]
        for number, text in enumerate(texts):
            last = 0
            for at, word in enumerate(text):
                last = self._extend(last, word)
                self.ends[last] += ((number, at + 1),)
        # A state's words also end wherever those of the states below it end.
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                up = self.link[state]
                self.ends[up] = tuple(dict.fromkeys(self.ends[up] + self.ends[state]))

    def _state(self, length: int, nexts: dict[int, int], link: int) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(())
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, word: int) -> int:
        q = self.next[p].get(word)
        if q is not None:
            return q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        new = self._state(self.length[p] + 1, {}, 0)
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """The state and matching statistic after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        after = self.next[state].get(word)
        return (after, matched + 1) if after is not None else (0, 0)


class Scanner:
    """The automaton with its templates; small, and sent to the tasks as it is."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, min_match: int = MIN_MATCH,
                 min_cover: float = MIN_COVER, phrases: Sequence[tuple[str, str]] = PHRASES):
        texts = [words_of(t.encode()) for _, t in templates]
        base = [words_of(p.encode()) for p, _ in phrases]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts + base for w in t}))}
        self.labels = [label for label, _ in templates]
        self.sizes = [len(t) for t in texts]
        self.automaton = Automaton([[self.vocabulary[w] for w in t] for t in texts])
        self.base = [(tuple(self.vocabulary[w] for w in p), label) for p, (_, label) in zip(base, phrases, strict=True)]
        self.by_first = {}
        for ids, label in self.base:
            self.by_first.setdefault(ids[0], []).append((ids, label))
        self.min_match, self.min_cover = min_match, min_cover
        # The word after each place of a template; none after the last.
        self.following = [[*(self.vocabulary[w] for w in t), None] for t in texts]
        self.inner = self._inner()

    def _inner(self) -> list[tuple[tuple[int, int, int], ...]]:
        """Per state the (template, place after, words) that end with it but are shorter than its own words."""
        a, out = self.automaton, []
        for state in range(len(a.link)):
            seen, found, up = set(a.ends[state]), [], a.link[state]
            while up > 0 and a.length[up] >= self.min_match:
                found += [(t, stop, a.length[up]) for t, stop in a.ends[up] if (t, stop) not in seen]
                seen.update(a.ends[up])
                up = a.link[up]
            out.append(tuple(found))
        return out

    def matches(self, ids: list[int | None], places: list[int]) -> list[tuple[int, int, int, int]]:
        """(template, end place, place after in the template, words) of the matches that cannot go on, in the order they end."""
        out: list[tuple[int, int, int, int]] = []
        state, matched, last = 0, 0, -2
        go, ends = self.automaton.step, self.automaton.ends

        def stop_at(end: int, word: int | None) -> None:
            """Keep the matches that end here and do not go on with the word."""
            for template, stop in ends[state]:
                if self.following[template][stop] != word or word is None:
                    out.append((template, end, stop, min(matched, stop)))
            for template, stop, n in self.inner[state]:
                if self.following[template][stop] != word or word is None:
                    out.append((template, end, stop, n))

        for at in places:
            if at != last + 1:
                if matched >= self.min_match:
                    stop_at(last + 1, None)
                state, matched = 0, 0
            if matched >= self.min_match:
                stop_at(at, ids[at])
            state, matched = go(state, matched, ids[at])
            last = at
        if matched >= self.min_match:
            stop_at(last + 1, None)
        return out

    def spans(self, ids: list[int | None], places: list[int]) -> list[tuple[int, int, int, float]]:
        """(template, first word, word after the last, part of the template covered) of the best chain
        of each template that is touched."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for template, end, stop, n in self.matches(ids, places):
            if n >= self.min_match:
                by_template.setdefault(template, []).append((end - n, stop - n, n))
        return [(t, *self._chain(found, self.sizes[t])) for t, found in sorted(by_template.items())]

    @staticmethod
    def _chain(found: list[tuple[int, int, int]], size: int) -> tuple[int, int, float]:
        """Matches in file order and template order, no further apart than the template is long. They come in the order they end."""
        best = (0, 0, 0.0)
        chains: list[list[int]] = []  # first place, place after, template place after, words covered
        for place, at, n in found:
            grown = [place, place + n, at + n, n]
            for c in chains:
                if c[1] <= place <= c[1] + size and c[2] <= at and c[3] + n > grown[3]:
                    grown = [c[0], place + n, at + n, c[3] + n]
            # Later matches end later, and none is longer than the template: nothing can follow the rest.
            chains = [c for c in chains if c[1] + 2 * size >= place]
            chains.append(grown)
            if grown[3] / size > best[2]:
                best = (grown[0], grown[1], grown[3] / size)
        return best

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float, list[tuple]]:
        words = words_of(text)
        ids = list(map(self.vocabulary.get, words))
        places = [i for i, x in enumerate(ids) if x is not None]
        n_base, first, last, base = 0, None, None, set()
        for at in places:
            for phrase, label in self.by_first.get(ids[at], ()):
                if tuple(ids[at:at + len(phrase)]) == phrase:
                    n_base += 1
                    first, last = (at if first is None else first), at
                    base.add(label)
        spans = self.spans(ids, places)
        more = {self.labels[t] for t, _, _, cover in spans if cover >= self.min_cover}
        score = max((cover for *_, cover in spans), default=0.0)
        return (len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), score,
                [(self.labels[t], a, b, c) for t, a, b, c in spans if c >= self.min_cover])


SPANS = "array<struct<label: string, start: int, stop: int, cover: double>>"
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          f"labels string, score double, spans {SPANS}")
SPAN_TYPE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32()),
                                ("cover", pa.float64())]))


def license_scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Licence labels, score and covered spans of every row of ``docs`` (doc_id, text)."""
    scanner = scanner or Scanner()
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), SPAN_TYPE]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, batch.num_rows, 512):
                found = [scanner.scan(t.as_py()) for t in texts[lo:lo + 512]]
                columns = list(zip(*found, strict=True))
                spans = [[dict(zip(("label", "start", "stop", "cover"), s, strict=True)) for s in x] for x in columns[7]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:lo + 512],
                     *(pa.array(c, t) for c, t in zip([*columns[:7], spans], types, strict=True))],
                    ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text")) \
        .mapInArrow(run, SCHEMA)


def op6_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")
