"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds every substring of the templates. Streaming a file's tokens through it gives matching statistics:
at each token the length of the longest substring of each template that ends there. Long maximal matches are then chained,
per template, into spans: tokens that a chain covers count for it, tokens that it skips in the file against it, and the
words that tell a licence from its like have to stand in one match. Phrases that name a licence are counted as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweft.llm.common import LOWER, chunks, hashed_spans, word_spans
from lumenweft.session import ship

# Phrases that name a licence, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public licence notices, by name and label, and the words of a notice that tell it from others.
TELLING = {
    "mit-grant": "MIT License",
    "mit-grant-2": "MIT license",
    "apache-grant": "Apache License",
    "gpl-grant": "GNU General Public License",
    "cc-by-grant": "Creative Commons Attribution 4.0",
    "apache-header": "Apache License",
    "gpl-notice": "GNU General Public License",
}
TEMPLATES = [
    ("mit-grant", "mit", "Released under the MIT License"),
    ("mit-grant-2", "mit", "This project is licensed under the terms of the MIT license"),
    ("apache-grant", "apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl-grant", "gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by-grant", "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    (
        "mit-permission",
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.",
    ),
    (
        "apache-header",
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl-notice",
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "bsd-conditions",
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
]

#: Matches of fewer tokens are not chained; gaps of a chain in the file, in tokens; what a chain must cover of a template,
#: less its gaps, as a share.
MIN_MATCH, MAX_GAP, MIN_COVERAGE = 3, 12, 0.6

#: Digits, letters (after lower-casing A-Z) and everything beyond ASCII.
IS_TOKEN = np.ones(256, bool)
IS_TOKEN[:0x30] = IS_TOKEN[0x3A:0x61] = IS_TOKEN[0x7B:0x80] = False


def _hash_words(text: str) -> np.ndarray:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = word_spans(np.array([0, len(data)]), data, IS_TOKEN)
    return hashed_spans(data, starts, ends)


class Automaton:
    """Suffix automaton of several token sequences; each state knows where, in which sequences, it ends."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for which, tokens in enumerate(sequences):
            last = 0
            for at, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].append((which, at))
        self.longer: list[list[int]] = [[] for _ in self.next]
        for state in range(1, len(self.next)):
            self.longer[self.link[state]].append(state)
        self.found: dict[int, dict[int, list[int]]] = {}

    def _new(self, length: int, nexts: dict[int, int], link: int) -> int:
        self.next.append(nexts)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, state: int, token: int) -> int:
        """The state for the substring of ``state`` followed by ``token``, cloned from a longer one if need be."""
        target = self.next[state][token]
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = clone
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new = self._new(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, token)
        return new

    def places(self, state: int) -> dict[int, list[int]]:
        """Where the substrings of a state end, in all sequences that have them: its own places and those of longer ones."""
        if state not in self.found:
            every, left = [], [state]
            while left:
                s = left.pop()
                every += self.ends[s]
                left += self.longer[s]
            out: dict[int, list[int]] = {}
            for which, at in sorted(every):
                out.setdefault(which, []).append(at)
            self.found[state] = out
        return self.found[state]

    def matches(self, tokens: list[int], least: int) -> Iterator[tuple[int, int, int, list[int]]]:
        """Of each sequence, the maximal matches of ``least`` tokens at least: (sequence, start, length, where they start in
        it), in the order of their ends."""
        state = length = 0
        before: dict[int, tuple[int, int]] = {}
        for at, token in enumerate([*tokens, -1]):
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            # The longest match that ends here, and shorter ones of sequences that do not have it.
            now: dict[int, tuple[int, int]] = {}
            s, n = state, length
            while s > 0 and n >= least:
                for which in self.places(s):
                    now.setdefault(which, (n, s))
                s = self.link[s]
                n = self.length[s]
            for which, (n, s) in sorted(before.items()):
                if now.get(which, (0, 0))[0] <= n:
                    yield which, at - n, n, [e - n + 1 for e in self.places(s)[which]]
            before = now


def chains(matches: list[tuple[int, int, list[int]]], size: int, telling: tuple[int, int], max_gap: int, coverage: float) -> list[tuple[int, int, int, float]]:
    """(first token, last token, covered tokens, coverage) of a template's best chains that do not overlap.

    ``matches`` (start, length, places in the template) come in the order of the text. A chain goes forward in both; where
    two of its matches overlap, the later gives way; it skips ``max_gap`` tokens of the text at most between two, and each of
    them takes one off what is covered. One match has to hold the template's tokens ``telling`` (from, to; equal if none).
    Of the chains to each match the best is kept: those with the telling words first, then by covered tokens less gaps.
    """
    done: list[tuple[bool, int, int, int, int, int]] = []  # told, score, covered, first, end, end in the template
    open_from = 0
    for start, length, places in matches:
        while open_from < len(done) and done[open_from][4] < start - max_gap:
            open_from += 1
        new = []
        for place in places:
            told = place <= telling[0] and telling[1] <= place + length
            best = (told or telling[0] == telling[1], length, length, start, start + length, place + length)
            for before in done[open_from:]:
                overlap = max(0, before[4] - start, before[5] - place)
                gap = start + overlap - before[4]
                if overlap < length and gap <= max_gap:
                    best = max(best, (before[0] or told, before[1] + length - overlap - gap, before[2] + length - overlap, before[3], start + length, place + length))
            new.append(best)
        done += new
    out: list[tuple[int, int, int, float]] = []
    for told, score, covered, first, end, _ in sorted(done, key=lambda c: (-c[1], c[3])):
        if told and score >= coverage * size and all(end <= a or b < first for a, b, _, _ in out):
            out.append((first, end - 1, covered, score / size))
    return sorted(out)


SCHEMA = (
    "doc_id {id}, n_words long, phrases array<struct<label: string, start: long>>, "
    "spans array<struct<template: string, label: string, first_word: long, last_word: long, covered: long, coverage: double>>"
)


def _place(words: np.ndarray, part: np.ndarray) -> tuple[int, int]:
    """Where ``part`` first stands in ``words`` (from, to)."""
    return next((k, k + len(part)) for k in range(len(words) - len(part) + 1) if (words[k : k + len(part)] == part).all())


def _scanner(phrases: dict[str, str], templates: list[tuple[str, str, str]], schema: pa.DataType):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = [_hash_words(text) for _, _, text in templates]
        sought = [(_hash_words(p), label) for p, label in phrases.items()]
        vocabulary = np.unique(np.concatenate([*hashed, *(h for h, _ in sought)]))
        ids = [np.searchsorted(vocabulary, h) for h in hashed]
        automaton, sizes = Automaton([x.tolist() for x in ids]), [len(x) for x in ids]
        telling = [_place(x, _hash_words(TELLING.get(name, ""))) for (name, _, _), x in zip(templates, hashed, strict=True)]
        sought = [(np.searchsorted(vocabulary, h), label) for h, label in sought]
        for batch in batches:
            for first, end, offsets, data in chunks(batch):
                low = LOWER[data]
                starts, ends, begin = word_spans(offsets, low, IS_TOKEN)
                hashes = hashed_spans(low, starts, ends)
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                token = np.where(vocabulary[at] == hashes, at, -1)
                doc = np.repeat(np.arange(end - first), np.diff(begin))
                hits: list[list] = [[] for _ in range(end - first)]
                spans: list[list] = [[] for _ in range(end - first)]
                for phrase, label in sought:
                    n = len(token) - len(phrase) + 1
                    if n > 0:
                        here = doc[:n] == doc[len(phrase) - 1 :]
                        for k, wanted in enumerate(phrase):
                            here &= token[k : k + n] == wanted
                        for i in np.flatnonzero(here).tolist():
                            hits[doc[i]].append({"label": label, "start": i - int(begin[doc[i]])})
                # Only runs of known tokens can match; an unknown token sends the automaton back to its start.
                known = np.concatenate([[False], token >= 0, [False]])
                run_start = np.flatnonzero(known[1:-1] & (~known[:-2] | np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else known[1:-1]))
                run_end = np.flatnonzero(known[1:-1] & (~known[2:] | np.concatenate([doc[1:] != doc[:-1], [True]]) if len(doc) else known[1:-1])) + 1
                long_runs = run_end - run_start >= MIN_MATCH
                found: dict[tuple[int, int], list] = {}
                for a, b in zip(run_start[long_runs].tolist(), run_end[long_runs].tolist(), strict=True):
                    base = int(begin[doc[a]])
                    for which, start, length, places in automaton.matches(token[a:b].tolist(), MIN_MATCH):
                        found.setdefault((int(doc[a]), which), []).append((a - base + start, length, places))
                for (d, which), matches in sorted(found.items()):
                    for a, b, covered, coverage in chains(matches, sizes[which], telling[which], MAX_GAP, MIN_COVERAGE):
                        spans[d].append({"template": templates[which][0], "label": templates[which][1], "first_word": a, "last_word": b, "covered": covered, "coverage": coverage})
                columns = [batch.column(0).slice(first, end - first), pa.array(np.diff(begin)), pa.array(hits, schema.field("phrases").type), pa.array(spans, schema.field("spans").type)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return scan


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, phrases, spans) for each row of ``docs`` (doc_id, text; more columns are ignored).

    ``phrases`` lists every place of a naming phrase, ``spans`` the covered template spans, both in words from 0. Null
    and empty texts have no words. Repeated rows are scanned each; an empty table gives an empty result. Matches never
    cross rows. Spans of one template do not overlap; of those that would, the one that covers more is there. ``coverage``
    counts what a span covers less what it skips. TELLING has the words that a template of that name must match.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(docs.sparkSession)
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ddl = SCHEMA.format(id=read.schema["doc_id"].dataType.simpleString())
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return read.mapInArrow(_scanner(phrases, templates, schema), ddl)


def op2(docs: DataFrame) -> DataFrame:
    """Counts and places of naming phrases, labels and a score: the largest coverage, one half at least if named."""
    starts = F.transform("phrases", lambda p: p.start)
    base = F.array_sort(F.array_distinct(F.transform("phrases", lambda p: p.label)))
    every = F.array_sort(F.array_union(F.transform("phrases", lambda p: p.label), F.transform("spans", lambda s: s.label)))
    score = F.greatest(F.when(F.size("phrases") > 0, 0.5).otherwise(0.0), F.coalesce(F.array_max(F.transform("spans", lambda s: s.coverage)), F.lit(0.0)))
    return license_scan(docs).select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"), "spans",
    )
