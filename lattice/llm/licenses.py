"""Licence scans with a generalised suffix automaton of licence texts' words.

All templates go into one automaton. A file's words are streamed through it: after each word the state
and length are the longest match that ends there (the matching statistics). Two things come of them:

* A phrase stands at a place when it is a suffix of the match there, which the suffix links tell.
* Matches that cannot grow and are long enough are chained for each template, in order of both file
  and template, into covered spans; a chain that covers enough of the template is a label.

Words outside the templates' vocabulary reset the automaton, so only runs of vocabulary words are walked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm.shared import Task, small_batches
from lattice.llm.text import ALNUM, U64, blocks, words, words_of

# The phrases whose places are counted, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Wording of common licence notices, by a label of each.
TEMPLATES = (
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit-notice", "Released under the MIT License"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-text", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version"),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc-notice", "Licensed under CC BY-NC"),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense-text", "This is free and unencumbered software released into the public domain."),
)

SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("covered", pa.float64())])
FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:bigint,stop:bigint,covered:double>>"


@dataclass
class Automaton:
    """Generalised suffix automaton of word-id sequences; state 0 is the empty match."""

    next: list = field(default_factory=lambda: [{}])
    link: list = field(default_factory=lambda: [-1])
    length: list = field(default_factory=lambda: [0])
    ends: list = field(default_factory=lambda: [{}])  # of each state, template -> last words of all places where it ends

    def _new(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def add(self, template: int, sequence: list[int]) -> None:
        state = 0
        for k, w in enumerate(sequence):
            state = self._extend(state, w)
            self.ends[state].setdefault(template, set()).add(k)

    def finish(self, long: int) -> None:
        """Hands each state's places on to the shorter matches that its suffix link leads to, down to matches of ``long`` words."""
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.length[self.link[s]] >= long:
                for t, places in self.ends[s].items():
                    self.ends[self.link[s]].setdefault(t, set()).update(places)

    def state_of(self, sequence: list[int]) -> int:
        state = 0
        for w in sequence:
            state = self.next[state][w]
        return state


class Scanner:
    """Automaton of phrases and templates. long: words of a match that counts; gap: words between links of a chain; enough: share of a template that makes its label."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES, long: int = 4, gap: int = 12, enough: float = 0.75):
        self.long, self.gap, self.enough = long, gap, enough
        self.phrases, self.templates = phrases, templates
        hashed = [words_of(t, ALNUM) for t, _ in phrases] + [words_of(t, ALNUM) for _, t in templates]
        self.vocabulary = np.unique(np.concatenate(hashed))
        sequences = [np.searchsorted(self.vocabulary, h).tolist() for h in hashed]
        n = len(phrases)
        self.phrase_length, self.template_length = [len(s) for s in sequences[:n]], [len(s) for s in sequences[n:]]
        self.shortest = min(*self.phrase_length, self.long)
        self.machine = Automaton()
        for k, s in enumerate(sequences):
            self.machine.add(k - n, s)  # phrases have numbers below 0
        self.machine.finish(long)
        whole = {self.machine.state_of(s): k for k, s in enumerate(sequences[:n])}
        self.suffixes: list[tuple] = []  # of each state, the phrases that are suffixes of its longest match
        for s in range(len(self.machine.next)):
            found, p = [], s
            while p > 0:
                if p in whole:
                    found.append(whole[p])
                p = self.machine.link[p]
            self.suffixes.append(tuple(found))

    def walk(self, ids: list[int], first: int) -> tuple[list, list]:
        """Places (start, phrase) and long matches (start, stop, state) of a run of vocabulary words that begins at ``first``."""
        nxt, link, length, suffixes, long = self.machine.next, self.machine.link, self.machine.length, self.suffixes, self.long
        state, n, places, matches = 0, 0, [], []
        for k, w in enumerate(ids, first):
            to = nxt[state].get(w)
            if to is None:
                if n >= long:
                    matches.append((k - n, k, state))
                while state and to is None:
                    state = link[state]
                    to = nxt[state].get(w)
                n = length[state]
            if to is None:
                state = n = 0
                continue
            state, n = to, n + 1
            for p in suffixes[state]:
                if n >= self.phrase_length[p]:
                    places.append((k + 1 - self.phrase_length[p], p))
        if n >= long:
            stop = first + len(ids)
            matches.append((stop - n, stop, state))
        return places, matches

    def chain(self, matches: list) -> dict[int, tuple[float, int, int]]:
        """Of each template, its best chain: (share of the template, first word, end word)."""
        by: dict[int, list] = {}
        for start, stop, state in matches:
            for t, places in self.machine.ends[state].items():
                if t >= 0:
                    by.setdefault(t, []).extend((start, stop, k + 1 - (stop - start), k + 1) for k in sorted(places))
        best = {}
        for t, found in by.items():
            top, open_ = (0, 0, 0), []  # open_: (covered, first word, stop, stop in the template) of chains within the gap
            for start, stop, t_start, t_stop in found:
                open_ = [c for c in open_ if start - c[2] <= self.gap]
                covered, first = stop - start, start
                for c in open_:
                    shared = max(0, c[2] - start, c[3] - t_start)
                    if c[3] < t_stop and c[0] + stop - start - shared > covered and shared < stop - start:
                        covered, first = c[0] + stop - start - shared, c[1]
                open_.append((covered, first, stop, t_stop))
                top = max(top, (covered, -first, stop))
            best[t] = (min(1.0, top[0] / self.template_length[t]), -top[1], top[2])
        return best

    def scan(self, ids: np.ndarray, starts: list[int], stops: list[int]) -> tuple:
        """One text's row, from the runs of vocabulary words of it (``ids`` by place in the text)."""
        places, matches = [], []
        for a, b in zip(starts, stops, strict=True):
            p, m = self.walk(ids[a:b].tolist(), a)
            places += p
            matches += m
        best = self.chain(matches)
        base = {self.phrases[p][1] for _, p in places}
        spans = [(self.templates[t][0], a, b, c) for t, (c, a, b) in sorted(best.items()) if c >= self.enough]
        score = max([float(bool(base)), *(c for c, _, _ in best.values())])
        starts_ = [s for s, _ in places]
        return len(places), min(starts_, default=None), max(starts_, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})), score, spans


def _scan(batches: Iterator[pa.RecordBatch], options: tuple) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(*options)
    vocabulary = scanner.vocabulary
    coarse = np.zeros(1 << 20, bool)
    coarse[(vocabulary >> U64(44)).astype(np.int64)] = True
    empty = (0, None, None, "", "", 0.0, [])
    for batch in batches:
        for i, j, buf, offsets in blocks(batch):
            word, at = words(buf, offsets, ALNUM)
            maybe = np.flatnonzero(coarse[(word >> U64(44)).astype(np.int64)])
            k = np.minimum(np.searchsorted(vocabulary, word[maybe]), len(vocabulary) - 1)
            hit = vocabulary[k] == word[maybe]
            place, ids = maybe[hit], k[hit]
            text = np.searchsorted(at, place, side="right") - 1
            new = np.ones(len(place) + 1, bool)
            new[1:-1] = (np.diff(place) > 1) | (np.diff(text) > 0)
            bound = np.flatnonzero(new)
            size = np.diff(bound)
            runs: dict[int, list] = {}
            for a, n in zip(bound[:-1][size >= scanner.shortest].tolist(), size[size >= scanner.shortest].tolist(), strict=True):
                runs.setdefault(int(text[a]), []).append((a, n))
            rows = []
            for t in range(j - i):
                if t not in runs:
                    rows.append(empty)
                    continue
                own = np.zeros(int(at[t + 1] - at[t]), np.int64)
                starts, stops = [], []
                for a, n in runs[t]:
                    s = int(place[a] - at[t])
                    own[s : s + n] = ids[a : a + n]
                    starts.append(s)
                    stops.append(s + n)
                rows.append(scanner.scan(own, starts, stops))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(np.diff(at)), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.float64()),
                 pa.array([[dict(zip(("label", "start", "stop", "covered"), s, strict=True)) for s in x] for x in cols[6]], pa.list_(SPAN))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, long: int = 4, gap: int = 12, enough: float = 0.75) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts all places of the phrases, also those that overlap; first_word and last_word are the
    smallest and largest start (null without places). labels are those of phrases and of templates
    covered to ``enough``; spans tell where. score is the largest share of a phrase or template that is
    covered. Null and empty texts have no words. Rows with the same or a null doc_id stay apart.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(Task(_scan, options=(phrases, templates, long, gap, enough)), FOUND)
