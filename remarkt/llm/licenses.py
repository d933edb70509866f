"""License scans with a generalised suffix automaton of licence texts.

The automaton of all templates' words is built once. Each file streams through it and gives, at every word, the
longest run of words that some template has too (matching statistics). Long runs are chained in the order of the
template into covered spans; a template is found when the chain covers enough of it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from importlib import resources
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import sent
from .words import ALNUM, LOWER, Texts, per_text

#: Phrases whose places are counted, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Notices of public licences, by label. Words are compared in lower case without punctuation.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl-3", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("all-rights-reserved", "All rights reserved"),
)

def bodies() -> tuple[tuple[str, str], ...]:
    """(label, text) of the full licences in the package's folder licence_texts."""
    files = sorted((f for f in resources.files(__package__).joinpath("licence_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return tuple((f.name[:-4], f.read_text(encoding="utf-8")) for f in files)


#: Words of a run that counts (shorter templates count when whole); share of a template that its chain must cover; words of text that may lie between two runs of a chain.
MIN_RUN, COVER, GAP = 4, 0.8, 12

SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label: string, first: bigint, last: bigint, cover: double>>"


def plain_words(text: str) -> list[str]:
    texts = Texts(pa.array([text]))
    words = texts.words(ALNUM, LOWER)
    raw = LOWER[texts.data].tobytes()
    return [raw[a:b].decode() for a, b in zip(words.starts, words.ends, strict=True)]


class Automaton:
    """States of the generalised suffix automaton: next, link, length, and the (template, end) places of each state whose runs are of least words or more."""

    def __init__(self, templates: list[list[int]], least: int = 1):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        places: list[set[tuple[int, int]]] = [set()]
        for t, words in enumerate(templates):
            last = 0
            for end, word in enumerate(words):
                last = self._add(last, word, places)
                places[last].add((t, end))
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            if self.length[self.link[state]] >= least:
                places[self.link[state]] |= places[state]
        self.places = [sorted(p) for p in places]

    def _state(self, length: int, places: list, next_: dict[int, int], link: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        places.append(set())
        return len(self.length) - 1

    def _add(self, last: int, word: int, places: list) -> int:
        if word in self.next[last]:
            found = self.next[last][word]
            return found if self.length[found] == self.length[last] + 1 else self._split(last, word, found, places)
        new = self._state(self.length[last] + 1, places, {}, 0)
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at != -1:
            found = self.next[at][word]
            self.link[new] = found if self.length[found] == self.length[at] + 1 else self._split(at, word, found, places)
        return new

    def _split(self, at: int, word: int, found: int, places: list) -> int:
        copy = self._state(self.length[at] + 1, places, dict(self.next[found]), self.link[found])
        self.link[found] = copy
        while at != -1 and self.next[at].get(word) == found:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """At each word: the state and the length of the longest run ending there that a template has."""
        state = length = 0
        found = []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            else:
                length = 0
            found.append((state, length))
        return found


class Scanner:
    def __init__(self, templates, phrases=PHRASES, min_run: int = MIN_RUN, cover: float = COVER, gap: int = GAP):
        split = [plain_words(t) for _, t in templates]
        names = sorted({w for words in split for w in words} | {w for p, _ in phrases for w in p.split()})
        column = pa.array(names)
        hashes = Texts(column).words(ALNUM, LOWER).hashes()
        order = np.argsort(hashes)
        self.known, self.ids = hashes[order], order
        number = {w: i for i, w in enumerate(names)}
        self.templates = [[number[w] for w in words] for words in split]
        self.labels = [label for label, _ in templates]
        self.min_run, self.cover, self.gap = min_run, cover, gap
        self.least = min(min_run, min(map(len, self.templates)))
        self.automaton = Automaton(self.templates, self.least)
        n = self.n = len(names)
        self.pairs = np.zeros((n + 1, n + 1), bool)
        for words in self.templates:
            self.pairs[words[:-1], words[1:]] = True
        self.phrases = [([number[w] for w in p.split()], label) for p, label in phrases]

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words; those that no template has are n."""
        at = np.searchsorted(self.known, hashes)
        at[at == self.n] = 0
        return np.where(self.known[at] == hashes, self.ids[at], self.n)

    def runs(self, words: list[int], base: int) -> list[tuple[int, int, int, int]]:
        """(template, place there, place in the text, words) of each longest run that counts."""
        stats, found = self.automaton.statistics(words), []
        for i, (state, length) in enumerate(stats):
            if length < self.least or i + 1 < len(stats) and stats[i + 1][1] == length + 1:
                continue
            for template, end in self.automaton.places[state]:
                if length >= min(self.min_run, len(self.templates[template])):
                    found.append((template, end - length + 1, base + i - length + 1, length))
        return found

    def chains(self, runs: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, share of the template) of each chain that covers enough: runs in the order of the template, near each other in the text.

        Of the chains that begin with a run the one that covers most; words of overlaps count once. Stretches of text
        that runs lie on begin and end in the same order, so only the last few are within reach of the next one; of a
        stretch's places in the template the best below a bound is kept, so a run looks for its predecessor by
        bisection and at the few places that it overlaps.
        """
        of: dict[int, dict[tuple[int, int], list[int]]] = {}
        for template, there, here, length in runs:
            of.setdefault(template, {}).setdefault((here, length), []).append(there)
        found = []
        for template, stretches in sorted(of.items()):
            size, own, best = len(self.templates[template]), [], []  # for each run: words that the best chain ending there covers, and the run it begins with
            near: deque[tuple[int, int, list[int], list[tuple[int, int]], list[tuple[int, int]]]] = deque()
            for (here, length), places in sorted(stretches.items()):
                places.sort()
                while near and here - near[0][0] - near[0][1] > self.gap:
                    near.popleft()
                tops = []
                for there in places:
                    top = (length, -len(own))
                    own.append((there, here, length))
                    for at, words, before, covered, upto in near:
                        # places at least step words before there lose only the words that overlap in the text
                        step = min(words, here - at)
                        k = bisect_right(before, there - step)
                        if k and length > words - step:
                            top = max(top, (upto[k - 1][0] + length - words + step, upto[k - 1][1]))
                        for j in range(k, bisect_left(before, there)):
                            if (gain := length - words + there - before[j]) > 0:
                                top = max(top, (covered[j][0] + gain, covered[j][1]))
                    tops.append(top)
                best += [(covered, -root) for covered, root in tops]
                near.append((here, length, places, tops, list(accumulate(tops, max))))
            ends: dict[int, int] = {}
            for i, (covered, root) in enumerate(best):
                if covered >= self.cover * size and (root not in ends or covered > best[ends[root]][0]):
                    ends[root] = i
            found += [(self.labels[template], own[root][1], own[i][1] + own[i][2] - 1, min(1.0, best[i][0] / size)) for root, i in sorted(ends.items())]
        return found

    def __call__(self, column: pa.Array) -> dict[str, pa.Array]:
        texts = Texts(column)
        words = texts.words(ALNUM, LOWER)
        ids = self.encode(words.hashes())
        owner = words.text_of()
        same = owner[1:] == owner[:-1]
        joined = self.pairs[ids[:-1], ids[1:]] & same if words.n > 1 else np.zeros(0, bool)
        # every run of words in which each neighbouring pair stands in a template; longer matches lie inside one
        edge = np.diff(np.concatenate(([0], joined.astype(np.int8), [0])))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        long = ends - begins >= self.least
        found: list[list] = [[] for _ in range(texts.n)]
        for a, b in zip(begins[long], ends[long], strict=True):
            text = owner[a]
            found[text] += self.runs(ids[a:b].tolist(), int(a - words.first[text]))
        n_base, first, last = np.zeros(texts.n, np.int64), np.full(texts.n, np.iinfo(np.int64).max), np.full(texts.n, -1)
        base: list[set] = [set() for _ in range(texts.n)]
        for phrase, label in self.phrases:
            at = words.windows(len(phrase))
            for k, word in enumerate(phrase):
                at = at[ids[at + k] == word]
            text = owner[at]
            np.add.at(n_base, text, 1)
            np.minimum.at(first, text, at - words.first[text])
            np.maximum.at(last, text, at - words.first[text])
            for i in np.unique(text):
                base[i].add(label)
        spans = [self.chains(r) if r else [] for r in found]
        none = n_base == 0
        kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))
        return {
            "n_words": pa.array(words.counts), "n_base": pa.array(n_base), "first_word": pa.array(first, mask=none), "last_word": pa.array(last, mask=none),
            "base_labels": pa.array([",".join(sorted(b)) for b in base]), "labels": pa.array([",".join(sorted(b | {s[0] for s in own})) for b, own in zip(base, spans, strict=True)]),
            "score": pa.array([1.0 if b else max((s[3] for s in own), default=0.0) for b, own in zip(base, spans, strict=True)]),
            "spans": pa.array([[dict(zip(("label", "first", "last", "cover"), s, strict=True)) for s in own] for own in spans], kind),
        }


def license_scan(docs: DataFrame, templates=None, phrases=PHRASES, min_run: int = MIN_RUN, cover: float = COVER, gap: int = GAP) -> DataFrame:
    """One row for each row of docs (doc_id, text): places of the phrases, labels, and the template spans found.

    templates: (label, text) pairs; the notices here and the full licences of the package where none are given.
    score: 1 where a phrase stands, else the largest share of a template that a chain covers, else 0. Null and empty
    texts have no words and no labels; repeated rows are each answered; an empty table gives an empty result; other
    columns are not read. One pass without a shuffle; the automaton's size is that of the templates.
    """
    held = sent(docs.sparkSession, Scanner(templates or (*TEMPLATES, *bodies()), phrases, min_run, cover, gap))
    return per_text(docs, lambda column: held.value(column), SCHEMA)


def license_report(docs: DataFrame) -> DataFrame:
    """``license_scan``, where nulls, repeats and empty tables are stated, without the spans. Labels are sorted; of equal shares no one counts more."""
    return license_scan(docs).drop("spans")
