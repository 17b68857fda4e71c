"""Licence scans by matching statistics over a generalised suffix automaton of licence wordings.

All templates share one automaton over word ids. A document's words stream through it; after each word the length of
the longest run that ends there and occurs in a template is known. Runs of ``shortest`` words or more that cannot be
extended are mapped to their places in templates and chained, in order and with small gaps on both sides, into spans;
a template whose words a chain covers to ``covered`` or more gives its label.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed_texts

#: Phrases that are always reported, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Usual wordings of notices and grants, by label.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]
_NOT_WORD = bytes(c if c > 127 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for c in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII characters that are neither letters nor digits."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.lower().translate(_NOT_WORD).split()


class SuffixAutomaton:
    """Of several sequences of ids. ``ends[state]``: (sequence, place after the last id) where its strings occur."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for s, ids in enumerate(sequences):
            last = 0
            for i, c in enumerate(ids):
                last = self._extend(last, c)
                self.ends[last].append((s, i + 1))
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]
        self.ends = [sorted(set(e)) for e in self.ends]

    def _state(self, size: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.size.append(size)
        self.ends.append([])
        return len(self.size) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the strings of ``q`` that are no longer than ``p`` and c; ``q`` itself if all are."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        new, p = self._state(self.size[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest match) after each id."""
        state = size = 0
        for c in ids:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            yield state, size


class Scanner:
    """Templates, their automaton, and the phrases."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES,
                 shortest: int = 3, gap: int = 8, covered: float = 0.8):
        self.labels = [label for label, _ in templates]
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        self.shortest, self.gap, self.covered = shortest, gap, covered
        texts = [words_of(t) for _, t in templates]
        every = {w for ws in texts for w in ws} | {w for p, _ in self.phrases for w in p}
        self.vocab = {w: i for i, w in enumerate(sorted(every), 1)}
        self.templates = [[self.vocab[w] for w in ws] for ws in texts]
        self.automaton = SuffixAutomaton(self.templates)
        # a long match begins with a run of the shortest length; places of such runs find the documents to stream
        runs = {tuple(t[i : i + shortest]) for t in self.templates for i in range(len(t) - shortest + 1)}
        self.runs = np.unique(np.array([self._code(np.array(r))[0] for r in runs], np.int64))

    def _code(self, ids: np.ndarray) -> np.ndarray:
        size = max(0, len(ids) - self.shortest + 1)
        out = np.zeros(size, np.int64)
        for k in range(self.shortest):
            out = out * (len(self.vocab) + 1) + ids[k : k + size]
        return out

    def base(self, ids: np.ndarray) -> tuple[list[int], list[str]]:
        """Places where a phrase's words stand, and the labels of those phrases."""
        places, labels = [], []
        for words, label in self.phrases:
            size = len(ids) - len(words) + 1
            if size > 0:
                at = np.ones(size, bool)
                for k, w in enumerate(words):
                    at &= ids[k : k + size] == self.vocab[w]
                if at.any():
                    places += np.flatnonzero(at).tolist()
                    labels.append(label)
        return places, labels

    def template_spans(self, ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, covered share) of the chains that cover a template."""
        if not len(self.runs) or not np.isin(self._code(ids), self.runs).any():
            return []
        chains: dict[int, list[int]] = {}  # by template: document start, end, template end, words covered
        found: list[tuple[str, int, int, float]] = []

        def close(t: int) -> None:
            start, end, _, words = chains.pop(t)
            if (share := words / len(self.templates[t])) >= self.covered:
                found.append((self.labels[t], start, end - 1, share))

        stats = deque(self.automaton.statistics(ids.tolist()))
        stats.append((0, 0))
        state, size = stats.popleft()
        for end, (follow, longer) in enumerate(stats, 1):
            if size >= self.shortest and longer <= size:  # it can't be extended
                for t, stop in self.automaton.ends[state]:
                    if stop < size:
                        continue
                    begin = end - size
                    c = chains.get(t)
                    if c and not (-size < begin - c[1] <= self.gap and -size < stop - size - c[2] <= self.gap and stop > c[2]):
                        close(t)
                        c = None
                    if c:
                        c[3] += min(size, stop - c[2], end - c[1])
                        c[1], c[2] = end, stop
                    else:
                        chains[t] = [begin, end, stop, size]
            state, size = follow, longer
        for t in list(chains):
            close(t)
        return found

    def scan(self, text: str | bytes | None) -> dict:
        words = words_of(text)
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.int64, len(words))
        if not ids.any():
            return {"n_words": len(words), "places": [], "base": [], "spans": []}
        places, base = self.base(ids)
        return {"n_words": len(words), "places": places, "base": base, "spans": self.template_spans(ids)}


def scan(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found): one row for each row.

    ``found`` lists (label, start, end, share) of covered templates, in words from 0, both ends inclusive; score is the
    largest share, 0 without any. Null and empty texts have no words and null places. Repeated rows are scanned each.
    An empty table gives no rows.
    """
    df = keyed_texts(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()
    made = scanner or Scanner()
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            text = text.cast(pa.binary() if text.type == pa.string() else pa.large_binary())
            got = [made.scan(t.as_py()) for t in text]
            ints = {
                "n_words": [g["n_words"] for g in got],
                "n_base": [len(g["places"]) for g in got],
                "first_word": [min(g["places"], default=None) for g in got],
                "last_word": [max(g["places"], default=None) for g in got],
            }
            strings = {
                "base_labels": [",".join(sorted(set(g["base"]))) for g in got],
                "labels": [",".join(sorted({*g["base"], *(s[0] for s in g["spans"])})) for g in got],
            }
            score = [min(1.0, max((s[3] for s in g["spans"]), default=0.0)) for g in got]
            found = [[dict(zip(("label", "start", "end", "share"), s)) for s in g["spans"]] for g in got]
            cols = [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in ints.values())]
            cols += [*(pa.array(x, pa.string()) for x in strings.values()), pa.array(score, pa.float64()), pa.array(found, span)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *ints, *strings, "score", "found"])

    return df.mapInArrow(
        run,
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, found array<struct<label:string,start:bigint,end:bigint,share:double>>",
    )
