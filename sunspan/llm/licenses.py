"""License scans by a positional index of rare words.

Licence texts and phrases are templates: words, the share of them that has to be found, and how far a word may be from
its place. An index has postings (template, position) for each template's rarest words, by how many of all documents
have them; so many that a text with the asked share of words must have several of them in place. A file's words with
postings vote for the offset at which the template would start, offsets with enough different votes are verified over
all words of the template, and its mandatory key phrases must stand inside.

Whole phrases are templates too (every word, in its place), so what a phrase search finds comes from the same index.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunspan.llm._arrow import add_columns, release, slices, texts
from sunspan.llm._words import PUNCTUATION, Words

#: Documents of a batch are kept apart by so much in the numbers of offsets.
APART = 1 << 36
#: Pairs of an offset and a template word that are compared at once.
COMPARED = 1 << 20


class Template(NamedTuple):
    """label: what is reported; text; least: share of its words to be found; slack: words that each may be off its place;
    keys: phrases that must stand inside; phrase: whether it counts as a plain phrase (base)."""

    label: str
    text: str
    least: float = 1.0
    slack: int = 0
    keys: tuple[str, ...] = ()
    phrase: bool = False


#: Phrases whose places are reported as base.
PHRASES = (
    Template("mit", "under the mit license", phrase=True),
    Template("apache-2", "apache license version 2", phrase=True),
    Template("cc-by-nc", "cc by nc", phrase=True),
)

_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_REDISTRIBUTION = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_ENDORSE = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_FREE = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0} as published by the free software foundation either version {1} of the license or at your option any later version"

#: Published licence texts and the statements by which works name their licence (fixed values).
TEMPLATES = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _WARRANTY,
        0.8, 8, ("permission is hereby granted free of charge", "without warranty of any kind"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        0.8, 8, ("with or without fee is hereby granted", "disclaims all warranties"),
    ),
    Template("bsd", _REDISTRIBUTION, 0.8, 8, ("redistribution and use in source and binary forms", "list of conditions")),
    Template("bsd-3-clause", _REDISTRIBUTION + " " + _ENDORSE, 0.85, 8, ("redistribution and use in source and binary forms", "endorse or promote products")),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone "
        "to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        0.8, 8, ("without any express or implied warranty", "redistribute it freely"),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
        0.8, 8, ("free and unencumbered software", "public domain"),
    ),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        0.8, 8, ("apache license version 2", "in compliance with the license"),
    ),
    Template("gpl-2", _FREE.format("general public license", "2"), 0.85, 6, ("gnu general public license", "either version 2 of the license")),
    Template("gpl-3", _FREE.format("general public license", "3"), 0.85, 6, ("gnu general public license", "either version 3 of the license")),
    Template("lgpl", _FREE.format("lesser general public license", "2 1"), 0.85, 6, ("gnu lesser general public license",)),
    Template("agpl-3", _FREE.format("affero general public license", "3"), 0.85, 6, ("gnu affero general public license",)),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
        0.8, 6, ("mozilla public license v 2",),
    ),
    Template("gpl", "licensed under the gnu general public license", 1.0, 0),
    Template("gpl", "under the terms of the gnu general public license", 1.0, 0),
    Template("lgpl", "under the gnu lesser general public license", 1.0, 0),
    Template("agpl", "under the gnu affero general public license", 1.0, 0),
    Template("bsd", "licensed under the bsd license", 1.0, 0),
    Template("mpl-2", "mozilla public license version 2", 1.0, 0),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", 0.9, 2, ("creative commons attribution",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", 0.9, 2, ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", 0.9, 2, ("creative commons attribution noncommercial",)),
)


class Rule(NamedTuple):
    """A template with its words as numbers, of which the rarest are anchors and so many must vote for an offset."""

    label: str
    ids: np.ndarray
    need: int
    slack: int
    keys: list[int]
    votes: int
    phrase: bool


class Index:
    """Postings of the rarest words of templates; key phrases are rules of their own that are not reported."""

    def __init__(self, templates: tuple[Template, ...], found_in: dict[str, int]):
        split = {t: t.text.split() for t in templates}
        inner = dict.fromkeys(k for t in templates for k in t.keys)
        self.vocabulary = sorted({w for ws in split.values() for w in ws} | {w for k in inner for w in k.split()})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        rarity = np.array([found_in.get(w, 0) for w in self.vocabulary])
        self.rules: list[Rule] = []
        phrases = {k: i for i, k in enumerate(inner)}
        postings: list[tuple[int, int, int]] = []
        for t in [Template("", k) for k in inner] + list(templates):
            ids = np.array([number[w] for w in t.text.split()])
            need = max(1, int(np.ceil(t.least * len(ids) - 1e-9)))
            votes = max(1, need // 8)
            anchors = np.lexsort((np.arange(len(ids)), rarity[ids]))[: len(ids) - need + votes]
            postings += [(int(ids[j]), len(self.rules), int(j)) for j in anchors]
            self.rules.append(Rule(t.label, ids, need, t.slack, [phrases[k] for k in t.keys], votes, t.phrase))
        postings.sort()
        self.rule, self.place = (np.array([p[k] for p in postings], dtype=np.int64) for k in (1, 2))
        self.first = np.searchsorted(np.array([p[0] for p in postings]), np.arange(len(self.vocabulary) + 1))

    def numbers(self, words: Words) -> np.ndarray:
        """The number of each word in the vocabulary, -1 where it is not in it."""
        codes, different = words.codes()
        known = pc.fill_null(pc.index_in(different, value_set=pa.array([w.encode() for w in self.vocabulary], pa.large_binary())), -1)
        return known.to_numpy(zero_copy_only=False).astype(np.int64)[codes]

    def offsets(self, words: Words, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each rule the offsets, as document * APART + words from its start, that enough different anchors vote for."""
        at = np.flatnonzero(ids >= 0)
        low, high = self.first[ids[at]], self.first[ids[at] + 1]
        each = np.repeat(np.arange(len(at)), high - low)
        entry = np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[each]
        at, rule, place = at[each], self.rule[entry], self.place[entry]
        key = words.doc[at] * APART + (at - words.first[words.doc[at]]) - place
        order = np.lexsort((key, place, rule))
        key, place, rule = key[order], place[order], rule[order]
        bounds = np.searchsorted(rule, np.arange(len(self.rules) + 1))
        for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if a == b:
                yield r, key[:0]
                continue
            slack, k, j = self.rules[r].slack, key[a:b], place[a:b]
            new = np.ones(b - a, dtype=bool)  # offsets within reach of one anchor word are one interval
            new[1:] = (j[1:] != j[:-1]) | (k[1:] - k[:-1] > 2 * slack + 1)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], b - a) - 1
            edge = np.concatenate([k[starts] - slack, k[ends] + slack + 1])
            turn = np.repeat([1, -1], len(starts))
            order = np.argsort(edge, kind="stable")
            edge, votes = edge[order], np.cumsum(turn[order])
            good = np.flatnonzero((votes[:-1] >= self.rules[r].votes) & (edge[1:] > edge[:-1]))
            size = edge[good + 1] - edge[good]
            yield r, np.repeat(edge[good] - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def shares(self, words: Words, ids: np.ndarray, rule: Rule, offsets: np.ndarray) -> np.ndarray:
        """How many words of the rule each offset has in their places, or within its slack of them."""
        out = np.zeros(len(offsets), dtype=np.int64)
        step = max(1, COMPARED // len(rule.ids))
        for a in range(0, len(offsets), step):
            doc = (offsets[a : a + step] + APART // 2) // APART
            want = (offsets[a : a + step] - doc * APART)[:, None] + np.arange(len(rule.ids))[None, :]
            first, count = words.first[doc][:, None], words.counts[doc][:, None]
            hit = np.zeros(want.shape, dtype=bool)
            for d in range(-rule.slack, rule.slack + 1):
                inside = (want + d >= 0) & (want + d < count)
                hit |= inside & (ids[np.where(inside, first + want + d, 0)] == rule.ids[None, :])
            out[a : a + step] = hit.sum(axis=1)
        return out

    def scan(self, words: Words) -> list[list[dict]]:
        """Places of each document: label, start and end (words), share and whether it is a phrase; by start and label."""
        out: list[list[dict]] = [[] for _ in words.counts]
        if not len(words.starts):
            return out
        ids = self.numbers(words)
        places: dict[int, np.ndarray] = {}
        for r, offsets in self.offsets(words, ids):
            rule = self.rules[r]
            hits = self.shares(words, ids, rule, offsets) if len(offsets) else offsets
            offsets, hits = offsets[hits >= rule.need], hits[hits >= rule.need]
            if not rule.label:
                places[r] = offsets
                continue
            for k in rule.keys:
                if len(offsets):
                    low = np.searchsorted(places[k], offsets - rule.slack)
                    high = np.searchsorted(places[k], offsets + len(rule.ids) + rule.slack - len(self.rules[k].ids), side="right")
                    offsets, hits = offsets[high > low], hits[high > low]
            if not len(offsets):
                continue
            runs = np.ones(len(offsets), dtype=bool)
            runs[1:] = (offsets[1:] - offsets[:-1] > 1) if rule.slack else True
            run = np.cumsum(runs)
            best = np.lexsort((offsets, -hits, run))[np.flatnonzero(runs)]  # of neighbouring offsets the best, then the first
            for o, h in zip(offsets[best].tolist(), hits[best].tolist(), strict=True):
                doc = (o + APART // 2) // APART
                start = o - doc * APART
                end = min(start + len(rule.ids), int(words.counts[doc]))
                out[doc].append({"label": rule.label, "start": max(0, start), "end": end, "share": h / len(rule.ids), "phrase": rule.phrase})
        for found in out:
            found.sort(key=lambda s: (s["start"], s["label"], s["end"]))
        return out


def _words(batch: pa.RecordBatch, text_col: str) -> Words:
    return Words([t.encode() for t in texts(batch, text_col)], lower=True, gaps=PUNCTUATION)


def found_in(df: DataFrame, text_col: str, templates: tuple[Template, ...] = PHRASES + TEMPLATES) -> dict[str, int]:
    """How many rows of ``df`` have each word of the templates; the words of the templates bound what is fetched.

    Null and empty texts have no words, repeated rows count again, whole texts count; an empty table gives nothing.
    """
    index = Index(templates, {})
    many = len(index.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(many, dtype=np.int64)
        for batch in slices(batches):
            words = _words(batch, text_col)
            if len(words.starts):
                ids = index.numbers(words)
                seen = np.unique(words.doc[ids >= 0] * many + ids[ids >= 0])
                total += np.bincount(seen % many, minlength=many)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], names=["word", "n"])
        release()

    counts = df.select(F.col(f"`{text_col}`")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {index.vocabulary[r["word"]]: r["n"] for r in counts.collect()}


PLACES = T.ArrayType(
    T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("share", T.DoubleType()),
            T.StructField("phrase", T.BooleanType()),
        ]
    )
)
_ARROW = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64()), ("phrase", pa.bool_())]))


def find_licenses(df: DataFrame, text_col: str = "text", places_col: str = "license_places", words_col: str = "n_words", templates: tuple[Template, ...] = PHRASES + TEMPLATES) -> DataFrame:
    """``df`` with ``words_col`` and ``places_col``: array of (label, start, end, share, phrase) by start and label.

    start and end count words from 0, end exclusive. Null and empty texts have no words and an empty array. Rows are
    scanned one by one, whole texts whatever their length, so repeated rows get equal places; overlapping places are all
    reported, of neighbouring offsets of one template the best, then the first; input columns of these names are
    replaced; an empty table stays empty. Words are runs of digits, letters and all that is not ASCII, A-Z lower-cased.
    How rare a word is comes from all rows of ``df``; it decides which postings the index has, never what is found.
    """
    index = Index(templates, found_in(df, text_col, templates))

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        words = _words(batch, text_col)
        return {words_col: pa.array(words.counts, pa.int64()), places_col: pa.array(index.scan(words), _ARROW)}

    return add_columns(df, fn, [T.StructField(words_col, T.LongType()), T.StructField(places_col, PLACES)], [text_col])
