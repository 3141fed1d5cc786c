"""License scan with a positional rare-token index.

The index holds the words of licence notices and of the base phrases with their places (postings). Document
frequencies of these words are counted over all documents. In each file the licence words that it holds are looked up
from the highest inverse frequency on, for each template until what is left of its words can't reach the least score;
so no alignment is missed. Postings are intersected by relative position (place in the file less place in the
template), the aligned words are weighed, and a label counts only if the template's mandatory key phrases stand near
the alignment. A base phrase is a template that must be aligned in full, so all its places are found.

Defined results: null or empty text has no words, no labels and score 0; equal rows are judged alike; an empty
table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import column, map_text, record, text_buffer
from .words import ALNUM, ALNUM_MAP, Lexicon, Words

BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: label, notice, mandatory key phrases.
TEMPLATES = [
    ("agpl", "this program is licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("all-rights-reserved", "copyright all rights reserved", ["all rights reserved"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("artistic", "distributed under the terms of the artistic license 2 0", ["artistic license"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache org licenses license 2 0"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("bsd", "released under the bsd license", ["bsd license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc0", "released under cc0 1 0 universal public domain dedication", ["cc0"]),
    ("eclipse", "made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ["gnu general public license"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["to deal in the software without restriction"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", ["anyone is free to copy modify publish use compile sell or distribute this software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("zlib", "released under the zlib license", ["zlib license"]),
]
#: Least weight of aligned words, as a share of the template's.
LEAST_SCORE = 0.6
#: A key phrase may start this many words before or after its place in the alignment.
SLACK = 2


#: Candidate alignments that are weighed at once.
CHUNK = 1 << 14


def place_of(words: list[str], key: str) -> int:
    """Where a key phrase stands in a template."""
    k = key.split()
    return next((i for i in range(len(words)) if words[i : i + len(k)] == k), 0)


def inverse_frequencies(docs: DataFrame, text: str) -> tuple[list[str], np.ndarray]:
    """The licence words, and the logarithms of their inverse frequencies over all documents. One number for each
    word goes to the driver."""
    vocabulary = sorted({w for p, _ in BASE for w in p.split()} | {w for _, t, keys in TEMPLATES for x in (t, *keys) for w in x.split()})
    lexicon, m = Lexicon([w.encode() for w in vocabulary]), len(vocabulary)

    def kernel():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            buf, offs = text_buffer(part.column("__text"))
            words = Words(buf, offs, ALNUM, ALNUM_MAP)
            ids = lexicon.find(words, ALNUM_MAP[buf])
            at = np.flatnonzero(ids >= 0)
            rows = np.searchsorted(words.doc, at, "right") - 1
            df = np.bincount(np.unique(rows * m + ids[at]) % m, minlength=m)
            return record(word=(np.append(np.arange(m), -1), pa.int32()), n=(np.append(df, part.num_rows), pa.int64()))

        return work

    counts = map_text(docs.select(column(text).cast("string").alias("__text")), "__text", kernel, "word int, n bigint")
    found = {r["word"]: r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return vocabulary, np.array([math.log((1 + found.get(-1, 0)) / (1 + found.get(k, 0))) + 1e-9 for k in range(m)])


class Template:
    """Codes, weights and key phrases of a notice, and its distinct words from the rarest on."""

    def __init__(self, label: str, notice: str, keys: list[str], least: float, ids: dict[str, int], idf: np.ndarray):
        words = notice.split()
        self.label, self.codes = label, np.array([ids[w] for w in words])
        self.weights = idf[self.codes]
        self.least = least * self.weights.sum() - 1e-9
        self.keys = [(np.array([ids[w] for w in k.split()]), place_of(words, k)) for k in keys]
        self.needed = sorted({ids[w] for k in keys for w in k.split()})
        distinct = sorted(set(self.codes.tolist()), key=lambda c: (-idf[c], c))
        self.distinct = np.array(distinct)
        self.shares = np.array([self.weights[self.codes == c].sum() for c in distinct])
        self.places = {c: np.flatnonzero(self.codes == c) for c in distinct}

    def looked_up(self, present: np.ndarray) -> np.ndarray:
        """For rows with their licence words: which of the distinct words are looked up in the row."""
        there = present[:, self.distinct] * self.shares
        left = there.sum(axis=1)[:, None] - np.cumsum(there, axis=1) + there  # with this word and all rarer gone
        able = present[:, self.needed].all(axis=1)[:, None]
        return (there > 0) & (left >= self.least) & able

    def alignments(self, code: np.ndarray, doc: np.ndarray, present: np.ndarray, sorted_at: np.ndarray, bounds: np.ndarray):
        """(row, first place in the batch, weight) of all alignments that count. `sorted_at` are the places of
        licence words by word, `bounds` the ranges of each word there."""
        wanted = self.looked_up(present)
        rows, starts = [], []
        for k, c in enumerate(self.distinct.tolist()):
            if not wanted[:, k].any():
                continue
            at = sorted_at[bounds[c] : bounds[c + 1]]
            row = np.searchsorted(doc, at, "right") - 1
            use = wanted[row, k]
            for place in self.places[c].tolist():
                rows.append(row[use])
                starts.append(at[use] - place)
        if not rows:
            return
        # a start may lie before the batch, and the same one belongs to each row that reaches it
        pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(starts)]), axis=1)
        for a in range(0, pairs.shape[1], CHUNK):
            row, start = pairs[:, a : a + CHUNK]
            first, last = doc[row], doc[row + 1]

            def stands(at, want):
                inside = (at >= first) & (at < last)
                return inside & (code[np.where(inside, at, 0)] == want)

            weight = np.zeros(len(row))
            for j, (c, w) in enumerate(zip(self.codes.tolist(), self.weights.tolist())):
                weight += w * stands(start + j, c)
            good = weight >= self.least
            for key, place in self.keys:
                near = np.zeros(len(row), bool)
                for d in range(-SLACK, SLACK + 1):
                    one = good.copy()
                    for j, c in enumerate(key.tolist()):
                        one &= stands(start + place + d + j, c)
                    near |= one
                good &= near
            yield row[good], start[good], weight[good] / self.weights.sum()


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each document."""
    vocabulary, idf = inverse_frequencies(docs, text)
    ids = {w: k for k, w in enumerate(vocabulary)}
    lexicon, m = Lexicon([w.encode() for w in vocabulary]), len(vocabulary)
    base = [Template(label, phrase, [phrase], 1.0, ids, idf) for phrase, label in BASE]
    templates = [Template(label, notice, keys, LEAST_SCORE, ids, idf) for label, notice, keys in TEMPLATES]

    def kernel():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            n = part.num_rows
            buf, offs = text_buffer(part.column("__text"))
            words = Words(buf, offs, ALNUM, ALNUM_MAP)
            code, doc = lexicon.find(words, ALNUM_MAP[buf]), words.doc
            at = np.flatnonzero(code >= 0)
            at = at[np.argsort(code[at], kind="stable")]
            bounds = np.searchsorted(code[at], np.arange(m + 1))
            present = np.zeros((n, m), bool)
            present[np.searchsorted(doc, at, "right") - 1, code[at]] = True
            n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base_labels: list[set] = [set() for _ in range(n)]
            labels: list[set] = [set() for _ in range(n)]
            score = np.zeros(n)
            for template in base + templates:
                for row, start, weight in template.alignments(code, doc, present, at, bounds):
                    for r in np.unique(row).tolist():
                        labels[r].add(template.label)
                    np.maximum.at(score, row, np.minimum(weight, 1.0))
                    if template in base:  # aligned in full
                        np.add.at(n_base, row, 1)
                        np.minimum.at(first, row, start - doc[row])
                        np.maximum.at(last, row, start - doc[row])
                        score[row] = 1.0
                        for r in np.unique(row).tolist():
                            base_labels[r].add(template.label)
            none = n_base == 0
            join = lambda sets: [",".join(sorted(s)) for s in sets]
            return record(
                doc_id=(part.column("__id"), None),
                n_words=(words.counts, pa.int64()),
                n_base=(n_base, pa.int64()),
                first_word=(pa.array(first, pa.int64(), mask=none), None),
                last_word=(pa.array(last, pa.int64(), mask=none), None),
                base_labels=(join(base_labels), pa.string()),
                labels=(join(labels), pa.string()),
                score=(np.round(score, 6), pa.float64()),
            )

        return work

    kind = docs.schema[doc_id].dataType.simpleString()
    chosen = docs.select(column(doc_id).alias("__id"), column(text).cast("string").alias("__text"))
    return map_text(chosen, "__text", kernel, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
