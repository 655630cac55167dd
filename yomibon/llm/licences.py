"""Licence scans by a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a run of lines between blank ones; where its lines break makes no difference. It is read
sentence by sentence, and in a sentence the passages are looked at where word pairs of the templates
below stand, no more than REACH words apart; at least two pairs, as no template can be confirmed by
fewer. Features of a passage are its hashed word n-grams (one and two words) that occur in templates,
and its share of other words; a sparse logistic regression over the families and an unknown class is
trained on passages of the templates (whole, shortened, within other words) against passages of the
corpus and of scrambled template words. Its unknown class is calibrated on held-out examples: a family
needs the least probability that keeps the false share of unknown passages below FALSE_SHARE. A passage
that passes is confirmed if it holds CONTAINED of the word pairs of one template of that family.

Only a bounded sample of corpus passages trains (at most SAMPLE_PASSAGES different ones, first in the
order of their hashes, of about SAMPLE_ROWS documents), so the model does not depend on how rows are
dealt; every passage of every document is scanned, as arrays.

Defined results. Null, empty and wordless texts have no paragraphs and no licence. `licences` lists the
families of a document's confirmed passages, sorted, comma-joined; it is empty without one. Of families
that tie in probability the first by name counts. Rows that repeat a doc_id each get their result. A
very long text or line is scanned as a whole, in memory by itself. An empty table gives an empty result;
its model knows no corpus words. Extra columns are ignored and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import received, sent
from .language import sample

# Notices as they stand in documents, by family.
TEMPLATES = {
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "all-rights-reserved": ("All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without permission."),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0": ("Released under CC0 1.0 Universal, public domain dedication.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL version 2 or later.",
    ),
    "isc": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the LGPL version 3."),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the MPL 2.0."),
}

SAMPLE_ROWS, SAMPLE_PASSAGES = 2000, 4000
FALSE_SHARE = 0.001
CONTAINED = 0.6
#: Words between two known pairs of one passage, at most.
REACH = 8
ROUNDS, RATE, RIDGE = 400, 2.0, 1e-4


@dataclass
class Words:
    """The words of some texts: hashes, text of each, number of its paragraph and of its sentence; and the pairs of neighbours in a sentence, by their first word."""

    one: np.ndarray
    row: np.ndarray
    paragraph: np.ndarray
    sentence: np.ndarray
    two: np.ndarray
    first: np.ndarray


def read(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, rows = kernels.word_spans(data, offsets)
    one = kernels.word_hashes(kernels.LOWERED[data], starts, ends)
    space = (data == 32) | (data >= 9) & (data <= 13)
    stop = (data == 46) | (data == 33) | (data == 63)
    stop[:-1] &= space[1:]
    seen = lambda marks: np.concatenate([[0], np.cumsum(marks)])
    lines, stops = seen(data == 10), seen(stop)
    apart = rows[1:] != rows[:-1]
    blank = apart | (lines[starts[1:]] - lines[ends[:-1]] >= 2)
    ended = blank | (stops[starts[1:]] - stops[ends[:-1]] > 0)
    number = lambda breaks: np.concatenate([[0], np.cumsum(breaks)])[: len(one)]
    two = kernels.mix(one[:-1] * kernels.RADIX + one[1:])
    first = np.flatnonzero(~ended)
    return Words(one, rows, number(blank), number(ended), two[first], first)


def of_texts(texts: list[str]) -> Words:
    raw = [t.encode() for t in texts]
    return read(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))


@dataclass
class Passages:
    """Passages of some texts: text of each; the words and the pairs in them, each with its passage."""

    row: np.ndarray
    one: np.ndarray
    one_of: np.ndarray
    two: np.ndarray
    two_of: np.ndarray

    def pairs(self) -> list[np.ndarray]:
        bounds = kernels.grouped(self.two_of, len(self.row))
        return [self.two[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def passages(words: Words, pairs: np.ndarray) -> Passages:
    """Where pairs of the templates (sorted) stand: from the first to the last of a run of them."""
    at = np.minimum(np.searchsorted(pairs, words.two), len(pairs) - 1)
    known = words.first[pairs[at] == words.two]
    new = np.ones(len(known), bool)
    new[1:] = (np.diff(known) > REACH) | (words.sentence[known[1:]] != words.sentence[known[:-1]])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(known))
    held = end - begin >= 2
    low, high = known[begin[held]], known[end[held] - 1] + 1  # first and last word
    lengths = high - low + 1
    of = np.repeat(np.arange(len(low)), lengths)
    word = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + low[of]
    number = np.full(len(words.one) + 1, -1)
    number[word] = of
    number[high] = -2 - number[high]  # no pair of a passage begins at its last word
    two_of = number[words.first]
    inside = two_of >= 0
    return Passages(words.row[low], words.one[word], of, words.two[inside], two_of[inside])


@dataclass
class Model:
    families: list[str]
    vocabulary: np.ndarray  # sorted hashes of words and pairs
    known: np.ndarray  # sorted hashes of pairs
    weights: np.ndarray  # [vocabulary + 2, families + 1]; the last rows: share of other words, intercept
    least: float
    pairs: list[list[np.ndarray]]  # by family, by template

    def cells(self, found: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, column) of the known n-grams, once each, and the share of other words by passage."""
        keys, of = np.concatenate([found.one, found.two]), np.concatenate([found.one_of, found.two_of])
        at = np.minimum(np.searchsorted(self.vocabulary, keys), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == keys
        n = len(found.row)
        n_words = np.bincount(found.one_of, minlength=n)
        n_known = np.bincount(found.one_of[known[: len(found.one)]], minlength=n)
        cells = np.unique(of[known] * len(self.vocabulary) + at[known])
        return cells // len(self.vocabulary), cells % len(self.vocabulary), 1 - n_known / np.maximum(1, n_words)

    def probabilities(self, found: Passages) -> np.ndarray:
        """[passages, families + 1]."""
        row, column, other = self.cells(found)
        total = np.zeros((len(found.row), self.weights.shape[1]))
        np.add.at(total, row, self.weights[column])
        total += other[:, None] * self.weights[-2] + self.weights[-1]
        odds = np.exp(total - total.max(axis=1, keepdims=True)) if len(total) else total
        return odds / odds.sum(axis=1, keepdims=True)

    def confirmed(self, family: int, pairs: np.ndarray) -> float:
        """The largest share of a template's pairs that are among `pairs`."""
        return max(np.isin(t, pairs).mean() for t in self.pairs[family])


#: What the driver gets of a corpus passage.
PASSAGE = "passage long, one array<long>, two array<long>"


def gatherer(pairs: np.ndarray):
    """pairs: sorted hashes of the templates' pairs. Batches of texts -> their passages, by a hash of their words."""

    @kernels.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in kernels.pieces(batch.column(0)):
                found = passages(read(data, offsets), pairs)
                if len(found.row):
                    bounds = [kernels.grouped(of, len(found.row)).astype(np.int32) for of in (found.one_of, found.two_of)]
                    place = np.arange(len(found.one)) - np.repeat(bounds[0][:-1], np.diff(bounds[0]))
                    number = np.add.reduceat(kernels.mix(found.one + place.astype(np.uint64)), bounds[0][:-1])
                    lists = [pa.ListArray.from_arrays(pa.array(b), pa.array(x.view(np.int64))) for b, x in zip(bounds, (found.one, found.two), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(number.view(np.int64)), *lists], ["passage", "one", "two"])

    return run


def joined(lists: list[tuple[np.ndarray, np.ndarray]]) -> Passages:
    """Passages of their own from (words, pairs) lists."""
    flat = lambda k: np.concatenate([x[k] for x in lists]) if lists else np.zeros(0, np.uint64)
    of = lambda k: np.repeat(np.arange(len(lists)), [len(x[k]) for x in lists])
    return Passages(np.arange(len(lists)), flat(0), of(0), flat(1), of(1))


def split(found: Passages) -> list[tuple[np.ndarray, np.ndarray]]:
    bounds = kernels.grouped(found.one_of, len(found.row))
    return [(found.one[a:b], two) for a, b, two in zip(bounds, bounds[1:], found.pairs(), strict=False)]


def examples(model: Model, others: list[tuple[np.ndarray, np.ndarray]], rng: np.random.Generator) -> tuple[Passages, np.ndarray]:
    """Passages and their classes; the unknown class is the last."""
    loose = [f"x{k}" for k in range(500)]
    texts, classes = [], []
    for k, family in enumerate(model.families):
        for template in TEMPLATES[family]:
            own = template.split()
            for n in range(12):
                cut = own if n < 6 or len(own) < 8 else own[: max(6, int(len(own) * rng.uniform(0.75, 1)))]
                if n % 3 == 2 and len(cut) > 4:  # a word that is left out or another one
                    cut = list(cut)
                    cut[rng.integers(1, len(cut) - 1)] = rng.choice(loose)
                texts.append(" ".join([*rng.choice(loose, rng.integers(0, 2 + n)), *cut, *rng.choice(loose, rng.integers(0, 2 + n))]))
                classes.append(k)
    known = np.array([w.strip(".,;()") for f in model.families for t in TEMPLATES[f] for w in t.split()], object)
    pairs = [p for f in model.families for t in TEMPLATES[f] for p in zip(t.split(), t.split()[1:], strict=False)]
    n_families = len(model.families)
    for _ in range(1500):  # template words and pairs in other orders
        some = [" ".join(pairs[j]) for j in rng.integers(0, len(pairs), rng.integers(2, 5))]
        some += [*rng.choice(known, rng.integers(0, 6)), *rng.choice(loose, rng.integers(0, 5))]
        texts.append(" ".join(x.replace(". ", " ") for x in rng.permutation(np.array(some, object))))
        classes.append(n_families)
    found = passages(of_texts(texts), model.known)
    kept, labels = [], []
    for passage, row in zip(split(found), found.row, strict=True):
        label = classes[row]
        share = max(model.confirmed(f, passage[1]) for f in ([label] if label < n_families else range(n_families)))
        if (share >= 0.5) == (label < n_families):  # nor are scrambled words that make up a notice unknown
            kept.append(passage)
            labels.append(label)
    return joined(kept + others), np.array(labels + [n_families] * len(others))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Model:
    """docs (doc_id, text): the classifier, with corpus passages of a bounded sample as unknown."""
    families = sorted(TEMPLATES)
    words = of_texts([t for f in families for t in TEMPLATES[f]])
    pairs = [[np.unique(of_texts([t]).two) for t in TEMPLATES[f]] for f in families]
    model = Model(families, np.unique(np.concatenate([words.one, words.two])), np.unique(words.two), np.zeros(0), 0.0, pairs)
    some = sample(docs.where("text is not null"), docs.count(), bound=sample_rows).select("text")
    gathered = some.mapInArrow(gatherer(model.known), PASSAGE).dropDuplicates(["passage"]).orderBy("passage").limit(SAMPLE_PASSAGES).collect()
    others = [(np.array(r.one, np.int64).view(np.uint64), np.array(r.two, np.int64).view(np.uint64)) for r in gathered]
    # Real notices in the sample are no examples of unknown passages.
    others = [x for x in others if max(model.confirmed(f, x[1]) for f in range(len(families))) < 0.5]
    rng = np.random.default_rng(seed)
    found, labels = examples(model, others, rng)
    n, n_classes = len(labels), len(families) + 1
    row, column, other = model.cells(found)
    width = len(model.vocabulary)
    dense = np.zeros((n, width + 2), np.float32)
    dense[row, column] = 1
    dense[:, -2], dense[:, -1] = other, 1
    held = rng.random(n) < 0.3
    target = np.eye(n_classes, dtype=np.float32)[labels]
    x, y = dense[~held], target[~held]
    balance = (1 / np.bincount(labels[~held], minlength=n_classes).clip(1))[labels[~held]][:, None]
    balance = (balance / balance.mean()).astype(np.float32)
    weights, speed = np.zeros((width + 2, n_classes), np.float32), np.zeros((width + 2, n_classes), np.float32)
    for _ in range(ROUNDS):
        z = x @ weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed + x.T @ ((y - p) * balance) / len(x) - RIDGE * weights
        weights += RATE * speed
    model.weights = weights.astype(np.float64)
    z = dense[held] @ weights
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    unknown = p[labels[held] == n_classes - 1][:, :-1].max(axis=1)
    model.least = max(0.5, float(np.quantile(unknown, 1 - FALSE_SHARE)) if len(unknown) else 0.5)
    return model


SCANNED = "doc_id long, n_paragraphs long, n_notices long, licences string, score double"


def scanner(model):
    """model: a Model as sent() sends it. Batches of (doc_id, text) -> a row a document."""

    @kernels.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = received(model)
        for batch in batches:
            n = batch.num_rows
            n_paragraphs, n_found, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            names: list[set[str]] = [set() for _ in range(n)]
            for first, _, data, offsets in kernels.pieces(batch.column(1)):
                words = read(data, offsets)
                if not len(words.one):
                    continue
                begins = np.concatenate([[True], np.diff(words.paragraph) > 0])
                np.add.at(n_paragraphs, first + words.row[begins], 1)
                found = passages(words, own.known)
                if not len(found.row):
                    continue
                p = own.probabilities(found)
                best = p[:, :-1].argmax(axis=1)
                likely = np.flatnonzero((p[np.arange(len(p)), best] >= own.least) & (best == p.argmax(axis=1)))
                pairs = found.pairs() if len(likely) else []
                for k in likely.tolist():
                    if own.confirmed(best[k], pairs[k]) >= CONTAINED:
                        row = first + found.row[k]
                        n_found[row] += 1
                        score[row] = max(score[row], p[k, best[k]])
                        names[row].add(own.families[best[k]])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n_paragraphs), pa.array(n_found), pa.array([",".join(sorted(x)) for x in names]), pa.array(score)], [x.split()[0] for x in SCANNED.split(", ")])

    return run


def scanned(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_paragraphs, n_notices, licences, score."""
    model = sent(docs.sparkSession, train(docs.select("doc_id", "text"), sample_rows))
    return docs.select("doc_id", "text").mapInArrow(scanner(model), SCANNED)
