"""Licence scans with a trained paragraph classifier.

Sparse word n-gram features and multinomial logistic regression name the licence family of a
paragraph or ``unknown``. The classifier is trained here, from the public notices below with
words dropped, replaced and surrounded, and from a bounded sample of corpus paragraphs and
scrambled notices as unknowns. Held-out examples fit a temperature, so that probabilities
(also of unknown) are calibrated. A prediction counts as confirmed if enough of one of the
family's templates stands in the paragraph.

Scanning is one narrow pass. Windows are judged wherever enough bigrams of a template stand
close together, in whatever lines, so each of several notices, a notice within a long line
and a wrapped one is a row of its own. What no window covers is judged as paragraphs: runs of
adjacent lines that each hold a content word of the notices; other lines have no feature and
are unknown by the model's bias alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm.shared import require, text_or_empty

UNKNOWN = "unknown"
#: Public notices of each family (fixed values).
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        "Released under the GPLv3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License v2.0.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "agpl-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission."],
}
#: Words that carry no content (fixed values).
STOP = frozenset("a an and any are as at be by can for from in is it its of on or that the this to under with you your".split())
#: Corpus paragraphs that are learnt as unknown at most, and variants of each template.
MOST_UNKNOWNS, VARIANTS = 1500, 24
#: Least probability of a family, and the least share of a template's bigrams that confirms it.
LEAST, CONFIRM = 0.5, 0.75

_word = re.compile(r"[^\W_]+(?:\.\d+)*")


def words(text: str) -> list[str]:
    return _word.findall(text.lower())


def ngrams(w: list[str]) -> list[str]:
    """Unigrams that carry content, and bigrams and trigrams with a word that does."""
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1) if any(x not in STOP for x in w[i : i + n])]


@dataclass
class Classifier:
    families: list[str]
    features: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    content: frozenset[str]
    templates: list[tuple[int, frozenset[str]]]
    notices: list[dict[tuple[str, str], int]]  # of each template the first place of each bigram
    lengths: list[int]

    def probabilities(self, w: list[str]) -> np.ndarray:
        """Calibrated probability of each family, the last one unknown."""
        at = [self.features[g] for g in set(ngrams(w)) if g in self.features]
        z = (self.weights[at].sum(axis=0) / np.sqrt(max(1, len(at))) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def likeness(self, w: list[str], family: int) -> float:
        """The largest share of one of the family's templates that the words hold, by bigrams."""
        own = bigrams(w)
        return max((len(t & own) / len(t) for f, t in self.templates if f == family), default=0.0)


def bigrams(w: list[str]) -> frozenset[str]:
    return frozenset(" ".join(w[i : i + 2]) for i in range(max(1, len(w) - 1)))


def train(unknowns: list[str], templates: dict[str, list[str]] = TEMPLATES, variants: int = VARIANTS, rounds: int = 300, seed: int = 11) -> Classifier:
    """Fit weights by gradient descent and the temperature on a held-out quarter; deterministic."""
    rng = np.random.default_rng(seed)
    families = [*sorted(templates), UNKNOWN]
    known = [(k, words(t)) for k, f in enumerate(families[:-1]) for t in templates[f]]
    filler = [w for u in unknowns for w in words(u)] or ["word"]
    some = lambda n: [filler[i] for i in rng.integers(0, len(filler), n)]
    examples = [(len(families) - 1, words(u)) for u in unknowns]
    for k, t in known:
        for v in range(variants):
            kept = [w for w in t if v == 0 or rng.random() > 0.06]
            examples.append((k, some(rng.integers(0, 6)) * (v > 2) + kept + some(rng.integers(0, 6)) * (v > 2)))
        for _ in range(variants // 3):  # words of notices in passing are no notice
            part = [w for w in t if rng.random() < 0.35] + some(int(rng.integers(4, 16)))
            examples.append((len(families) - 1, [part[i] for i in rng.permutation(len(part))]))
    features = {g: k for k, g in enumerate(sorted({g for _, t in known for g in ngrams(t)}))}
    x = np.zeros((len(examples), len(features)), np.float32)
    for r, (_, w) in enumerate(examples):
        at = [features[g] for g in set(ngrams(w)) if g in features]
        x[r, at] = 1 / np.sqrt(max(1, len(at)))
    y = np.eye(len(families), dtype=np.float32)[[k for k, _ in examples]]
    held = rng.random(len(examples)) < 0.25
    weights, bias = np.zeros((len(features), len(families)), np.float32), np.zeros(len(families), np.float32)
    for _ in range(rounds):
        p = softmax(x[~held] @ weights + bias)
        off = (p - y[~held]) / (~held).sum()
        weights -= 40 * (x[~held].T @ off + 2e-5 * weights)
        bias -= 4 * off.sum(axis=0)
    z = x[held] @ weights + bias
    loss = lambda t: -np.log(np.maximum((softmax(z / t) * y[held]).sum(axis=1), 1e-9)).mean()
    temperature = min(np.geomspace(0.25, 4, 33).tolist(), key=loss)
    content = frozenset(w for _, t in known for w in t if w not in STOP)
    return Classifier(families, features, weights, bias, float(temperature), content, [(k, bigrams(t)) for k, t in known], [{b: i for i, b in reversed([*enumerate(zip(t, t[1:]))])} for _, t in known], [len(t) for _, t in known])


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, most: int = MOST_UNKNOWNS) -> Classifier:
    """Train with one whole line each of about ``most`` distinct texts, drawn by a hash of the text, as unknowns.

    Each task keeps the rows under the hash threshold alone, so about ``most`` lines reach the
    driver however many rows there are. Lines that hold half of any template are left out;
    null and empty texts give no line, and without any line only notices are learnt.
    """
    require(docs, ["doc_id", "text"])
    texts = docs.select(text_or_empty().alias("text")).where("text <> ''")
    share = min(1.0, most / max(1, texts.count()))
    drawn = texts.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 40)) < int(share * (1 << 40)))
    lines = F.split("text", "\n")
    line = drawn.select(F.element_at(lines, F.pmod(F.xxhash64("text", F.lit(5)), F.size(lines)).cast("int") + 1).alias("line")).distinct()
    grams = [bigrams(words(t)) for f in TEMPLATES.values() for t in f]
    found = sorted(r["line"] for r in line.collect())
    return train([x for x in found if not any(len(t & bigrams(words(x))) * 2 >= len(t) for t in grams)])


def dense(w: list[str], model: Classifier, confirm: float, holders: dict[tuple[str, str], list[int]]) -> list[tuple[int, int, int, int, int]]:
    """(bigrams, first, last, from, to): words first..last hold enough bigrams of a template, whose whole would reach from..to; most bigrams and shortest first."""
    hits: dict[int, list[tuple[int, tuple[str, str]]]] = {}
    for i, b in enumerate(zip(w, w[1:])):
        if b in holders:
            for t in holders[b]:
                hits.setdefault(t, []).append((i, b))
    out = set()
    for t, at in hits.items():
        places, n = model.notices[t], model.lengths[t]
        need, reach = confirm * len(places), n + n // 3 + 2
        if len(at) < need:
            continue
        left, inside = 0, {}
        for i, b in at:
            inside[b] = inside.get(b, 0) + 1
            while i - at[left][0] > reach or inside[at[left][1]] > 1:
                gone = at[left][1]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                left += 1
            if len(inside) >= need:
                first, b0 = at[left]
                out.add((len(inside), first, i + 1, max(0, min(first, first - places[b0])), min(len(w) - 1, max(i + 1, i + n - 1 - places[b]))))
    return sorted(out, key=lambda x: (-x[0], x[2] - x[1], x[1:]))


def paragraphs(text: str, content: frozenset[str]) -> Iterator[tuple[int, str, list[str]]]:
    """(first line, text, words) of each run of lines that hold a content word."""
    if content.isdisjoint(words(text)):
        return
    held: list[str] = []
    lines = text.split("\n")
    for k, line in enumerate([*lines, ""]):
        if k < len(lines) and not content.isdisjoint(words(line)):
            held.append(line)
        elif held:
            joined = "\n".join(held)
            yield k - len(held), joined, words(joined)
            held = []


def scan(docs: DataFrame, model: Classifier, least: float = LEAST, confirm: float = CONFIRM) -> DataFrame:
    """(doc_id, line, family, probability, likeness, confirmed, paragraph): the notices and paragraphs that are not unknown.

    Each confirmed window that overlaps no better one is a row, whose ``paragraph`` is the
    window. Lines without such a window are judged as paragraphs and, if long, line by line.
    Null and empty texts have no paragraphs; repeated rows give repeated results.
    """
    require(docs, ["doc_id", "text"])
    rows = docs.select(F.col("doc_id"), text_or_empty().alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand features

    def judge(w: list[str]) -> tuple[int, float, float] | None:
        m = shared.value
        p = m.probabilities(w)
        k = int(p.argmax())
        return None if k == len(m.families) - 1 or p[k] < least else (k, float(p[k]), m.likeness(w, k))

    def windows(text: str, w: list[str], holders: dict[tuple[str, str], list[int]]) -> list[tuple]:
        """(first line, last line, family, probability, likeness, window) of the confirmed windows, in order."""
        taken: list[tuple[int, int, tuple[int, float, float]]] = []
        held = bytearray(len(w))
        for _, first, last, start, end in dense(w, shared.value, confirm, holders):
            if not any(held[first : last + 1]) and (found := judge(w[start : end + 1])) and found[2] >= confirm:
                held[first : last + 1] = b"\1" * (last + 1 - first)
                taken.append((first, last, found))
        if not taken:
            return []
        low = text.lower()
        spans = [x.span() for x in _word.finditer(low)]
        text = text if len(low) == len(text) else low  # a few capitals have two small characters
        out, at, line = [], 0, 0
        for first, last, found in sorted(taken):
            a, b = spans[first][0], spans[last][1]
            line, at = line + text.count("\n", at, a), a
            out.append((line, line + text.count("\n", a, b), *found, text[a:b]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        holders: dict[tuple[str, str], list[int]] = {}
        for t, places in enumerate(m.notices):
            for b in places:
                holders.setdefault(b, []).append(t)
        for batch in batches:
            out = []
            for r, text in enumerate(batch.column(1).to_pylist()):
                w = words(text)
                if m.content.isdisjoint(w):
                    continue
                notices = windows(text, w, holders)
                out += [(r, first, *found) for first, _, *found in notices]
                rest = text
                if notices:
                    covered = {k for first, last, *_ in notices for k in range(first, last + 1)}
                    rest = "\n".join("" if k in covered else line for k, line in enumerate(text.split("\n")))
                for first, paragraph, w in paragraphs(rest, m.content):
                    lines = paragraph.split("\n")
                    whole = judge(w)
                    if whole and (whole[2] >= confirm or len(lines) == 1):
                        out.append((r, first, *whole, paragraph))
                        continue
                    each = [(r, first + i, *found, line) for i, line in enumerate(lines) if (found := judge(words(line)))]
                    out += each or ([(r, first, *whole, paragraph)] if whole else [])
            r, line, k, p, likeness, paragraph = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(r, pa.int32())), pa.array(line, pa.int32()), pa.array([m.families[x] for x in k], pa.string()), pa.array(p, pa.float64()), pa.array(likeness, pa.float64()), pa.array([x >= confirm for x in likeness], pa.bool_()), pa.array(paragraph, pa.string())],
                names=["doc_id", "line", "family", "probability", "likeness", "confirmed", "paragraph"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, line int, family string, probability double, likeness double, confirmed boolean, paragraph string")


def label_documents(docs: DataFrame, model: Classifier) -> DataFrame:
    """Rows of ``scan`` summed up a document with findings: confirmed families in order, and counts.

    Texts without a finding, null and empty ones too, have no row; rows with equal doc_id are
    summed up together, so a repeated row counts twice in the counts and once in families.
    """
    found = scan(docs, model)
    return found.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), "|").alias("families"),
        F.count("*").alias("n_paragraphs"),
        F.sum(F.col("confirmed").cast("long")).alias("n_confirmed"),
        F.max("probability").alias("probability"),
    )
