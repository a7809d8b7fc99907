"""Licence scan: a trained paragraph classifier whose findings are confirmed by comparison with templates.

Paragraphs are lines and, for notices wrapped over several of them, groups of lines. A softmax regression over hashed word
unigrams and bigrams tells licence families from ordinary prose. It is trained here from the templates, varied and set into
prose, and from at most ``SAMPLE`` prose lines of the corpus (a documented bound). Prose it was not fitted on calibrates the
least probability of a family. A line that reaches it is confirmed when it holds enough of the word pairs of one of the
family's templates; otherwise it is an unknown licence. In runs of lines with words (comment marks are no words) the shortest
groups that hold enough of a template's word pairs, within ``SPREAD`` times its length, those across line ends included, go
through the classifier like lines and count when it takes them for a licence of that family.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wardline.llm.shared import byte_texts, hash_share, map_batches, mixed

SAMPLE = 7000
FITTED = 1400  # prose lines that the weights are fitted on; the others calibrate the threshold
LINE_CHARS = 4000  # of a sampled line; lines that are scanned are never cut
BITS = 16
COVER = 0.6  # share of a template's word pairs that a paragraph must hold
SPREAD = 2  # words of a group of lines, as a multiple of the template's words, within which its pairs must lie
FALSE_ALARMS = 0.0005  # share of held-out prose that may pass as a licence before comparison

#: Usual short notices of each family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Released under CC0 1.0 Universal.",
    ),
    "reserved": (
        "All rights reserved. No part of this publication may be reproduced without permission.",
        "Copyright, all rights reserved.",
    ),
}
FAMILIES = tuple(TEMPLATES)
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+(?:[.-][a-z0-9]+)*")


def words_of(line: bytes) -> list[bytes]:
    return _WORD.findall(line.lower())


def _grams(words: list[bytes]) -> np.ndarray:
    """Places of the unigrams and bigrams of a paragraph in the weight table."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    pairs = mixed(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
    return (np.concatenate([h, pairs]) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class Classifier:
    """Weights by gram and class (0 is prose, then FAMILIES) and the least probability of a family."""

    weights: np.ndarray
    bias: np.ndarray
    least: float

    def probabilities(self, grams: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(g) for g in grams])
        total = np.zeros((len(grams), len(self.bias)))
        full = np.flatnonzero(sizes)
        if len(full):
            at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            total[full] = np.add.reduceat(self.weights[np.concatenate([grams[k] for k in full])], at, axis=0)
            total[full] /= np.sqrt(sizes[full])[:, None]
        total += self.bias
        total = np.exp(total - total.max(axis=1, keepdims=True))
        return total / total.sum(axis=1, keepdims=True)


def prose_sample(documents: DataFrame, sample: int = SAMPLE, chars: int = LINE_CHARS) -> list[str]:
    """At most ``sample`` lines of prose, of each the first ``chars`` characters: one line, at a place its hash chooses, of
    each document of smallest hash."""
    rows = documents.select(F.xxhash64("doc_id", "text").alias("order"), F.split("text", "\n").alias("lines")).filter("lines is not null")
    line = F.get("lines", F.pmod("order", F.size("lines").cast("long")).cast("int"))
    rows = rows.select("order", F.substring(line, 1, chars).alias("line"))
    rows = rows.filter(hash_share(F.col("order"), sample, documents.count()))
    return [r["line"] for r in rows.orderBy("order", "line").limit(sample).collect()]


def train(prose: list[str], rounds: int = 120, rate: float = 1.0, seed: int = 7) -> Classifier:
    """Softmax regression by adaptive gradient steps; prose lines beyond ``FITTED``, a third at least, calibrate the threshold."""
    chance = random.Random(seed)
    cues = re.compile(r"licen[sc]e|copyright|rights reserved|public domain", re.IGNORECASE)
    plain = [p.encode() for p in prose if not cues.search(p)] or [b"an ordinary line of prose", b"another one"]
    fit = min(FITTED, len(plain) - -(-len(plain) // 3))
    fitted, spared = plain[:fit], plain[fit:]
    rows: list[list[bytes]] = [words_of(p) for p in fitted]
    kinds = [0] * len(rows)
    for k, family in enumerate(FAMILIES, 1):
        for template in TEMPLATES[family]:
            for turn in range(12):
                words = words_of(template.encode())
                if turn > 3:
                    words = [w for w in words if chance.random() > 0.08] or words
                if turn % 3 == 2:
                    around = words_of(chance.choice(fitted or plain))[: chance.randrange(1, 12)]
                    words = around + words if turn % 2 else words + around
                rows.append(words)
                kinds.append(k)
    grams = [_grams(w) if w else np.empty(0, dtype=np.int64) for w in rows]
    sizes, y = np.array([len(g) for g in grams]), np.eye(len(FAMILIES) + 1)[kinds]
    flat = np.concatenate(grams)
    used, flat_at = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), sizes)
    scale = 1 / np.sqrt(np.maximum(1, sizes))
    w, b = np.zeros((len(used), y.shape[1])), np.zeros(y.shape[1])
    seen_w, seen_b = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(rounds):
        raw = np.zeros_like(y)
        np.add.at(raw, owner, w[flat_at])
        raw = raw * scale[:, None] + b
        p = np.exp(raw - raw.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - y) / len(rows)
        grad_w = np.zeros_like(w)
        np.add.at(grad_w, flat_at, error[owner] * scale[owner][:, None])
        grad_w += 1e-6 * w
        seen_w += grad_w**2
        seen_b += error.sum(axis=0) ** 2
        w -= rate * grad_w / np.sqrt(seen_w)
        b -= rate * error.sum(axis=0) / np.sqrt(seen_b)
    weights = np.zeros((1 << BITS, y.shape[1]))
    weights[used] = w
    made = Classifier(weights, b, 0.5)
    alarm = 1 - made.probabilities([_grams(x) if (x := words_of(p)) else np.empty(0, dtype=np.int64) for p in spared])[:, 0]
    least = float(np.quantile(alarm, 1 - FALSE_ALARMS)) if len(alarm) else 0.5
    return Classifier(weights, b, min(0.95, max(0.5, least)))


_PAIRS = {f: [set(zip(words_of(t.encode()), words_of(t.encode())[1:], strict=False)) for t in ts] for f, ts in TEMPLATES.items()}


def confirmed(words: list[bytes], family: str) -> bool:
    """Whether a paragraph holds enough of the word pairs of a template of the family."""
    own = set(zip(words, words[1:], strict=False))
    return any(len(own & pairs) >= COVER * len(pairs) for pairs in _PAIRS[family])


#: Each template of COVER by number: family, pairs it must share, words within which they lie; and numbers by word pair.
_WANTED = [(f, math.ceil(COVER * len(p) - 1e-9), SPREAD * (len(p) + 1)) for f in FAMILIES for p in _PAIRS[f]]
_OWNERS: dict[tuple[bytes, bytes], list[int]] = {}
for _n, _p in enumerate(p for f in FAMILIES for p in _PAIRS[f]):
    for _pair in _p:
        _OWNERS.setdefault(_pair, []).append(_n)
_MARK = re.compile(rb"^\s*(?:rem|dnl)\s", re.IGNORECASE)  # comment marks made of letters


def wrapped(run: list[tuple[int, list[bytes]]]) -> list[tuple[int, int, str]]:
    """First line, last line and family of each group of two or more lines of a run that together hold a notice."""
    words = [w for _, line in run for w in line]
    places: dict[int, list[tuple[int, tuple[bytes, bytes]]]] = {}
    for at, pair in enumerate(zip(words, words[1:], strict=False)):
        if pair in _OWNERS:
            for n in _OWNERS[pair]:
                places.setdefault(n, []).append((at, pair))
    groups, line_of = [], None
    for n, met in sorted(places.items()):
        family, least, spread = _WANTED[n]
        if len(met) < least or len({pair for _, pair in met}) < least:
            continue
        line_of = line_of or [k for k, line in run for _ in line]
        held: Counter[tuple[bytes, bytes]] = Counter()
        low, done = 0, -1
        for high, (at, pair) in enumerate(met):
            if at <= done:  # belongs to the group before
                low = high + 1
                continue
            held[pair] += 1
            while at + 2 - met[low][0] > spread or (len(held) >= least and held[met[low][1]] > 1):
                held[met[low][1]] -= 1
                held += Counter()
                low += 1
            if len(held) >= least:
                for more, other in met[high + 1 :]:  # what else of the template follows
                    if more + 2 - met[low][0] > spread:
                        break
                    if other not in held:
                        held[other], at = 1, more
                first, last = line_of[met[low][0]], line_of[at + 1]
                if first != last:
                    groups.append((first, last, family))
                held.clear()
                low, done = high + 1, at
    return groups


def _with_wrapped(found: list[tuple[int, str]], lines: list[tuple[int, list[bytes]]], classifier: Classifier) -> list[tuple[int, str]]:
    """The hits of single lines and, at their first line, of wrapped notices; a line within one is no longer unknown.

    A group of lines that may hold a template is a paragraph of its own: the classifier has to take it for a licence, with
    the family among its two likeliest, and the template confirms it.
    """
    start = 0
    for end in range(1, len(lines) + 1):
        if end < len(lines) and lines[end][0] == lines[end - 1][0] + 1:
            continue
        groups = wrapped(lines[start:end]) if end - start > 1 else []
        grams = [_grams([w for k, words in lines[start:end] if first <= k <= last for w in words]) for first, last, _ in groups]
        for (first, last, family), p in zip(groups, classifier.probabilities(grams) if groups else (), strict=True):
            if 1 - p[0] < classifier.least or family not in {FAMILIES[f] for f in np.argsort(-p[1:], kind="stable")[:2]}:
                continue
            if not any(first <= k <= last and f == family for k, f in found):
                found = [(k, f) for k, f in found if f != "unknown" or not first <= k <= last] + [(first, family)]
            else:
                found = [(k, f) for k, f in found if f != "unknown" or not first <= k <= last]
        start = end
    return sorted(found)


def scan_licenses(documents: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, n_paragraphs, families (sorted, comma-joined), paragraphs (number:family of each hit), n_unknown.

    Paragraphs are lines with a word, numbered among all lines from 0. Null and empty texts have none. A paragraph that the
    classifier takes for a licence but that no template confirms is `unknown`. A wrapped notice is a hit of its first line. Repeated rows get equal results; other
    columns are not read.
    """

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        n_paragraphs, families, hits, unknown = [], [], [], []
        for text in byte_texts(batch.column("text")):
            lines = [(k, w) for k, line in enumerate((text or b"").split(b"\n")) if (w := words_of(_MARK.sub(b"", line)))]
            n_paragraphs.append(len(lines))
            found = []
            if lines:
                p = classifier.probabilities([_grams(w) for _, w in lines])
                for at in np.flatnonzero(1 - p[:, 0] >= classifier.least).tolist():
                    k, words = lines[at]
                    ranked = np.argsort(-p[at, 1:], kind="stable")[:2].tolist()
                    family = next((FAMILIES[f] for f in ranked if confirmed(words, FAMILIES[f])), "unknown")
                    found.append((k, family))
                found = _with_wrapped(found, lines, classifier)
            families.append(",".join(sorted({f for _, f in found if f != "unknown"})))
            hits.append(",".join(f"{k}:{f}" for k, f in found))
            unknown.append(sum(f == "unknown" for _, f in found))
        return {"doc_id": batch.column("doc_id"), "n_paragraphs": n_paragraphs, "families": families, "paragraphs": hits, "n_unknown": unknown}

    return map_batches(
        documents.select("doc_id", "text"), work, "doc_id long, n_paragraphs long, families string, paragraphs string, n_unknown long"
    )
