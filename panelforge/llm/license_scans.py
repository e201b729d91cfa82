"""Licence families of documents, by a trained classifier of paragraphs.

A paragraph is a line. Notices may be wrapped over lines: lines that no blank one parts are
a block, and a line without words (such as a lone comment mark) is blank. Overlapping windows
of about a notice's length run over all words of a block (``WINDOWS``), so that words far
from a notice do not dilute it, and every line of up to the largest window is one by itself. The words and word
pairs of a window are hashed into a sparse vector that a multinomial logistic regression
assigns to a licence family or to ``UNKNOWN``. The model is trained on variants of the
notices below, with words dropped and corpus words around them as in windows of longer
lines, and on lines of the corpus and windows of them as the unknown class. On held-out rows
a temperature makes its probabilities honest, and the probability that a family must reach
is the one that the best window of few enough held-out corpus lines exceeds. A prediction
counts if the window also holds most word pairs of a notice of that family, and all of those
that tell it from its sisters (GPL, LGPL and AGPL, or the kinds of CC); of overlapping
ones the most similar counts, then the most probable, then the first.

The training sample is bounded (``CORPUS_LINES`` lines of up to ``LINE_CHARS``
characters); every window of every document is scored.

Defined results: a null or empty text has no paragraphs and no family; a paragraph is
licensed if a confirmed notice begins in it; of several confirmed notices the most similar
counts, then the most probable, then the first; repeated rows are judged alike; rows without
an id are judged like others; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import spans
from panelforge.llm.tables import id_and_text, schema

# Notices of licence families; fixed wording. What stands in brackets tells a family from its
# sisters: a window without all of it is no notice of the family, however similar.
MARKED_NOTICES = {
    "MIT": (
        "Released under the [MIT License].",
        "[Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software] and associated documentation files",
    ),
    "Apache-2.0": (
        "Licensed under the [Apache License, Version 2.0].",
        "[Apache License Version 2.0], January 2004",
        "[you may not use this file except in compliance with the License]",
    ),
    "GPL-3.0": (
        "This work is licensed under the [GNU General Public License, version 3].",
        "[GNU General Public License Version 3], 29 June 2007",
        "under the terms of the [GNU General Public License] as published by the Free Software "
        "Foundation, either [version 3] of the License, or any later version",
    ),
    "GPL-2.0": (
        "This work is licensed under the [GNU General Public License, version 2].",
        "[GNU General Public License Version 2], June 1991",
        "under the terms of the [GNU General Public License] as published by the Free Software "
        "Foundation; either [version 2] of the License",
    ),
    "LGPL": (
        "This library is licensed under the [GNU Lesser General Public License].",
        "under the terms of the [GNU Lesser General Public License] as published by the Free "
        "Software Foundation, either [version 3] of the License, or any later version",
        "under the terms of the [GNU Lesser General Public License] as published by the Free "
        "Software Foundation; either [version 2.1] of the License, or any later version",
        "[GNU Lesser General Public License Version 3], 29 June 2007",
        "[GNU Lesser General Public License Version 2.1], February 1999",
    ),
    "AGPL-3.0": (
        "Licensed under the [GNU Affero General Public License, version 3].",
        "[GNU Affero General Public License Version 3], 19 November 2007",
        "under the terms of the [GNU Affero General Public License] as published by the Free "
        "Software Foundation, either [version 3] of the License, or any later version",
    ),
    "BSD": (
        "Released under the [BSD License].",
        "[Redistribution and use in source and binary forms], with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    "MPL-2.0": (
        "Subject to the terms of the [Mozilla Public License, version 2.0].",
        "This Source Code Form is subject to the terms of the [Mozilla Public License, v. 2.0].",
        "[Mozilla Public License Version 2.0]",
    ),
    "ISC": (
        "Licensed under the [ISC License].",
        "[Permission to use, copy, modify, and/or distribute this software for any purpose] with "
        "or without fee is hereby granted",
    ),
    "CC-BY-4.0": (
        "Licensed under [CC BY 4.0].",
        "licensed under a Creative Commons [Attribution 4.0 International] License",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under [CC BY-SA 4.0].",
        "licensed under a Creative Commons [Attribution-ShareAlike 4.0 International] License",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under [CC BY-NC 4.0].",
        "licensed under a Creative Commons [Attribution-NonCommercial 4.0 International] License",
    ),
    "CC-BY-ND-4.0": (
        "Licensed under [CC BY-ND 4.0].",
        "licensed under a Creative Commons [Attribution-NoDerivatives 4.0 International] License",
    ),
    "CC-BY-NC-SA-4.0": (
        "Licensed under [CC BY-NC-SA 4.0].",
        "licensed under a Creative Commons [Attribution-NonCommercial-ShareAlike 4.0 "
        "International] License",
    ),
    "CC-BY-NC-ND-4.0": (
        "Licensed under [CC BY-NC-ND 4.0].",
        "licensed under a Creative Commons [Attribution-NonCommercial-NoDerivatives 4.0 "
        "International] License",
    ),
    "CC0-1.0": (
        "Released under [CC0 1.0].",
        "dedicated to the public domain under the [CC0 1.0 Universal] Public Domain Dedication",
    ),
    "proprietary": (
        "[All rights reserved].",
        "[No part of this work may be reproduced] without written permission of the publisher.",
    ),
}
NOTICES = {
    family: tuple(notice.replace("[", "").replace("]", "") for notice in notices)
    for family, notices in MARKED_NOTICES.items()
}
UNKNOWN = "unknown"
MARKS = re.compile(r"\[(.*?)\]")
# Buckets of words and of word pairs.
BUCKETS = 1 << 13
VARIANTS = 40
CORPUS_LINES, LINE_CHARS = 4_000, 2_000
# Documents that the corpus lines are taken from, in expectation.
SAMPLE_DOCS = 2_000
# Share of held-out corpus paragraphs that may exceed the threshold of a family.
FALSE_SHARE = 0.002
# Share of a notice's word pairs that a confirmed window holds.
SIMILAR = 0.7
# Words of a window and from one to the next; runs of up to size - step + 1 words are whole
# in one of them, wherever they begin.
WINDOWS = ((4, 1), (8, 2), (12, 2), (16, 2), (24, 4), (32, 4))
SEED = 10
# Words whose running sums are held at a time.
STRETCH = 1 << 16

_PLAIN = spans.LOWER.copy()
_PLAIN[[b for b in range(128) if not chr(b).isalnum() and b != ord("\n")]] = ord(" ")


def _lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text bytes in lower case with punctuation as space, line bounds, and a line's row."""
    data, bounds = spans.text_bytes(column)
    data[:-8] = _PLAIN[data[:-8]]
    breaks = np.flatnonzero(data[:-8] == ord("\n")) + 1
    cuts = np.unique(np.concatenate([bounds, breaks]))
    row = np.searchsorted(bounds, cuts[:-1], side="right") - 1
    return data, cuts, row


def _features(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, spans.Words]:
    """Bucket and line of every word and word pair."""
    words = spans.find_words(data, cuts)
    h = spans.hash_spans(data, words.begin, words.end)
    line = np.repeat(np.arange(len(words.count)), words.count)
    pairs, _, pair_line = spans.window_hashes(h, words, 2, short=False)
    size = np.uint64(BUCKETS)
    bucket = np.concatenate([h % size, pairs % size + size]).astype(np.int64)
    return bucket, np.concatenate([line, pair_line]), words


class Hashed(NamedTuple):
    """Buckets of words and of the pairs they begin, by word; the last word of a run has none.

    ``noticed`` counts the pairs of any notice before each word.
    """

    word: np.ndarray
    pair: np.ndarray
    noticed: np.ndarray


def _hashed(data: np.ndarray, words: spans.Words, runs: spans.Words) -> Hashed:
    """The words' buckets, with pairs inside ``runs``."""
    h = spans.hash_spans(data, words.begin, words.end)
    pairs, at, _ = spans.window_hashes(h, runs, 2, short=False)
    size = np.uint64(BUCKETS)
    pair = np.full(len(h), 2 * BUCKETS, np.int64)
    pair[at] = (pairs % size + size).astype(np.int64)
    noticed = np.zeros(len(h) + 1, np.int64)
    noticed[at + 1] = np.isin(pairs, NOTICE_HASHES)
    return Hashed((h % size).astype(np.int64), pair, np.cumsum(noticed))


def windows(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the windows over runs of words, by ascending begin."""
    begins, ends, shorter = [], [], 0
    for size, step in WINDOWS:
        # Shorter runs are whole in a window of the size before.
        own = count > shorter
        n = 1 + np.maximum(0, -(-(count[own] - size) // step))
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begins.append(np.repeat(first[own], n) + step * k)
        ends.append(np.minimum(begins[-1] + size, np.repeat((first + count)[own], n)))
        shorter = size
    begin, end = np.concatenate(begins), np.concatenate(ends)
    order = np.argsort(begin, kind="stable")
    return begin[order], end[order]


def blocks(words: spans.Words, row: np.ndarray) -> spans.Words:
    """The words by runs of lines of a row with no blank line between them."""
    solid = np.flatnonzero(words.count)
    new = (np.diff(solid, prepend=-2) > 1) | (np.diff(row[solid], prepend=-1) > 0)
    starts = np.flatnonzero(new)
    count = np.add.reduceat(words.count[solid], starts) if len(starts) else words.count[:0]
    return spans.Words(words.begin, words.end, words.first[solid[starts]], count)


def _with_lines(
    begin: np.ndarray, end: np.ndarray, lines: spans.Words
) -> tuple[np.ndarray, np.ndarray]:
    """The windows and all lines no longer than the largest, by ascending begin."""
    short = (lines.count > 0) & (lines.count <= WINDOWS[-1][0])
    begin = np.concatenate([begin, lines.first[short]])
    end = np.concatenate([end, (lines.first + lines.count)[short]])
    order = np.argsort(begin, kind="stable")
    return begin[order], end[order]


@dataclass(frozen=True)
class Model:
    """Weights by bucket and class, with the calibration of the held-out rows."""

    classes: list[str]
    weights: np.ndarray
    intercept: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5

    def logits(self, bucket: np.ndarray, line: np.ndarray, n_lines: int) -> np.ndarray:
        """Sums over the features of each line, which have unit length together."""
        out = np.zeros((n_lines, len(self.classes)), np.float32)
        order = np.argsort(line, kind="stable")
        line, bucket = line[order], bucket[order]
        for at in range(0, len(line), 1 << 17):
            names, starts = np.unique(line[at : at + (1 << 17)], return_index=True)
            out[names] += np.add.reduceat(self.weights[bucket[at : at + (1 << 17)]], starts, axis=0)
        n = np.maximum(1, np.bincount(line, minlength=n_lines))
        return out / np.sqrt(n, dtype=np.float32)[:, None] + self.intercept

    def likely(self, text: Hashed, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows that a family leads, that family's class and its probability.

        Sums over windows are differences of running sums over a stretch of words. The windows
        come by ascending begin.
        """
        table = np.append(self.weights.T, np.zeros((len(self.classes), 1), np.float32), axis=1)
        intercept, found = self.intercept[:, None], []
        for at in range(0, len(text.word), STRETCH):
            a, b = np.searchsorted(begin, [at, at + STRETCH])
            if a == b:
                continue
            stop = int(end[a:b].max())
            pair = table[:, text.pair[at:stop]]
            sums = np.zeros((len(table), stop - at + 1))
            np.cumsum(table[:, text.word[at:stop]] + pair, axis=1, out=sums[:, 1:])
            head, tail = begin[a:b] - at, end[a:b] - at
            # The last word's pair reaches beyond the window.
            z = sums[:, tail] - sums[:, head] - pair[:, tail - 1]
            z = z / np.sqrt(2 * (tail - head) - 1) + intercept
            led = np.flatnonzero(z[1:].max(0) > z[0])
            p = self.probabilities(z[:, led].T)
            kind = p[:, 1:].argmax(1) + 1
            found.append((a + led, kind, p[np.arange(len(led)), kind]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _words(text: str) -> list[str]:
    return bytes(_PLAIN[np.frombuffer(text.encode(), np.uint8)]).decode().split()


def _pairs(text: str) -> set[tuple[str, str]]:
    words = _words(text)
    return set(zip(words, words[1:], strict=False))


NOTICE_PAIRS = {family: [_pairs(n) for n in notices] for family, notices in NOTICES.items()}
# The pairs of a notice that a window must hold, in the same order.
NEEDED_PAIRS = {
    family: [set().union(*(_pairs(part) for part in MARKS.findall(n))) for n in notices]
    for family, notices in MARKED_NOTICES.items()
}
# Fewest word pairs of a notice that confirm a family.
LEAST_PAIRS = {
    family: min(ceil(SIMILAR * len(pairs)) for pairs in notices)
    for family, notices in NOTICE_PAIRS.items()
}


def _notice_hashes() -> np.ndarray:
    notices = [" ".join(_words(n)) for family in NOTICES.values() for n in family]
    data, bounds = spans.text_bytes(pa.array(notices, pa.large_string()))
    words = spans.find_words(data, bounds)
    h = spans.hash_spans(data, words.begin, words.end)
    return np.unique(spans.window_hashes(h, words, 2, short=False)[0])


NOTICE_HASHES = _notice_hashes()


def similarity(paragraph: str, family: str) -> float:
    """Largest share of a notice's word pairs that the paragraph holds."""
    own = _pairs(paragraph)
    return max(len(own & pairs) / len(pairs) for pairs in NOTICE_PAIRS[family])


def held(words: Sequence[str], family: str) -> tuple[float, int, int]:
    """Similarity of a window, and first word and end of the notice in it.

    A notice whose needed pairs are not all there is not similar. The notice is the shortest
    stretch, from the end, with all pairs that the window holds.
    """
    pairs = list(zip(words, words[1:], strict=False))
    own = set(pairs)
    there = [
        notice
        for notice, needed in zip(NOTICE_PAIRS[family], NEEDED_PAIRS[family], strict=True)
        if needed <= own
    ]
    if not there:
        return 0.0, 0, 0
    notice = max(there, key=lambda n: len(own & n) / len(n))
    common = own & notice
    last = {pair: i for i, pair in enumerate(pairs) if pair in common}
    begin = min(last.values(), default=0)
    end = max((pairs.index(pair, begin) + 2 for pair in common), default=0)
    return len(common) / len(notice), begin, end


def corpus_lines(docs: DataFrame, n: int = CORPUS_LINES) -> list[str]:
    """At most ``n`` lines of sampled documents, the lowest by hash.

    Documents are drawn by their own hash, so the sample does not follow the files' splits.
    """
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / total) if total else 1.0
    drawn = F.pmod(F.xxhash64("text", "doc_id", F.lit(SEED)), F.lit(1 << 30))
    lines = (
        docs.where(drawn < int(share * (1 << 30)))
        .select("text")
        .select(F.explode(F.split("text", "\n")).alias("line"))
        .where((F.length(F.trim("line")) > 0) & (F.length("line") <= LINE_CHARS))
        .distinct()
    )
    rows = lines.orderBy(F.xxhash64("line"), "line").limit(n).collect()
    return [row["line"] for row in rows]


def training_rows(lines: Sequence[str]) -> list[tuple[str, str, int]]:
    """(text, class, origin): notices in variants, and corpus lines that hold no notice.

    A variant comes as a short line and as a window of a longer one, wherever the window
    begins; a corpus line comes whole and with one window. Both rows have the same origin.
    """
    draw = np.random.default_rng(SEED)
    plain = [
        line for line in lines if max(similarity(line, family) for family in NOTICES) < SIMILAR / 2
    ]
    around = [word for line in plain[:500] for word in line.split()] or ["text"]

    def drawn(n: int) -> list[str]:
        return [around[i] for i in draw.integers(0, len(around), n).tolist()]

    rows = []
    for origin, line in enumerate(plain):
        rows.append((line, UNKNOWN, origin))
        words = _words(line)
        sizes = [size for size, _ in WINDOWS if size < len(words)]
        if sizes:
            size = int(draw.choice(sizes))
            at = int(draw.integers(0, len(words) - size + 1))
            rows.append((" ".join(words[at : at + size]), UNKNOWN, origin))
    origin = len(plain)
    for family, notices in NOTICES.items():
        for notice in notices:
            words = notice.split()
            rows.append((notice, family, origin))
            origin += 1
            for _ in range(VARIANTS):
                kept = [w for w, p in zip(words, draw.random(len(words)), strict=True) if p > 0.08]
                before = drawn(int(draw.integers(0, 8)))
                after = drawn(int(draw.integers(0, 8)))
                if draw.random() < 0.5:
                    before = after = []
                rows.append((" ".join([*before, *kept, *after]), family, origin))
                n = len(_words(" ".join(kept)))
                room = int(draw.choice([size for size, _ in WINDOWS if size >= n][:2])) - n
                before = drawn(int(draw.integers(0, room + 1)))
                after = drawn(room - len(before))
                rows.append((" ".join([*before, *kept, *after]), family, origin))
                origin += 1
    return rows


def _vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat = [text.replace("\n", " ") for text in texts]
    data, bounds = spans.text_bytes(pa.array(flat, pa.large_string()))
    data[:-8] = _PLAIN[data[:-8]]
    bucket, line, _ = _features(data, bounds)
    return bucket, line


def train(docs: DataFrame) -> Model:
    """The model with its calibration; every fourth origin is held out of the training."""
    spark = docs.sparkSession
    rows = training_rows(corpus_lines(docs))
    classes = [UNKNOWN, *NOTICES]
    label = np.array([classes.index(kind) for _, kind, _ in rows])
    bucket, line = _vectors([text for text, _, _ in rows])
    out = np.array([origin for _, _, origin in rows]) % 4 == 3
    order = np.argsort(line, kind="stable")
    parts = np.split(bucket[order], np.searchsorted(line[order], np.arange(1, len(rows))))
    examples = []
    for i in np.flatnonzero(~out).tolist():
        names, counts = np.unique(parts[i], return_counts=True)
        scale = 1 / np.sqrt(max(1, counts.sum()))
        examples.append((float(label[i]), SparseVector(2 * BUCKETS, names, counts * scale)))
    fitted = LogisticRegression(
        family="multinomial", maxIter=60, regParam=1e-4, standardization=False
    ).fit(spark.createDataFrame(examples, ["label", "features"]).coalesce(1))
    # Without corpus lines the unknown class has no row, and the last class still has one.
    model = Model(
        classes,
        np.ascontiguousarray(fitted.coefficientMatrix.toArray().T, np.float32),
        fitted.interceptVector.toArray().astype(np.float32),
    )
    plain = {origin: text for text, kind, origin in reversed(rows) if kind == UNKNOWN}
    texts = [text for origin, text in plain.items() if origin % 4 == 3]
    return calibrated(model, model.logits(bucket, line, len(rows))[out], label[out], texts)


def calibrated(model: Model, logits: np.ndarray, label: np.ndarray, plain: list[str]) -> Model:
    """The temperature of least log loss, and the threshold of the families on plain lines."""
    row, best = np.arange(len(label)), (np.inf, 1.0)
    for temperature in np.geomspace(0.05, 5, 60):
        trial = Model(model.classes, model.weights, model.intercept, float(temperature))
        loss = -np.log(np.maximum(trial.probabilities(logits)[row, label], 1e-12)).mean()
        best = min(best, (loss, float(temperature)))
    chosen = Model(model.classes, model.weights, model.intercept, best[1])
    if not plain:
        return chosen
    data, bounds = spans.text_bytes(pa.array(plain, pa.large_string()))
    data[:-8] = _PLAIN[data[:-8]]
    words = spans.find_words(data, bounds)
    begin, end = windows(words.first, words.count)
    at, _, probability = chosen.likely(_hashed(data, words, words), begin, end)
    family = np.zeros(len(plain))
    line = np.searchsorted(words.first + words.count, begin[at], side="right")
    np.maximum.at(family, line, probability)
    threshold = max(0.5, float(np.quantile(family, 1 - FALSE_SHARE, method="higher")))
    return Model(model.classes, model.weights, model.intercept, best[1], min(threshold, 0.95))


RESULT = {
    "doc_id": "long",
    "n_paragraphs": "long",
    "n_licensed": "long",
    "family": "string",
    "paragraph": "long",
    "probability": "double",
    "similarity": "double",
}


def scan(docs: DataFrame) -> DataFrame:
    """Per document: its paragraphs, those with a confirmed licence, and the surest of these."""
    docs = id_and_text(docs)
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))
    out = schema(**RESULT)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for piece in spans.pieces(batch):
                yield pa.RecordBatch.from_arrays(_scan_piece(model, piece), out.names)

    return docs.mapInArrow(scanned, out)


def _scan_piece(model: Model, piece: pa.RecordBatch) -> list[pa.Array]:
    data, cuts, row = _lines(piece.column("text"))
    words = spans.find_words(data, cuts)
    line = np.repeat(np.arange(len(words.count)), words.count)
    runs = blocks(words, row)
    text = _hashed(data, words, runs)
    begin, end = _with_lines(*windows(runs.first, runs.count), words)
    at, kind, probability = model.likely(text, begin, end)
    begin, end = begin[at], end[at]
    least = np.array([0, *(LEAST_PAIRS[family] for family in model.classes[1:])])
    # Only windows with enough pairs of any notice can be similar to one.
    likely = (probability >= model.threshold) & (
        text.noticed[end - 1] - text.noticed[begin] >= least[kind]
    )
    n = piece.num_rows
    first = np.searchsorted(row, np.arange(n))
    found = [[] for _ in range(n)]
    for i in np.flatnonzero(likely).tolist():
        family, a, b = model.classes[kind[i]], int(begin[i]), int(end[i])
        whole = data[words.begin[a] : words.end[b - 1]].tobytes()
        own = [
            whole[x:y].decode()
            for x, y in zip(
                (words.begin[a:b] - words.begin[a]).tolist(),
                (words.end[a:b] - words.begin[a]).tolist(),
                strict=True,
            )
        ]
        like, head, tail = held(own, family)
        if like >= SIMILAR:
            found[row[line[a]]].append((-like, -float(probability[i]), a + head, a + tail, family))
    licensed, best = np.zeros(n, np.int64), [None] * n
    for i in range(n):
        taken = apart(found[i])
        if taken:
            licensed[i] = len({int(line[notice[2]]) for notice in taken})
            like, surest, a, _, family = taken[0]
            best[i] = (-like, -surest, int(line[a] - first[i]), family)
    return [
        piece.column("doc_id"),
        pa.array(np.bincount(row[words.count > 0], minlength=n), pa.int64()),
        pa.array(licensed),
        pa.array([b and b[3] for b in best], pa.string()),
        pa.array([b and b[2] for b in best], pa.int64()),
        pa.array([b and round(b[1], 6) for b in best], pa.float64()),
        pa.array([b and round(b[0], 6) for b in best], pa.float64()),
    ]


def apart(found: list[tuple]) -> list[tuple]:
    """Of (-similarity, -probability, begin, end, family) the lowest that do not overlap."""
    taken, begins, ends = [], [], []
    for notice in sorted(found):
        k = bisect_left(begins, notice[3])
        if not k or ends[k - 1] <= notice[2]:
            taken.append(notice)
            begins.insert(k, notice[2])
            ends.insert(k, notice[3])
    return taken
