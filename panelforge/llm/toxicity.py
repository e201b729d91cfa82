"""Toxic documents and the sentences that make them so, learned from document labels only.

Multiple-instance learning: a document is a bag of sentences, labels are of documents. A
sentence has the probability ``p = sigmoid(b + sum of its words' weights)``, and a document
is toxic if any sentence is: ``1 - prod(1 - p)``, the noisy-or. Weights are fitted to the
log loss of the documents' probabilities, whose gradient reaches the sentences through the
noisy-or: the sentences that already look toxic take the blame for a toxic document, and all
sentences of a clean one are pushed down. So a few words in one sentence of a long text
count, and the sentences with a high ``p`` are where the document offends.

Features are hashed: every word in lower case and its beginnings of 4 to 8 bytes, since
languages differ in how they build words. A sentence ends at ``.``, ``!`` or ``?`` before
white space, at a line break, or after ``MOST_WORDS`` words. Fitting takes up to
``FIT_DOCS`` labelled documents of up to ``FIT_BYTES`` bytes, those with the least hash of
``doc_id`` among the rows that may be learned from, and runs as one task; scoring covers
whole texts of any length, in pieces of bounded memory.

Defined results: an empty or null text, or one without words, has no sentences and the score
0; equal texts have equal scores; repeated documents are scored each and learned from once;
of several labels of a ``doc_id`` the highest counts, a null one not at all; a null
``doc_id`` is held in, as it has no remainder, and never learned from; without labels of
both kinds all scores are the share of toxic documents; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm import spans
from panelforge.llm.tables import id_and_text, schema
from panelforge.session import materialize

# Documents and bytes of each that fitting takes at most.
FIT_DOCS, FIT_BYTES = 12_000, 200_000
FOLDS = 5
MOST_WORDS = 32
FEATURE_BITS = 18
BEGINNINGS = (4, 5, 6, 7, 8)
NO_FEATURE = 1 << FEATURE_BITS
# Passes over the sample, the last of them whose weights are averaged, documents per step,
# step length, and pull of weights towards 0.
EPOCHS, AVERAGED, STEP_DOCS, STEP, PULL = 12, 6, 64, 0.6, 3e-5
FIRST_BIAS = -4.0
# The bias where there was nothing to learn.
UNKNOWN = -50.0
# A sentence is reported as offending from this probability on.
OFFENDING = 0.5

# What stands between words: ASCII but letters and digits.
_BETWEEN = np.ones(256, bool)
_BETWEEN[0x80:] = False
for _first, _last in ("az", "AZ", "09"):
    _BETWEEN[ord(_first) : ord(_last) + 1] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_SALTS = spans.mixed(np.arange(1, 2 + len(BEGINNINGS), dtype=np.uint64))

Batches = Iterator[pa.RecordBatch]


class Sentences(NamedTuple):
    """``features`` by word, ``of_word`` its sentence, ``row`` a sentence's document.

    ``begin`` and ``end`` are bytes of the sentence's words in its own text.
    """

    features: np.ndarray
    of_word: np.ndarray
    row: np.ndarray
    begin: np.ndarray
    end: np.ndarray


class Model(NamedTuple):
    """Weights by feature, the last of them 0 for no feature, and the sentences' bias.

    ``constant`` is the score of all documents where there was nothing to learn; no sentence
    offends then.
    """

    weights: np.ndarray
    bias: float
    constant: float | None = None


def _features(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    shift = np.uint64(64 - FEATURE_BITS)
    out = np.full((len(begin), 1 + len(BEGINNINGS)), NO_FEATURE, np.int32)
    whole = spans.hash_spans(data, begin, end)
    out[:, 0] = spans.mixed(whole ^ _SALTS[0]) >> shift
    for k, size in enumerate(BEGINNINGS, 1):
        longer = np.flatnonzero(end - begin > size)
        head = spans.first_bytes(data, begin[longer], begin[longer] + size)
        out[longer, k] = spans.mixed(head ^ _SALTS[k]) >> shift
    return out


def sentences(texts: pa.Array) -> Sentences:
    """The sentences of all texts, in order."""
    data, bounds = spans.text_bytes(texts, lower=True)
    words = spans.find_words(data, bounds, _BETWEEN)
    n = len(words.begin)
    row = np.repeat(np.arange(len(words.count)), words.count)
    size = int(bounds[-1])
    blank = np.append(spans.SPACE[data[1:size]], True)[:size]
    stops = np.flatnonzero((_STOP[data[:size]] & blank) | (data[:size] == ord("\n")))
    before = np.searchsorted(stops, words.begin)
    new = np.ones(n, bool)
    new[1:] = (before[1:] != before[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
    new |= place % MOST_WORDS == 0
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], n)[: len(heads)] - 1
    origin = bounds[row[heads]]
    return Sentences(
        _features(data, words.begin, words.end),
        np.cumsum(new) - 1,
        row[heads],
        words.begin[heads] - origin,
        words.end[tails] - origin,
    )


def _softplus(s: np.ndarray) -> np.ndarray:
    """-log(1 - sigmoid(s))"""
    return np.logaddexp(0.0, s)


def sentence_scores(found: Sentences, model: Model) -> np.ndarray:
    """The log odds of each sentence."""
    by_word = model.weights[found.features].sum(axis=1)
    return model.bias + np.bincount(found.of_word, by_word, len(found.row))


def document_scores(found: Sentences, model: Model, rows: int) -> np.ndarray:
    """The noisy-or of each document's sentences."""
    if model.constant is not None:
        return np.full(rows, model.constant)
    doubt = np.bincount(found.row, _softplus(sentence_scores(found, model)), rows)
    return np.clip(-np.expm1(-doubt), 0.0, 1.0)


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    """Weights by adaptive gradient steps (AdaGrad) on the documents' log loss."""
    rows, rate = len(labels), float(labels.mean()) if len(labels) else 0.0
    weights = np.zeros(NO_FEATURE + 1)
    if not 0 < rate < 1:
        return Model(weights, UNKNOWN, rate)
    found = sentences(texts)
    first_sentence = np.searchsorted(found.row, np.arange(rows + 1))
    first_word = np.searchsorted(found.of_word, np.arange(len(found.row) + 1))
    bias, steps, bias_steps = FIRST_BIAS, np.full(NO_FEATURE + 1, 1e-8), 1e-8
    draw = np.random.default_rng(0)
    mean, mean_bias = np.zeros(NO_FEATURE + 1), 0.0
    for epoch in range(EPOCHS):
        order = draw.permutation(rows)
        for at in range(0, rows, STEP_DOCS):
            docs = order[at : at + STEP_DOCS]
            own = _ranges(first_sentence[docs], first_sentence[docs + 1])
            if not len(own):
                continue
            of_doc = np.repeat(np.arange(len(docs)), np.diff(first_sentence)[docs])
            count = first_word[own + 1] - first_word[own]
            features = found.features[_ranges(first_word[own], first_word[own + 1])]
            of_sentence = np.repeat(np.arange(len(own)), count)
            scores = bias + np.bincount(of_sentence, weights[features].sum(axis=1), len(own))
            doubt = np.bincount(of_doc, _softplus(scores), len(docs))
            toxic = labels[docs]
            # d loss / d doubt: 1 for a clean document, -1 / (e^doubt - 1) for a toxic one.
            blame = (1 - toxic) - toxic / np.expm1(np.clip(doubt, 1e-6, 50))
            gradient = blame[of_doc] / (1 + np.exp(-scores)) / len(docs)
            by_feature = np.bincount(
                features.ravel(),
                np.repeat(gradient[of_sentence], features.shape[1]),
                NO_FEATURE + 1,
            )
            touched = np.flatnonzero(by_feature)
            slope = by_feature[touched] + PULL * weights[touched]
            steps[touched] += slope * slope
            weights[touched] -= STEP * slope / np.sqrt(steps[touched])
            weights[NO_FEATURE] = 0.0
            total = float(gradient.sum())
            bias_steps += total * total
            bias -= STEP * total / np.sqrt(bias_steps)
        if epoch >= EPOCHS - AVERAGED:
            mean += weights / AVERAGED
            mean_bias += bias / AVERAGED
    return Model(mean, mean_bias)


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from each begin up to its end, in one array."""
    size = end - begin
    skip = np.repeat(begin - np.cumsum(size) + size, size)
    return np.arange(int(size.sum())) + skip


def remainder(doc_id: Column) -> Column:
    """The fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


# Without rows, so that a sample has columns if it has none either.
SAMPLE = pa.table(
    {
        "doc_id": pa.array([], pa.int64()),
        "toxic": pa.array([], pa.int32()),
        "text": pa.array([], pa.large_string()),
    }
)


def _table(batch: pa.RecordBatch) -> pa.Table:
    return pa.Table.from_batches([batch]).cast(SAMPLE.schema)


def learn(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """A model of the labelled rows outside the held-out fold."""
    known = (
        labels.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")
        )
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(remainder(F.col("doc_id")) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    # So many rows of two numbers at most, which Spark may send to every task.
    known = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs), "labels")
    sample = (
        id_and_text(docs)
        .where(F.octet_length("text") <= FIT_BYTES)
        .join(F.broadcast(known), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
    )

    def train(batches: Batches) -> Batches:
        rows = pa.concat_tables([SAMPLE, *map(_table, batches)]).sort_by("doc_id")
        texts = pa.concat_arrays(rows.column("text").chunks)
        model = fit(texts, (rows.column("toxic").to_numpy() > 0).astype(float))
        packed = pa.array([model.weights.astype(np.float32).tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [packed, pa.array([model.bias]), pa.array([model.constant], pa.float64())],
            ["weights", "bias", "constant"],
        )

    out = schema(weights="binary", bias="double", constant="double")
    made = sample.select("doc_id", "toxic", "text").coalesce(1).mapInArrow(train, out).first()
    if made is None:
        return Model(np.zeros(NO_FEATURE + 1, np.float32), UNKNOWN, 0.0)
    return Model(np.frombuffer(made["weights"], np.float32), made["bias"], made["constant"])


def score(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Every document with its score, and its sentences that offend.

    ``n_sentences`` and ``n_offending`` count; ``worst_begin``, ``worst_end`` and
    ``worst_probability`` are of the sentence with the highest probability (null without
    sentences), its place in bytes of the UTF-8 text.
    """
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    rows = id_and_text(docs).select("doc_id", held_out.alias("held_out"), "text")
    # The model is a part of the task: a megabyte, whatever the data.
    model = learn(docs, labels, fit_docs)
    kinds = dict(
        doc_id="bigint",
        held_out="boolean",
        score="double",
        predicted="int",
        n_sentences="bigint",
        n_offending="bigint",
        worst_begin="bigint",
        worst_end="bigint",
        worst_probability="double",
    )

    def scored(batches: Batches) -> Batches:
        for batch in batches:
            for piece in spans.pieces(batch):
                n, found = piece.num_rows, sentences(piece.column("text"))
                scores = document_scores(found, model, n)
                odds = sentence_scores(found, model)
                first = np.searchsorted(found.row, np.arange(n + 1))
                worst, none = _worst(odds, found.row, first)
                at = np.where(none, 0, worst)
                chance = 1 / (1 + np.exp(-odds)) if len(odds) else np.zeros(1)
                begin, end = (found.begin, found.end) if len(odds) else (chance, chance)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        piece.column("held_out"),
                        pa.array(scores),
                        pa.array((scores >= 0.5).astype(np.int32)),
                        pa.array(np.diff(first)),
                        pa.array(np.bincount(found.row[odds >= 0], minlength=n)),
                        pa.array(begin[at].astype(np.int64), mask=none),
                        pa.array(end[at].astype(np.int64), mask=none),
                        pa.array(chance[at], mask=none),
                    ],
                    list(kinds),
                )

    return rows.mapInArrow(scored, schema(**kinds))


def _worst(odds: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document the sentence with the highest odds, and which documents have none."""
    by_odds = np.lexsort((-np.arange(len(odds)), odds, row))
    none = np.diff(first) == 0
    worst = np.zeros(len(none), np.int64)
    worst[~none] = by_odds[first[1:][~none] - 1]
    return worst, none


def locate(
    docs: DataFrame, labels: DataFrame, threshold: float = OFFENDING, fit_docs: int = FIT_DOCS
) -> DataFrame:
    """The offending sentences: ``doc_id``, its number, bytes, probability and text."""
    rows = id_and_text(docs)
    model = learn(docs, labels, fit_docs)
    kinds = dict(
        doc_id="bigint",
        sentence="bigint",
        begin="bigint",
        end="bigint",
        probability="double",
        text="string",
    )

    def located(batches: Batches) -> Batches:
        for batch in batches:
            for piece in spans.pieces(batch):
                found = sentences(piece.column("text"))
                chance = 1 / (1 + np.exp(-sentence_scores(found, model)))
                at = np.flatnonzero(chance >= threshold)
                first = np.searchsorted(found.row, np.arange(piece.num_rows))
                texts = piece.column("text")
                cut = [
                    texts[int(found.row[k])].as_py().encode()[found.begin[k] : found.end[k]].decode()
                    for k in at
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id").take(pa.array(found.row[at])),
                        pa.array(at - first[found.row[at]]),
                        pa.array(found.begin[at]),
                        pa.array(found.end[at]),
                        pa.array(chance[at]),
                        pa.array(cut, pa.string()),
                    ],
                    list(kinds),
                )

    return rows.mapInArrow(located, schema(**kinds))
