import math
import random
import zlib

import numpy as np
import odd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from panelforge.llm import toxicity
from panelforge.llm.tables import read

LABELS = "doc_id long, toxic int, quality int"


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def plain_sentences(text):
    """Words of each sentence, one character at a time."""
    raw, out, words, word = (text or "").encode(), [], [], b""

    def close():
        for k in range(0, len(words), toxicity.MOST_WORDS):
            out.append(words[k : k + toxicity.MOST_WORDS])

    for k, byte in enumerate(raw):
        char = raw[k : k + 1]
        if byte >= 0x80 or char.isalnum():
            word += char.lower()
            continue
        if word:
            words.append(word)
        word = b""
        last = raw[k + 1 : k + 2]
        if char == b"\n" or (char in b".!?" and (not last or last in b" \t\n\x0b\x0c\r")):
            close()
            words = []
    if word:
        words.append(word)
    close()
    return out


def plain_score(text, model):
    """The noisy-or with one word and feature at a time."""
    clean = 1.0
    for words in plain_sentences(text):
        odds = model.bias
        for word in words:
            data = np.frombuffer(word + bytes(8), np.uint8)
            for f in toxicity._features(data, np.array([0]), np.array([len(word)]))[0]:
                odds += float(model.weights[f])
        clean *= 1 - 1 / (1 + math.exp(-odds))
    return 1 - clean


def made_docs(n=1500, seed=4):
    """(doc_id, text, toxic): toxic ones hold a bad word in one of several sentences."""
    draw = random.Random(seed)
    plain = [f"word{k}" for k in range(60)]
    rows = []
    for i in range(n):
        lines = [" ".join(draw.choices(plain, k=draw.randrange(3, 40))) for _ in range(draw.randrange(1, 9))]
        bad = draw.random() < 0.25
        if bad:
            at = draw.randrange(len(lines))
            lines[at] += draw.choice([" Rotten", " vile,", " gruesigling", " gruesiglich"])
        rows.append((i, ". ".join(lines) + draw.choice([".", "!", "\n", ""]), int(bad)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = made_docs()
    labels = np.array([float(r[2]) for r in rows])
    return toxicity.fit(pa.array([r[1] for r in rows]), labels)


def test_scores_equal_plain_ones(model):
    texts = [text for _, text in odd.texts()] + [r[1] for r in made_docs(60, 9)]
    texts += ["3.5 is fine. Really?Yes! no\n\n.end", "a. b", "x " * 100, "...", "Ünlü. Söz"]
    found = toxicity.sentences(pa.array(texts))
    wanted = [len(plain_sentences(t)) for t in texts]
    assert np.bincount(found.row, minlength=len(texts)).tolist() == wanted
    scores = toxicity.document_scores(found, model, len(texts))
    assert np.allclose(scores, [plain_score(t, model) for t in texts], atol=1e-9)


def test_gradient_of_the_noisy_or():
    """One step on one toxic document blames sentences by the derivative of its loss."""
    text = "alpha beta. gamma delta epsilon"
    found = toxicity.sentences(pa.array([text]))
    weights = np.random.default_rng(0).normal(0, 0.1, toxicity.NO_FEATURE + 1)
    weights[-1] = 0

    def loss(w, toxic):
        p = toxicity.document_scores(found, toxicity.Model(w, -1.0), 1)[0]
        return -math.log(p if toxic else 1 - p)

    odds = toxicity.sentence_scores(found, toxicity.Model(weights, -1.0))
    doubt = np.logaddexp(0, odds).sum()
    for toxic in (0, 1):
        blame = (1 - toxic) - toxic / math.expm1(doubt)
        for word, sentence in ((0, 0), (2, 1)):
            feature = found.features[word, 0]
            moved = weights.copy()
            moved[feature] += 1e-6
            slope = (loss(moved, toxic) - loss(weights, toxic)) / 1e-6
            assert abs(slope - blame / (1 + math.exp(-odds[sentence]))) < 1e-4


def test_learns_and_locates(spark):
    rows = made_docs()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2], 1) for r in rows], LABELS)
    got = toxicity.score(docs, labels).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r["held_out"]]
    assert sorted(r["doc_id"] for r in held) == [i for i in truth if fold(i) == 0]
    wrong = [r for r in held if r["predicted"] != truth[r["doc_id"]]]
    assert len(wrong) <= 0.04 * len(held)
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) for r in got)
    texts = {r[0]: r[1].encode() for r in rows}
    bad = (b"rotten", b"vile", b"gruesig")
    right = [r for r in got if r["predicted"] and truth[r["doc_id"]]]
    worst = [texts[r["doc_id"]][r["worst_begin"] : r["worst_end"]].lower() for r in right]
    assert sum(any(w in text for w in bad) for text in worst) >= 0.97 * len(worst)
    sentences = toxicity.locate(docs, labels).collect()
    hits = [s for s in sentences if any(w in s["text"].lower().encode() for w in bad)]
    assert len(hits) >= 0.95 * len(sentences) and len(hits) >= 0.8 * sum(truth.values())
    for s in sentences[:50]:
        assert texts[s["doc_id"]][s["begin"] : s["end"]].decode() == s["text"]


def test_held_out_labels_change_nothing(spark):
    docs = read(spark, odd.SF, "documents")
    labels = read(spark, odd.SF, "labels")
    kept = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    held = toxicity.remainder(labels["doc_id"]) == 0
    changed = labels.withColumn("toxic", (1 - labels["toxic"]) * held.cast("int") + labels["toxic"] * (~held).cast("int"))
    changed = changed.withColumn("toxic", changed["toxic"].cast("int"))
    again = toxicity.score(docs.repartition(7), changed.repartition(3)).collect()
    assert {r["doc_id"]: r["score"] for r in again} == kept


def test_odd_documents(spark, docs, no_docs):
    labels = spark.createDataFrame([(7, 1, 0), (8, None, 1), (13, 0, 1), (None, 1, 1), (20, 0, 0), (20, 1, 0)], LABELS)
    got = toxicity.score(docs, labels).collect()
    assert odd.ordered(r["doc_id"] for r in got) == odd.ordered(i for i, _ in odd.texts())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3, 19):
        assert by_id[i]["score"] == 0 and by_id[i]["n_sentences"] == 0 and by_id[i]["worst_begin"] is None
    assert all(r["held_out"] == (fold(r["doc_id"]) == 0 if r["doc_id"] is not None else False) for r in got)
    assert toxicity.score(no_docs, labels).collect() == []
    none = labels.limit(0)
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.locate(docs, none).collect() == []
    only = spark.createDataFrame([(13, 0, 1)], LABELS)
    assert {r["predicted"] for r in toxicity.score(docs, only).collect()} == {0}


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    return (rank[labels == 1].mean() - (labels.sum() - 1) / 2) / (labels == 0).sum()


def test_held_out_accuracy():
    folder = "/root/testdata/sf0.1"
    labels = pq.read_table(f"{folder}/labels.parquet").to_pydict()
    toxic = dict(zip(labels["doc_id"], labels["toxic"], strict=True))
    table = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    texts = dict(zip(*(c.to_pylist() for c in table.columns), strict=True))
    known = [i for i in sorted(toxic) if fold(i)]
    model = toxicity.fit(pa.array([texts[i] for i in known]), np.array([float(toxic[i]) for i in known]))
    held = [i for i in sorted(toxic) if not fold(i)]
    found = toxicity.sentences(pa.array([texts[i] for i in held]))
    scores, truth = toxicity.document_scores(found, model, len(held)), np.array([toxic[i] for i in held])
    said = scores >= 0.5
    assert auc(scores, truth) > 0.95
    assert (said == truth).mean() > 0.95 and truth[said].mean() > 0.9
