import hashlib
from collections import Counter

import numpy as np
import odd
import pyarrow as pa

from panelforge.llm import fingerprints as prints


def ordered_rows(rows):
    """By id, a null first; equal ids as the operator put them are compared as a set below."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_odd_documents(docs):
    rows = [(i, t or "") for i, t in odd.texts()]
    got = prints.fingerprint(docs).collect()
    assert odd.ordered((r["doc_id"], r["n_chars"]) for r in got) == odd.ordered(
        (i, len(t)) for i, t in rows
    )
    check(rows, got)


def test_corpus(small):
    check(small[1], prints.fingerprint(small[0]).collect())


def check(rows, got):
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(t)
    order = [i for i in sorted(by_id, key=lambda i: (i is not None, i or 0))]
    seen, found = {}, {r["doc_id"]: r for r in got if len(by_id[r["doc_id"]]) == 1}
    for k, i in enumerate(order):
        following = by_id[order[(k + 1) % len(order)]]
        if i not in found or len(set(following)) > 1:
            continue
        text, r = by_id[i][0], found[i]
        changed = prints.edited(text, following[0])
        q = len(text) // 4
        assert changed == text[: len(text) - q] + following[0][:q]
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert seen.setdefault(changed, r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert r["near_edited"] == likeness(r["fingerprint"], r["edited_fingerprint"], text, changed)
        other = seen.get(following[0])
        if other:
            assert r["near_next"] == likeness(r["fingerprint"], other, text, following[0])
    assert len(found) > 20


def likeness(a, b, x, y):
    if not x.encode().split() or not y.encode().split():
        return float(bool(x.encode().split()) == bool(y.encode().split()))
    a, b = (np.frombuffer(bytes.fromhex(s), np.uint16) for s in (a, b))
    return (a == b).mean()


def test_estimate_is_the_generalised_jaccard_similarity():
    """Texts of weighted words at known similarities, with many samples."""
    draw = np.random.default_rng(4)
    words = [f"word{k}" for k in range(60)]
    pairs = []
    for _ in range(40):
        x = draw.integers(0, 6, 60)
        y = np.where(draw.random(60) < draw.random(), x, draw.integers(0, 6, 60))
        pairs.append([Counter(dict(zip(words, v.tolist()))) for v in (x, y)])
    texts = [" ".join(c.elements()) for pair in pairs for c in pair]
    marks, filled = prints.signatures(pa.array(texts), 2048)
    got = prints.likeness(marks[::2], marks[1::2], filled[::2], filled[1::2])
    true = [sum((x & y).values()) / sum((x | y).values()) for x, y in pairs]
    error = got - np.array(true)
    assert abs(error.mean()) < 0.005
    assert abs(error).max() < 0.05


def test_single_row_and_empty_table(spark, no_docs):
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    (row,) = prints.fingerprint(one).collect()
    assert row["near_next"] == 1.0
    assert prints.fingerprint(no_docs).collect() == []


def plain_signature(text, samples):
    """Consistent weighted sampling with one term and one sample at a time."""
    white = " \t\n\x0b\x0c\r"
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in white:
        lowered = lowered.replace(c, " ")
    weights = Counter(w for w in lowered.split(" ") if w)
    if not weights:
        return [0] * samples
    mixed, one = prints.spans.mixed, np.uint64(1)

    def uniform(bits):
        return (np.float32(int(bits)) + np.float32(0.5)) * np.float32(2.0**-32)

    out = []
    for k in range(samples):
        best = None
        for word, weight in weights.items():
            data = np.frombuffer(word.encode() + bytes(8), np.uint8)
            ends = np.array([0]), np.array([len(word.encode())])
            term = prints.spans.hash_spans(data, *ends)
            first = mixed(term ^ mixed(np.array([k + 1], np.uint64)))
            draws = [first, mixed(first + one), mixed(first + np.uint64(2))]
            halves = [(int(d[0]) & 0xFFFFFFFF, int(d[0]) >> 32) for d in draws]
            r = -np.log(uniform(halves[0][0]) * uniform(halves[0][1]))
            c = -np.log(uniform(halves[1][0]) * uniform(halves[1][1]))
            beta = uniform(halves[2][0])
            t = np.floor(np.log(np.float32(weight)) / r + beta)
            a = np.log(c) - r * (t - beta) - r
            name = mixed(term + mixed(np.array([int(t)], np.int64).view(np.uint64)))
            drawn = (float(a), int(name[0]) & 0xFFFFFFFF)
            best = drawn if best is None else min(best, drawn)
        out.append(best[1] & 0xFFFF)
    return out


def test_signatures_equal_plain_sampling():
    """Ties and rounding apart, which could move a sample, all samples are the plain ones."""
    texts = [t for _, t in odd.texts() if t is None or len(t) < 1200][:24]
    texts += ["a a a b b c", "A\ta\nB", "é É é", "x " * 300]
    marks, _ = prints.signatures(pa.array(texts, pa.large_string()), 16)
    same = [m.tolist() == plain_signature(t, 16) for m, t in zip(marks, texts, strict=True)]
    equal = sum(
        a == b
        for m, t in zip(marks, texts, strict=True)
        for a, b in zip(m.tolist(), plain_signature(t, 16), strict=True)
    )
    assert equal >= len(texts) * 16 - 1 and sum(same) >= len(texts) - 1
