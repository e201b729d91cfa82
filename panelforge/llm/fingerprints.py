"""Document fingerprints by consistent weighted sampling.

Terms are words, weighted by how often they occur in the text. For every sample a term draws
its own ``r`` and ``c`` from Gamma(2, 1) and ``beta`` from [0, 1) by hashing; with
``t = floor(ln w / r + beta)`` and ``ln a = ln c - r (t - beta) - r`` the sample is the pair
(term, t) of the least ``a``. Two texts agree in a sample with the probability
``sum(min(w, v)) / sum(max(w, v))``, the generalised Jaccard similarity of their weights.

Every document is paired with the one of the next id. The documents are put in order by
ranges; inside a range a task walks through them, and the pairs across two ranges, one per
range, are made in a second step.

Defined results: a null text is the empty one; a text without words has the fingerprint of
zeros, is equal to its like and unlike all others; rows without an id come first; rows with
the same id follow each other in the order of a hash of their texts, then of the texts;
after the last row comes the first, which for a single row is itself; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm import spans
from panelforge.llm.tables import id_and_text, schema
from panelforge.session import materialize

SAMPLES = 64
ROWS_PER_RANGE = 200_000
# Entries of (text, term) pairs, and of terms, that are worked on at a time; few enough that
# their samples stay in a core's cache.
PAIRS_AT_ONCE, TERMS_AT_ONCE = 1 << 11, 1 << 9

RESULT = {
    "doc_id": "long",
    "n_chars": "long",
    "edited_sha256": "string",
    "fingerprint": "string",
    "edited_fingerprint": "string",
    "near_edited": "double",
    "near_next": "double",
}


def _uniform(bits: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 32 bits."""
    return (bits.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)


def _draws(term: np.ndarray, log_weight: np.ndarray, samples: int) -> np.ndarray:
    """For each (term, weight) and sample: ``ln a`` in the high, the pair's name in the low bits.

    Packed so that the least number has the least ``a``.
    """
    low = np.uint64(0xFFFFFFFF)
    seeds = spans.mixed(np.arange(1, samples + 1, dtype=np.uint64))
    base = spans.mixed(term[:, None] ^ seeds[None, :])
    second, third = spans.mixed(base + np.uint64(1)), spans.mixed(base + np.uint64(2))
    r = -np.log(_uniform(base & low) * _uniform(base >> np.uint64(32)))
    c = -np.log(_uniform(second & low) * _uniform(second >> np.uint64(32)))
    beta = _uniform(third & low)
    t = np.floor(log_weight[:, None] / r + beta)
    a = np.log(c) - r * (t - beta) - r
    bits = a.astype(np.float32).view(np.uint32)
    ordered = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
    name = spans.mixed(term[:, None] + spans.mixed(t.astype(np.int64).view(np.uint64)))
    return ordered.astype(np.uint64) << np.uint64(32) | (name & low)


def signatures(column: pa.Array, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Per text: 16 bits of each sampled pair, and whether it has words.

    Terms met in several texts are drawn once.
    """
    data, bounds = spans.text_bytes(column, lower=True)
    words = spans.find_words(data, bounds)
    h = spans.hash_spans(data, words.begin, words.end)
    row = np.repeat(np.arange(len(column), dtype=np.int64), words.count)
    kinds, kind = np.unique(h, return_inverse=True)
    pair, weight = np.unique(row * len(kinds) + kind, return_counts=True)
    row, kind = pair // max(1, len(kinds)), pair % max(1, len(kinds))
    # Equal weights of a term are one item.
    items, item = np.unique(kind * (int(weight.max(initial=0)) + 1) + weight, return_inverse=True)
    first = np.zeros(len(items), np.int64)
    first[item] = np.arange(len(item))
    term, log_weight = kinds[kind[first]], np.log(weight[first]).astype(np.float32)
    drawn = np.empty((len(items), samples), np.uint64)
    for at in range(0, len(items), TERMS_AT_ONCE):
        part = slice(at, at + TERMS_AT_ONCE)
        drawn[part] = _draws(term[part], log_weight[part], samples)
    out = np.full((len(column), samples), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(row), PAIRS_AT_ONCE):
        own = row[at : at + PAIRS_AT_ONCE]
        names, starts = np.unique(own, return_index=True)
        least = np.minimum.reduceat(drawn[item[at : at + PAIRS_AT_ONCE]], starts, axis=0)
        out[names] = np.minimum(out[names], least)
    filled = words.count > 0
    out[~filled] = 0
    return (out & np.uint64(0xFFFF)).astype(np.uint16), filled


def likeness(a: np.ndarray, b: np.ndarray, filled_a: np.ndarray, filled_b: np.ndarray):
    """Share of equal samples; texts without words are like each other only."""
    same = (a == b).mean(1)
    return np.where(filled_a & filled_b, same, (filled_a == filled_b).astype(float))


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _results(ids: list, texts: list[str], samples: int, ring: bool = False) -> list[pa.Array]:
    """Columns of ``RESULT`` for all texts but the last, each followed by the next.

    With ``ring``, texts come as (text, following) pairs instead.
    """
    if ring:
        texts, following = texts[::2], texts[1::2]
    else:
        texts, following = texts[:-1], texts[1:]
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    n = len(texts)
    last = following if ring else following[-1:]
    marks, filled = signatures(pa.array([*texts, *last, *changed], pa.large_string()), samples)
    own, other = slice(0, n), slice(n + len(last), None)
    after = slice(n, 2 * n) if ring else slice(1, n + 1)
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(text) for text in texts], pa.int64()),
        pa.array([hashlib.sha256(text.encode()).hexdigest() for text in changed]),
        pa.array([mark.tobytes().hex() for mark in marks[own]]),
        pa.array([mark.tobytes().hex() for mark in marks[other]]),
        pa.array(likeness(marks[own], marks[other], filled[own], filled[other])),
        pa.array(likeness(marks[own], marks[after], filled[own], filled[after])),
    ]


def _walk(samples: int):
    """Results of a sorted range; its first and last text for the pairs across ranges."""
    names = [*RESULT, "range", "side", "text"]

    def end(part: int, side: str, doc_id: int | None, text: str) -> pa.RecordBatch:
        blank = [
            pa.nulls(1, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[k])
            for k in RESULT.values()
        ]
        blank[0] = pa.array([doc_id], pa.int64())
        rest = [pa.array([part], pa.int32()), pa.array([side]), pa.array([text], pa.string())]
        return pa.RecordBatch.from_arrays([*blank, *rest], names)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried_id, carried, part = None, None, None
        for batch in batches:
            for piece in spans.pieces(batch):
                ids = piece.column("doc_id").to_pylist()
                texts = piece.column("text").to_pylist()
                if carried is None:
                    part = piece.column("range")[0].as_py()
                    yield end(part, "first", ids[0], texts[0])
                else:
                    ids, texts = [carried_id, *ids], [carried, *texts]
                carried_id, carried = ids[-1], texts[-1]
                if len(ids) > 1:
                    made = _results(ids[:-1], texts, samples)
                    n = len(ids) - 1
                    rest = [pa.nulls(n, kind) for kind in (pa.int32(), pa.string(), pa.string())]
                    yield pa.RecordBatch.from_arrays([*made, *rest], names)
        if carried is not None:
            yield end(part, "last", carried_id, carried)

    return walked


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are."""
    spark = docs.sparkSession
    docs = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    ranges = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // ROWS_PER_RANGE)
    )
    ordered = (
        docs.withColumns({"h": F.xxhash64("text"), "spread": F.monotonically_increasing_id()})
        .repartitionByRange(ranges, "doc_id", "h", "spread")
        .sortWithinPartitions("doc_id", "h", "text")
        .select("doc_id", "text", F.spark_partition_id().alias("range"))
    )
    walked = materialize(
        ordered.mapInArrow(_walk(samples), schema(**RESULT, range="int", side="string", text="string")),
        "walked",
    )
    # One row per range from here.
    lasts = walked.where(F.col("side") == "last").select("doc_id", "text", "range")
    firsts = walked.where(F.col("side") == "first")
    firsts = firsts.select(F.col("text").alias("following"), F.col("range").alias("next_range"))
    order = Window.orderBy("range")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    following = lasts.select(
        "range",
        F.coalesce(F.lead("range").over(order), F.min("range").over(so_far)).alias("next_range"),
    )
    out = schema(**RESULT)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in spans.pieces(batch):
                pairs = zip(
                    piece.column("text").to_pylist(),
                    piece.column("following").to_pylist(),
                    strict=True,
                )
                texts = [text for pair in pairs for text in pair]
                ids = piece.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    _results(ids, texts, samples, ring=True), out.names
                )

    joined = lasts.join(following, "range").join(firsts, "next_range")
    inside = walked.where(F.col("side").isNull()).select(*RESULT)
    return inside.unionByName(
        joined.select("doc_id", "text", "following").mapInArrow(across, out)
    )
