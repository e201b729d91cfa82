"""Lines that occur in several documents stay only in the document with the smallest id.

Two Bloom filters, for line hashes seen once and seen twice, find the lines that may repeat;
of the lines only these are shuffled, for the exact confirmation and the choice of the
document that keeps them. The texts are shuffled once, by id, to meet the keys that they
lose. A filter is cut into segments by hash, each built by one task from the hashes
that fall into it, so building is spread and a frequent line reaches its segment at most
twice per batch.

The broadcast filter has ``MAX_BITS`` bits at most. Beyond the corpus that this is sized for,
more lines pass the filter in vain; what is confirmed, and so the result, is the same.

A key is a line without the white space ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z in
lower case; keys shorter than ``min_chars`` code points are left alone. Keys are compared by
their 128-bit digests.

Defined results: a null or empty text is one empty line and stays as it is; a line repeated
inside one document only stays; rows with the same id are one document; a document without
an id stays as it is and does not count; all other columns pass, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import spans
from panelforge.llm.tables import id_and_text, schema
from panelforge.session import materialize

MIN_CHARS = 10
BITS_PER_LINE = 16
SEGMENT_BITS = 1 << 20
MAX_BITS = 1 << 29


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def is_long(key: bytes, min_chars: int) -> bool:
    """At least ``min_chars`` code points; a byte count decides most lines."""
    if len(key) < min_chars:
        return False
    return len(key) >= 4 * min_chars or len(key.decode()) >= min_chars


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _digests(batch: pa.RecordBatch, min_chars: int) -> Iterator[tuple[int, set[bytes]]]:
    """Ids and distinct key digests of the documents that have an id."""
    ids = batch.column("doc_id").to_pylist()
    data, bounds = spans.text_bytes(batch.column("text"))
    text, bounds = data.tobytes(), bounds.tolist()
    for doc_id, a, b in zip(ids, bounds[:-1], bounds[1:], strict=True):
        if doc_id is not None:
            keys = {line_key(line) for line in text[a:b].split(b"\n")}
            yield doc_id, {digest(key) for key in keys if is_long(key, min_chars)}


def _segment(high: np.ndarray, segments: int) -> np.ndarray:
    """The segment of digests by their first 64 bits."""
    return (high % np.uint64(segments)).astype(np.int32)


def _places(low: np.ndarray, size: int) -> list[np.ndarray]:
    """The two bits in a segment of ``size`` bits, by the other 64 bits."""
    both = (low, low >> np.uint64(32))
    return [(half % np.uint64(size)).astype(np.int64) for half in both]


def filter_shape(docs: DataFrame, max_bits: int) -> tuple[int, int]:
    """Segments of a filter and their bits, powers of two, by the number of lines."""
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    lines = docs.agg(F.sum(breaks + 1)).first()[0] or 0
    bits = min(max_bits, max(64, 1 << (BITS_PER_LINE * int(lines)).bit_length()))
    size = min(bits, SEGMENT_BITS)
    return bits // size, size


def twice_filter(docs: DataFrame, min_chars: int, segments: int, size: int) -> np.ndarray:
    """The filter of keys seen twice, one row of packed bits per segment.

    No key of two documents is missed: within a batch it is sent twice, and of two batches
    the later finds it seen once.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in spans.pieces(batch):
                seen: dict[bytes, int] = {}
                for _, found in _digests(piece, min_chars):
                    for key in found:
                        seen[key] = min(2, seen.get(key, 0) + 1)
                sent = b"".join(key * n for key, n in seen.items())
                halves = np.frombuffer(sent, "<u8").reshape(-1, 2)
                segment = _segment(halves[:, 0], segments)
                order = np.argsort(segment, kind="stable")
                names, starts = np.unique(segment[order], return_index=True)
                parts = np.split(halves[order, 1], starts[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int32()),
                        pa.array([p.tobytes() for p in parts[: len(names)]], pa.binary()),
                    ],
                    ["segment", "low"],
                )

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for name, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name not in once:
                    once[name], twice[name] = np.zeros(size, bool), np.zeros(size, bool)
                low, n = np.unique(np.frombuffer(low, "<u8"), return_counts=True)
                a, b = _places(low, size)
                again = (n > 1) | (once[name][a] & once[name][b])
                twice[name][a[again]] = True
                twice[name][b[again]] = True
                once[name][a] = True
                once[name][b] = True
        names = list(twice)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.int32()),
                pa.array([np.packbits(twice[n]).tobytes() for n in names], pa.binary()),
            ],
            ["segment", "bits"],
        )

    rows = (
        docs.select("doc_id", "text")
        .mapInArrow(dealt, schema(segment="int", low="binary"))
        .repartition(min(segments, 256), "segment")
        .mapInArrow(built, schema(segment="int", bits="binary"))
        .collect()
    )
    out = np.zeros((segments, size // 8), np.uint8)
    for row in rows:
        out[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return out


def suspects(docs: DataFrame, min_chars: int, max_bits: int) -> DataFrame:
    """doc_id and ``key`` of the lines whose hash passes the filter, once per document.

    The filter, of ``max_bits`` at most, goes through the driver as a whole.
    """
    segments, size = filter_shape(docs, max_bits)
    made = twice_filter(docs, min_chars, segments, size)
    sent = docs.sparkSession.sparkContext.broadcast(made)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in spans.pieces(batch):
                ids, keys = [], []
                for doc_id, found in _digests(piece, min_chars):
                    keys += found
                    ids += [doc_id] * len(found)
                halves = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
                segment, kept = _segment(halves[:, 0], segments), np.ones(len(ids), bool)
                for place in _places(halves[:, 1], size):
                    kept &= (sent.value[segment, place >> 3] >> (7 - (place & 7)) & 1).astype(bool)
                rows = pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"]
                )
                yield rows.filter(pa.array(kept))

    return docs.select("doc_id", "text").mapInArrow(passed, schema(doc_id="long", key="binary"))


def repeats(docs: DataFrame, min_chars: int, max_bits: int) -> DataFrame:
    """doc_id and ``keys``: the digests of the lines that the document loses.

    The suspects are written out because they are read twice, and so are the confirmed keys:
    with a table on both sides, Spark can split the rows of a frequent line.
    """
    docs = id_and_text(docs)
    found = materialize(suspects(docs, min_chars, max_bits), "suspects")
    ends = found.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    confirmed = ends.where(F.col("first") < F.col("last")).select("key", "first")
    confirmed = materialize(confirmed, "repeated")
    lost = found.join(confirmed, "key").where(F.col("doc_id") != F.col("first"))
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def _unused(docs: DataFrame, name: str) -> str:
    taken = {column.lower() for column in docs.columns}
    while name in taken:
        name += "_"
    return name


def _with_losses(docs: DataFrame, min_chars: int, max_bits: int) -> tuple[DataFrame, str]:
    """The documents with a further column of the keys they lose, and its name."""
    keys, id_ = _unused(docs, "_lost_keys"), _unused(docs, "_lost_id")
    lost = repeats(docs, min_chars, max_bits).toDF(id_, keys)
    # The losses are much smaller than the texts, which are so not sorted.
    joined = docs.join(lost.hint("shuffle_hash"), docs["doc_id"] == lost[id_], "left")
    return joined.drop(id_), keys


def _keep(text: bytes, lost: list[bytes] | None, min_chars: int) -> tuple[bytes, int]:
    """The text without the lost lines, and how many lines went."""
    if not lost:
        return text, 0
    gone, lines = set(lost), text.split(b"\n")
    kept = []
    for line in lines:
        key = line_key(line)
        if not is_long(key, min_chars) or digest(key) not in gone:
            kept.append(line)
    return b"\n".join(kept), len(lines) - len(kept)


def dedup(
    docs: DataFrame, min_chars: int = MIN_CHARS, max_bits: int = MAX_BITS
) -> DataFrame:
    """The documents with their remaining lines as ``text``; other columns as they were."""
    names = docs.columns
    marked, keys = _with_losses(docs, min_chars, max_bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            lost = batch.column(keys).to_pylist()
            text = batch.column(at).to_pylist()
            for row, gone in enumerate(lost):
                if gone and text[row]:
                    text[row] = _keep(text[row].encode(), gone, min_chars)[0].decode()
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != keys]
            columns[at] = pa.array(text, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return marked.mapInArrow(cut, docs.schema)


def report(
    docs: DataFrame, min_chars: int = MIN_CHARS, max_bits: int = MAX_BITS
) -> DataFrame:
    """Per document: its lines before, the lines dropped and the digest of what is kept."""
    docs = id_and_text(docs)
    marked, keys = _with_losses(docs, min_chars, max_bits)
    out = schema(doc_id="long", n_lines="long", n_dropped="long", kept_sha256="string")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = spans.text_bytes(batch.column("text"))
            raw, bounds = data.tobytes(), bounds.tolist()
            lost = batch.column(keys).to_pylist()
            rows = []
            for a, b, gone in zip(bounds[:-1], bounds[1:], lost, strict=True):
                kept, n = _keep(raw[a:b], gone, min_chars)
                rows.append((raw.count(b"\n", a, b) + 1, n, hashlib.sha256(kept).hexdigest()))
            lines, dropped, sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(lines, pa.int64()),
                    pa.array(dropped, pa.int64()),
                    pa.array(sha, pa.string()),
                ],
                out.names,
            )

    return marked.mapInArrow(counted, out)


ORACLE = """
WITH lines AS (
  SELECT doc_id, pos, line, lower_az(line) AS key FROM (
    SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line FROM (
      SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), repeated AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.*, r.key IS NOT NULL AND l.doc_id <> r.first AS gone
  FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""".replace(
    "lower_az(line)",
    "translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",
)
