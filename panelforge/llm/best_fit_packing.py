"""Documents packed into sequences of bounded length by bound-certified best fit.

Pieces are spread at random over partitions of bounded size and packed there by best-fit
decreasing. Dual feasible functions give a lower bound on a partition's number of sequences;
a partition that meets it is certified, since no packing of its pieces has fewer. The others
give up the pieces of all sequences with room left, and certified ones those of their
emptiest sequence; these pieces are spread anew, so that partitions exchange documents, and
best-fit decreasing runs again. Rounds go on, whatever the number of partitions, until what
is at stake is one certified partition or a round saves next to nothing (``LEAST_SAVING``); a
round that saves no sequence is not taken. ``certified`` tells which sequences are of partitions that
met their bound, and ``overview`` holds the sequences against a bound for all pieces.

Only documents longer than a sequence are cut. Every document ends with ``END_ID``.

Defined results: a null or empty text is the end token alone; rows with the same id, and
rows without one, are packed each on its own; other columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import spans
from panelforge.llm.tables import id_and_text, schema, vocabulary
from panelforge.llm.word_bpe import ID, WordBpe, loaded
from panelforge.session import materialize

LENGTH = 4096
END_ID = 1
# Pieces in a partition; one task packs a partition.
ROWS_PER_PARTITION = 50_000
# Numbers for the sequences of a partition, of which it has no more than pieces.
IDS_PER_PARTITION = 1 << 24
# Share of the sequences at stake that a round has to save for another one to follow.
LEAST_SAVING = 1e-5
# Words that a worker remembers, and their ids; 80 MB at most.
KNOWN_WORDS, KNOWN_IDS = 1 << 20, 1 << 23
# Largest parameter of the rounding dual feasible functions.
MAX_K = 64

PIECE = {
    "doc_id": "long",
    "piece": "int",
    "start": "long",
    "length": "long",
    "ids_crc32": "long",
}


class KnownIds:
    """Token ids of the words met so far, in arrays: about 40 bytes a word.

    A word is known by its 64-bit hash together with its first eight bytes and its length.
    Beyond ``limit`` words or ``ids_limit`` ids the memory begins anew.
    """

    def __init__(self, bpe: WordBpe, limit: int = KNOWN_WORDS, ids_limit: int = KNOWN_IDS):
        self._bpe, self._limit, self._ids_limit = bpe, limit, ids_limit
        self._clear()

    def _clear(self) -> None:
        self._hash, self._check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self._start, self._n = np.empty(0, np.int64), np.empty(0, np.int64)
        self._ids = np.empty(0, ID)

    def of(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple:
        """All ids, and where those of each span begin in them and how many they are.

        The spans are distinct and come by ascending hash.
        """
        check = spans.first_bytes(data, begin, end) ^ spans.mixed((end - begin).astype(np.uint64))
        at = np.searchsorted(self._hash, h)
        here = np.minimum(at, max(0, len(self._hash) - 1))
        if len(self._hash):
            known = (self._hash[here] == h) & (self._check[here] == check)
        else:
            known = np.zeros(len(h), bool)
        start, n = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        start[known], n[known] = self._start[here[known]], self._n[here[known]]
        new = np.flatnonzero(~known)
        text = data.tobytes()
        ends = zip(begin[new].tolist(), end[new].tolist(), strict=True)
        made = self._bpe.encode_pieces([text[a:b] for a, b in ends])
        n[new] = np.fromiter(map(len, made), np.int64, len(made)) // ID.itemsize
        start[new] = len(self._ids) + np.cumsum(n[new]) - n[new]
        ids = np.concatenate([self._ids, np.frombuffer(b"".join(made), ID)])
        if len(self._hash) + len(new) > self._limit or len(ids) > self._ids_limit:
            self._clear()
        else:
            self._ids = ids
            for name, values in (
                ("_hash", h), ("_check", check), ("_start", start), ("_n", n)
            ):
                setattr(self, name, np.insert(getattr(self, name), at[new], values[new]))
        return ids, start, n


@lru_cache(maxsize=1)
def known_ids(path: str) -> KnownIds:
    """What a worker knows of a vocabulary file."""
    return KnownIds(loaded(path))


def encoded(
    data: np.ndarray, bounds: np.ndarray, known: KnownIds
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after another, and where each row begins in them.

    Every distinct word of the rows is looked up once; the ids are then gathered by word.
    """
    words = spans.find_words(data, bounds)
    h = spans.hash_spans(data, words.begin, words.end)
    kinds, first, kind = np.unique(h, return_index=True, return_inverse=True)
    ids, start, n = known.of(data, words.begin[first], words.end[first], kinds)
    start, n = start[kind], n[kind]
    after = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(start - after[:-1], n) + np.arange(after[-1])
    return ids[at], after[np.append(words.first, len(h))]


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """The documents' token ids, cut into pieces of at most ``length``."""
    out = schema(**PIECE)
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_ids(vocabulary(path))
        for batch in batches:
            for part in spans.pieces(batch):
                data, bounds = spans.text_bytes(part.column("text"))
                all_ids, ends = encoded(data, bounds, known)
                doc_ids, ends, rows = part.column("doc_id").to_pylist(), ends.tolist(), []
                for doc_id, a, b in zip(doc_ids, ends[:-1], ends[1:], strict=True):
                    ids = memoryview(all_ids[a:b].tobytes() + end)
                    for k, start in enumerate(range(0, len(ids), 4 * length)):
                        own = ids[start : start + 4 * length]
                        rows.append((doc_id, k, start // 4, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(out.names, row, strict=True)) for row in rows], ARROW_PIECE
                )

    return id_and_text(docs).mapInArrow(cut, out)


ARROW_PIECE = pa.schema(
    [(name, pa.int32() if kind == "int" else pa.int64()) for name, kind in PIECE.items()]
)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Sequences that any packing needs."""
    if not len(lengths):
        return 0
    return bound_of_counts(np.bincount(lengths, minlength=size + 1), size)


def bound_of_counts(count: np.ndarray, size: int) -> int:
    """The same from the number of pieces by length, by two families of dual feasible functions.

    One rounds up what is longer than ``size - t`` and drops what is shorter than ``t``, for
    every t up to half a sequence; the other rounds ``(k + 1) x / size`` down for k up to
    ``MAX_K``.
    """
    count = count.astype(np.int64)
    value = np.arange(size + 1, dtype=np.int64)
    counts, sums = np.cumsum(count), np.cumsum(count * value)
    t = np.arange(size // 2 + 1)
    large = counts[size] - counts[size - t]
    below = np.where(t > 0, sums[np.maximum(t - 1, 0)], 0)
    best = int((-(-(large * size + sums[size - t] - below) // size)).max())
    for k in range(1, MAX_K + 1):
        exact = (k + 1) * value % size == 0
        # Values times k * size, so that all stay whole numbers.
        rounded = np.where(exact, k * value, (k + 1) * value // size * size)
        best = max(best, int(-(-int((count * rounded).sum()) // (k * size))))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the room left in each bin.

    Pieces come by descending length, each into the bin with the least room that holds it.
    Bins are kept by their room; a bit mask of the rooms in use finds the least one.
    """
    bins, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = used >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            where = by_room[free].pop()
            if not by_room[free]:
                used ^= 1 << free
        else:
            free, where = size, len(room)
            room.append(size)
        bins[i], offset[i] = where, size - free
        room[where] = free - n
        by_room[free - n].append(where)
        used |= 1 << (free - n)
    return bins, offset, np.array(room, np.int64)


def _packer(size: int, first_id: int) -> Callable[[pa.Table], pa.Table]:
    def packed(table: pa.Table) -> pa.Table:
        return _pack_partition(table, size, first_id)

    return packed


def _pack_partition(table: pa.Table, size: int, first_id: int) -> pa.Table:
    """Pack one partition; ``open`` marks the pieces that it gives up."""
    part = table.column("_part")[0].as_py()
    table = table.drop_columns(["_part"]).sort_by(
        [(name, "ascending") for name in ("doc_id", "piece", "start", "ids_crc32")]
    )
    lengths = table.column("length").to_numpy()
    bins, offset, room = best_fit(lengths, size)
    certified = len(room) <= lower_bound(lengths, size)
    if not certified:
        opened = room > 0
    else:
        opened = np.zeros(len(room), bool)
        opened[room.argmax()] = room.max() > 0
    for name, values in (
        ("sequence_id", first_id + part * IDS_PER_PARTITION + bins),
        ("offset", offset),
        ("certified", np.full(len(bins), certified)),
        ("open", opened[bins]),
    ):
        table = table.append_column(name, pa.array(values))
    return table


def _partitions(n: int, per_partition: int) -> int:
    return max(1, -(-n // per_partition))


def _spread(rows: DataFrame, n: int, per_partition: int) -> DataFrame:
    """Random partitions, also for rows that are all alike; one row more or less is no matter."""
    parts = _partitions(n, per_partition)
    random = F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())
    return rows.withColumn("_part", F.pmod(random, F.lit(parts)))


def pack_pieces(
    cut: DataFrame, size: int = LENGTH, per_partition: int = ROWS_PER_PARTITION
) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    Every round is written out: its rows are read twice, by what stays and by what goes on.
    """
    packed = schema(
        **PIECE, sequence_id="long", offset="long", certified="boolean", open="boolean"
    )
    rows, settled, before, first_id = materialize(cut, "pieces"), [], None, 0
    while True:
        n = rows.count()
        made = materialize(
            _spread(rows.select(*PIECE), n, per_partition)
            .groupBy("_part")
            .applyInArrow(_packer(size, first_id), packed),
            "packed",
        )
        at_stake = made.agg(
            F.count_distinct("sequence_id").alias("sequences"),
            F.coalesce(F.bool_and("certified"), F.lit(True)).alias("certified"),
        ).first()
        if before is not None and at_stake["sequences"] >= before:
            # Nothing saved: what the round before gave up stays where it was.
            settled.append(rows)
            break
        little = before is not None and before - at_stake["sequences"] < LEAST_SAVING * before
        if little or (at_stake["certified"] and n <= per_partition):
            # All pieces at stake are in one partition that met its bound, or near to it.
            settled.append(made)
            break
        settled.append(made.where(~F.col("open")))
        rows = made.where("open")
        before = rows.select("sequence_id").distinct().count()
        first_id += _partitions(n, per_partition) * IDS_PER_PARTITION
    out = reduce(DataFrame.unionByName, settled)
    return out.select(*PIECE, "sequence_id", "offset", "certified")


def overview(packed: DataFrame, size: int = LENGTH) -> DataFrame:
    """One row: the sequences, those of certified partitions, and a bound for all pieces."""
    # One row per length.
    lengths = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    count = np.zeros(size + 1, np.int64)
    for row in lengths:
        count[row["length"]] = row["n"]
    bound = bound_of_counts(count, size) if lengths else 0
    own = F.when(F.col("certified"), F.col("sequence_id"))
    return packed.agg(
        F.count_distinct("sequence_id").alias("sequences"),
        F.count_distinct(own).alias("certified"),
        F.lit(bound).cast("long").alias("bound"),
    )


def pack(docs: DataFrame, size: int = LENGTH, path: str | None = None) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack_pieces(pieces(docs, size, path), size)
