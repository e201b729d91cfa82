"""Words of Arrow text columns as byte spans, and their hashes, in numpy.

A batch is worked on in pieces of bounded text, so that memory does not follow the number
of rows in a batch. White space is the six ASCII characters ``[\\x20\\x09-\\x0D]``; their
bytes never occur inside a longer UTF-8 character.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE_BYTES = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

# Odd constants of the hashes, from the golden ratio and the murmur finalizer.
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


class Words(NamedTuple):
    """Word hashes in order; ``first[i]`` is the first word of row i, ``count[i]`` its words."""

    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    count: np.ndarray


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, each of one row or up to ``PIECE_BYTES`` of text."""
    at = batch.column(column)
    sizes = np.diff(offsets(at))
    start, size = 0, 0
    for row, n in enumerate(sizes.tolist()):
        if row > start and size + n > PIECE_BYTES:
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    width = np.dtype(kind).itemsize
    buffer = column.buffers()[1]
    if buffer is None or buffer.size == 0:
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(buffer, kind, len(column) + 1, column.offset * width).astype(np.int64)


def text_bytes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All text bytes, with 8 bytes of padding, and the rows' offsets; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    bounds = offsets(column)
    size = int(bounds[-1] - bounds[0])
    data = np.zeros(size + 8, np.uint8)
    buffer = column.buffers()[2]
    if size:
        data[:size] = np.frombuffer(buffer, np.uint8, size, int(bounds[0]))
        if lower:
            data[:size] = LOWER[data[:size]]
    return data, bounds - bounds[0]


def split_rows(text: bytes, bounds: np.ndarray) -> tuple[list[bytes], list[int]]:
    """The words of all rows in one list, and where in it each row begins and ends."""
    bounds, words, ends = bounds.tolist(), [], [0]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        words += text[a:b].split()
        ends.append(len(words))
    return words, ends


def find_words(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Spans of the words of each row; ``space`` marks the bytes between them."""
    size = int(bounds[-1])
    solid = ~space[data[:size]]
    left, right = solid.copy(), solid.copy()
    left[1:] &= ~solid[:-1]
    right[:-1] &= ~solid[1:]
    filled = bounds[1:] > bounds[:-1]
    heads, tails = bounds[:-1][filled], bounds[1:][filled] - 1
    left[heads] = solid[heads]
    right[tails] = solid[tails]
    begin, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    first = np.searchsorted(begin, bounds)
    return Words(begin, end, first[:-1], np.diff(first))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all 64."""
    h = h ^ (h >> np.uint64(33))
    h *= _MIX_1
    h ^= h >> np.uint64(33)
    h *= _MIX_2
    h ^= h >> np.uint64(33)
    return h


def first_bytes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first eight bytes of byte spans as one number."""
    view = np.ndarray((len(data) - 7,), np.dtype("<u8"), data.data, strides=(1,))
    return view[begin] & _MASKS[np.minimum(end - begin, 8)]


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time over all spans together."""
    view = np.ndarray((len(data) - 7,), np.dtype("<u8"), data.data, strides=(1,))
    length = end - begin
    h = mixed(length.astype(np.uint64) + _GOLDEN)
    left = np.arange(len(begin))
    at, rest = begin, length
    while len(left):
        word = view[at] & _MASKS[np.minimum(rest, 8)]
        h[left] = mixed((h[left] ^ word) * _GOLDEN)
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    return h


def window_hashes(
    h: np.ndarray, words: Words, size: int, short: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and row of every run of ``size`` words inside a row.

    With ``short``, a row of fewer words, but at least one, has its whole sequence as its
    only run; without, it has none.
    """
    factors = mixed(np.arange(1, size + 2, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
    n = len(h)
    total = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        total[: n - k] += h[k:] * factors[k]
    row = np.repeat(np.arange(len(words.count)), words.count)
    begins = np.arange(n) + size <= (words.first + words.count)[row]
    if short:
        for i in np.flatnonzero((words.count > 0) & (words.count < size)):
            a, m = words.first[i], words.count[i]
            short_run = np.append(h[a : a + m] * factors[:m], factors[m])
            total[a] = short_run.sum(dtype=np.uint64)
            begins[a] = True
    at = np.flatnonzero(begins)
    return mixed(total[at]), at, row[at]
