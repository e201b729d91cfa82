"""Byte-pair encoding with word ends, and decoding, by contiguous rank arrays.

A word is an array of parts with, beside it, the array of the ranks of adjacent parts. The
lowest rank is found by scanning, its boundary is deleted and the two neighbouring ranks are
refreshed. Words of equal length do so side by side, as rows of one array. Words are short,
so scanning beats a priority queue; the few long ones use one.

Equal pieces of text between ASCII white space have equal ids, as no rule of the vocabulary
file reaches across white space. Each worker keeps the pieces it met in two generations of
bounded size.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated
rows are encoded one by one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelforge.llm import spans
from panelforge.llm.tables import id_and_text, schema, vocabulary

# Parts of a word up to which scanning for the lowest rank is used.
SHORT = 64
# Bytes that a worker keeps of pieces of text in each of two generations, what a piece takes
# beside its own bytes and its ids, and the longest key that is kept.
KEPT_BYTES, PIECE_BYTES, LONGEST_KEPT = 96 << 20, 250, 64
WORD_END = "</w>"
NO_RANK = 1 << 30
# How ids are packed: little-endian unsigned 32-bit numbers.
ID = np.dtype("<u4")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Bytes that print stand for themselves, the others for letters from U+0100 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Known(dict):
    """Values by key in two generations; the older goes when the newer is full.

    ``make`` gives the values of a list of keys, each bytes or a tuple of bytes. A generation
    is full beyond ``limit`` bytes; long keys, which seldom come again, are not kept.
    """

    def __init__(self, make: Callable[[list], Iterable], limit: int):
        super().__init__()
        self._make, self._limit, self._older, self.bytes = make, limit, {}, 0

    def values_of(self, keys: list) -> list:
        """The values of ``keys``, in order; what is not known is made in one go."""
        if self.bytes > self._limit:
            self._older, self.bytes = dict(self), 0
            self.clear()
        values = list(map(self.get, keys))
        gaps = [i for i, value in enumerate(values) if value is None]
        new = {keys[i] for i in gaps}
        found = {key: self._older[key] for key in new if key in self._older}
        rest = list(new.difference(found))
        found.update(zip(rest, self._make(rest), strict=True))
        for i in gaps:
            values[i] = found[keys[i]]
        for key, value in found.items():
            if len(key) <= LONGEST_KEPT:
                self[key] = value
                own = len(value) if isinstance(value, bytes) else sum(map(len, value))
                self.bytes += own + len(key) + PIECE_BYTES
        return values


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, ID).tolist()


class WordBpe:
    """Encoder and decoder of a vocabulary file of byte-level BPE with word ends.

    The file's own settings that matter are read from it: the pattern that cuts words, the
    special tokens, the vocabulary and the merges.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        vocab = made["model"]["vocab"]
        self.tokens = {i: token for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.tokens |= {i: token for token, i in self.special.items()}
        pairs = [(vocab[a], vocab[b]) for a, b in made["model"]["merges"]]
        keys = np.array([a << 16 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], order
        self._joined = np.array([vocab[a + b] for a, b in made["model"]["merges"]], np.int64)
        letters = byte_letters()
        self._inner = np.array([vocab[letter] for letter in letters], np.int64)
        self._last = np.array([vocab[letter + WORD_END] for letter in letters], np.int64)
        split = made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        split = split.replace(r"\s", r"\p{White_Space}")
        self._words = regex.compile(split)
        self._words_and_ends = regex.compile(split + r"|\n")
        self._specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self._known = Known(self._encode_words, KEPT_BYTES // 4)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of parts; ``NO_RANK`` where they do not merge."""
        key = left << 16 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], NO_RANK)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of words as the pattern cuts them."""
        raw = [word.encode() for word in words]
        ids = [b""] * len(words)
        by_length = defaultdict(list)
        for i, r in enumerate(raw):
            by_length[len(r)].append(i)
        for length, group in by_length.items():
            data = np.frombuffer(b"".join([raw[i] for i in group]), np.uint8)
            data = data.reshape(len(group), length)
            parts = self._inner[data]
            parts[:, -1] = self._last[data[:, -1]]
            if length <= SHORT:
                self._scan(parts, np.array(group), ids)
            else:
                for i, row in zip(group, parts.tolist(), strict=True):
                    ids[i] = np.array(self._queue(row), ID).tobytes()
        return ids

    def _scan(self, parts: np.ndarray, group: np.ndarray, ids: list[bytes]) -> None:
        """Merge the rows of ``parts``; every row that goes on loses one part per step."""

        def keep(parts: np.ndarray, group: np.ndarray) -> None:
            packed, width = parts.astype(ID).tobytes(), ID.itemsize * parts.shape[1]
            for at, k in enumerate(group.tolist()):
                ids[k] = packed[at * width : (at + 1) * width]

        ranks = self._rank(parts[:, :-1], parts[:, 1:])
        while ranks.shape[1]:
            row = np.arange(len(parts))
            i = ranks.argmin(1)
            lowest = ranks[row, i]
            done = lowest == NO_RANK
            if done.any():
                keep(parts[done], group[done])
                parts, ranks, group = parts[~done], ranks[~done], group[~done]
                row, i, lowest = row[: len(group)], i[~done], lowest[~done]
            if not len(group):
                return
            parts[row, i] = self._joined[lowest]
            column = np.arange(parts.shape[1] - 1)
            parts = np.take_along_axis(parts, column + (column > i[:, None]), 1)
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= i[:, None]), 1)
            left, right = np.flatnonzero(i > 0), np.flatnonzero(i < ranks.shape[1])
            at = i[left]
            ranks[left, at - 1] = self._rank(parts[left, at - 1], parts[left, at])
            at = i[right]
            ranks[right, at] = self._rank(parts[right, at], parts[right, at + 1])
        keep(parts, group)

    def _queue(self, parts: list[int]) -> list[int]:
        """The same for a long word: ranks in a heap, parts in a linked list."""
        n = len(parts)
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        ranks = self._rank(np.array(parts[:-1]), np.array(parts[1:])).tolist()
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(ranks) if r < NO_RANK]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            rank = int(self._rank(np.array([parts[i]]), np.array([parts[j]]))[0])
            if rank < NO_RANK:
                heapq.heappush(heap, (rank, i, parts[i], parts[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = int(self._joined[rank]), False, after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [part for part, stays in zip(parts, alive, strict=True) if stays]

    @staticmethod
    def _normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # Here a sigma's lower case does not depend on its place in the word.
            text = text.replace("Σ", "σ")
        return text.lower()

    def _encode_special(self, text: str) -> bytes:
        """Packed ids of a text with special tokens, which are cut out before anything else."""
        ids = []
        for k, part in enumerate(self._specials.split(text)):
            if k % 2:
                ids.append(np.array([self.special[part]], ID).tobytes())
            else:
                ids += self._known.values_of(self._words.findall(self._normal(part)))
        return b"".join(ids)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces of text without white space; plain ones are cut in one go."""
        text = b"\n".join(pieces).decode()
        if any(special in text for special in self.special):
            return [self._encode_special(piece) for piece in text.split("\n")]
        words = self._words_and_ends.findall(self._normal(text))
        ids, own = [], b""
        for word, found in zip(words, self._known.values_of(words), strict=True):
            if word == "\n":
                ids.append(own)
                own = b""
            else:
                own += found
        return [*ids, own] if pieces else []

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special tokens in it are single ids."""
        return unpacked(b"".join(self.encode_pieces(text.encode().split())))

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by spaces: the file names no decoder."""
        return " ".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=1)
def loaded(path: str) -> WordBpe:
    """The encoder of a file, once per worker."""
    return WordBpe(path)


@lru_cache(maxsize=1)
def known_digits(path: str) -> Known:
    """Per piece of text: its ids in digits and its tokens, both joined by spaces."""
    bpe = loaded(path)

    digits = {i: b"%d" % i for i in bpe.tokens}
    tokens = {i: token.encode() for i, token in bpe.tokens.items()}

    def make(pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        for packed in bpe.encode_pieces(pieces):
            ids = unpacked(packed)
            yield b" ".join([digits[i] for i in ids]), b" ".join([tokens[i] for i in ids])

    return Known(make, KEPT_BYTES)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``ids``, the text's token ids."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary(path))
        for batch in batches:
            for piece in spans.pieces(batch):
                ids = [bpe.encode(text or "") for text in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
                )

    return id_and_text(docs).mapInArrow(encoded, schema(doc_id="long", ids="array<int>"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``text``, the tokens of ``ids`` joined by spaces; null ids are none."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary(path))
        for batch in batches:
            text = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(
        decoded, schema(doc_id="long", text="string")
    )


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Number of ids and digests of the ids and of the text decoded from them.

    Encodes and decodes in one pass, so that the ids of the corpus need not leave the worker.
    """
    out = schema(doc_id="long", n_tokens="long", ids_sha256="string", decoded_sha256="string")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_digits(vocabulary(path))
        for batch in batches:
            for part in spans.pieces(batch):
                data, bounds = spans.text_bytes(part.column("text"))
                text = data.tobytes()
                words, ends = spans.split_rows(text, bounds)
                values, rows = known.values_of(words), []
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    found = values[a:b]
                    ids = b" ".join([x for x, _ in found if x])
                    tokens = b" ".join([y for x, y in found if x])
                    rows.append(
                        (
                            ids.count(b" ") + 1 if ids else 0,
                            hashlib.sha256(ids).hexdigest(),
                            hashlib.sha256(tokens).hexdigest(),
                        )
                    )
                n, ids_sha, text_sha = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.array(n, np.int64)),
                        pa.array(ids_sha),
                        pa.array(text_sha),
                    ],
                    out.names,
                )

    return id_and_text(docs).mapInArrow(digested, out)
