"""Quality rules as a short-circuit cascade.

The cost of each rule and the share it rejects are measured on a sample; the rules then run
in descending order of rejections per second, and a rule sees only the documents that all
rules before it kept. The verdict is a conjunction, so the order changes the time taken and
never the result. That is why timings may steer it.

Defined results: a null or empty text has no words and is rejected by ``few_words``;
repeated rows are judged one by one; other columns, whatever their names, pass unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from time import process_time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import spans
from panelforge.llm.tables import id_and_text, schema

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
# Rows of the sample that costs and rejections are measured on, in expectation.
SAMPLE_ROWS = 2_000


class Texts:
    """Texts of some rows with their features, each made when first asked for."""

    def __init__(self, column: pa.Array):
        self.column = column
        self._made: dict[str, object] = {}

    def __len__(self) -> int:
        return len(self.column)

    def _once(self, name: str, make: Callable):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def take(self, rows: np.ndarray) -> Texts:
        return self if rows.all() else Texts(self.column.filter(pa.array(rows)))

    @property
    def raw(self) -> tuple[np.ndarray, np.ndarray]:
        return self._once("raw", lambda: spans.text_bytes(self.column))

    @property
    def words(self) -> spans.Words:
        return self._once("words", lambda: spans.find_words(*self.raw))

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Number of marked bytes in each row."""
        bounds = self.raw[1]
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])

    def letters(self, first: str, last: str) -> np.ndarray:
        data = self.raw[0][:-8]
        return self.per_row((data >= ord(first)) & (data <= ord(last)))

    @property
    def n_words(self) -> np.ndarray:
        return self.words.count

    @property
    def word_chars(self) -> np.ndarray:
        data = self.raw[0][:-8]
        return self.per_row(~spans.SPACE[data] & ((data & 0xC0) != 0x80))

    @property
    def n_symbols(self) -> np.ndarray:
        return self.per_row(SYMBOLS[self.raw[0][:-8]])

    def _dup_lines(self) -> np.ndarray:
        data, bounds = self.raw
        text, out = data[:-8].tobytes(), np.zeros(len(self), np.int64)
        for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            lines = [line for line in text[a:b].split(b"\n") if line.strip()]
            out[row] = len(lines) - len(set(lines))
        return out

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self._once("dup", self._dup_lines)

    def _repeat_words(self) -> np.ndarray:
        words = self.words
        h = spans.hash_spans(self.raw[0], words.begin, words.end)
        runs, at, row = spans.window_hashes(h, words, 3, short=False)
        runs = spans.mixed(runs ^ spans.mixed(row.astype(np.uint64)))
        order = np.argsort(runs)
        equal = runs[order][1:] == runs[order][:-1]
        twice = np.zeros(len(runs), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[at[twice] + k] = True
        owner = np.repeat(np.arange(len(self)), words.count)
        return np.bincount(owner[covered], minlength=len(self))

    @property
    def n_repeat_words(self) -> np.ndarray:
        return self._once("repeat", self._repeat_words)


@dataclass(frozen=True)
class Rule:
    """``rejects`` marks the rows to reject."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


def _capitals(t: Texts) -> np.ndarray:
    upper = t.letters("A", "Z")
    return 100 * upper > 40 * (upper + t.letters("a", "z"))


BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
RULES = (
    Rule("symbols", lambda t: 100 * t.n_symbols > 10 * t.n_words),
    Rule("capitals", _capitals),
    Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 15 * t.n_words)),
    Rule("repeated_lines", lambda t: t.n_dup_lines > t.n_words // 10),
)


def measure(docs: DataFrame, rules: Sequence[Rule], rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules, best rejection per second first, from about ``rows`` sampled rows.

    The sums come back as one row per rule. Equal rates keep the order given.
    """
    total = docs.count()
    share = min(1.0, rows / total) if total else 1.0

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in spans.pieces(batch):
                out = []
                for rule in rules:
                    texts, began = Texts(piece.column("text")), process_time()
                    rejected = int(rule.rejects(texts).sum())
                    out.append((rule.name, process_time() - began, rejected))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*out, strict=True)], ["name", "cost", "hits"]
                )

    stats = (
        id_and_text(docs)
        .select("text")
        .sample(share, seed=8)
        .mapInArrow(timed, schema(name="string", cost="double", hits="long"))
        .groupBy("name")
        .agg(F.sum("cost").alias("cost"), F.sum("hits").alias("hits"))
        .collect()
    )
    rate = {r["name"]: r["hits"] / max(r["cost"], 1e-9) for r in stats}
    return sorted((r.name for r in rules), key=lambda name: -rate.get(name, 0.0))


def cascade(texts: Texts, rules: Sequence[Rule], kept: np.ndarray | None = None) -> np.ndarray:
    """Rows that every rule keeps; each rule reads only what is still in."""
    kept = np.ones(len(texts), bool) if kept is None else kept.copy()
    rows = np.flatnonzero(kept)
    texts = texts.take(kept)
    for rule in rules:
        if not len(rows):
            break
        passes = ~rule.rejects(texts)
        kept[rows[~passes]] = False
        rows, texts = rows[passes], texts.take(passes)
    return kept


def in_order(rules: Sequence[Rule], names: Sequence[str]) -> list[Rule]:
    by_name = {rule.name: rule for rule in rules}
    return [by_name[name] for name in names]


def keep_good(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + RULES) -> DataFrame:
    """The documents that pass all rules, with all their columns."""
    ordered = in_order(rules, measure(docs, rules))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in spans.pieces(batch):
                yield piece.filter(pa.array(cascade(Texts(piece.column("text")), ordered)))

    return docs.mapInArrow(kept, docs.schema)


def score(docs: DataFrame) -> DataFrame:
    """Every document with the features of the base rules and the verdict of all rules.

    The features are asked for on every row, so they are made for all of them; the cascade
    then runs on the rows that the base rules keep.
    """
    ordered = in_order(RULES, measure(docs, RULES))
    features = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = schema(
        doc_id="long", **dict.fromkeys(features, "long"), base_failed="boolean", kept="boolean"
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in spans.pieces(batch):
                texts = Texts(piece.column("text"))
                failed = np.zeros(len(texts), bool)
                for rule in BASE_RULES:
                    failed |= rule.rejects(texts)
                made = [getattr(texts, name).astype(np.int64) for name in features]
                kept = cascade(texts, ordered, ~failed)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *map(pa.array, [*made, failed, kept])], out.names
                )

    return id_and_text(docs).mapInArrow(scored, out)


_WORD = r"[^\x20\x09-\x0D]"
ORACLE = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS words
  FROM documents
), windows AS (
  SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, run) AS n
  FROM (
    SELECT doc_id, k, array_to_string(words[k:k + 2], ' ') AS run
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS k FROM docs))
), covered AS (
  SELECT doc_id, count(DISTINCT k + j) AS n FROM windows, (VALUES (0), (1), (2)) AS t(j)
  WHERE n > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id
), counted AS (
  SELECT d.doc_id, len(words) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper,
    length(regexp_replace(text, '[^a-z]', '', 'g')) AS lower
  FROM docs d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * upper > 40 * (upper + lower)
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR n_dup_lines > n_words // 10
  ) AS kept
FROM judged
"""
