"""Small documents with every odd case, and brute-force versions of what operators do."""

from __future__ import annotations

import random

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"

BASE = "the quick brown fox jumps over the lazy dog while seven grey geese watch from a far hill"
LINE = "This line is in many documents."


def texts() -> list[tuple[int | None, str | None]]:
    """(doc_id, text) with nulls, empty and long texts, ties and repeated rows."""
    draw = random.Random(3)
    words = [f"w{draw.randrange(400)}" for _ in range(3000)]
    long = " ".join(words)
    near = words[:200]
    changed = [*near[:50], "other", *near[51:]]
    far = [w if k % 4 else f"x{k}" for k, w in enumerate(near)]
    rows: list[tuple[int | None, str | None]] = [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "one"),
        (5, "one two three"),
        (6, "One TWO three"),
        (7, BASE),
        (8, BASE.upper()),
        (9, f"{BASE}\n{LINE}\n{LINE}"),
        (10, f"{LINE}\n{BASE} again and again\n  {LINE.upper()}\t"),
        (11, long),
        (12, long),
        (12, long),
        (13, " ".join(near)),
        (14, " ".join(changed)),
        (15, " ".join(far)),
        (16, " ".join(words[100:900])),
        (17, "a" * 3000 + "\n" + "é" * 70),
        (18, "don't <|endoftext|> IT'S Straße İΣ 日本語 é 👩‍👩‍👧 x\x1cy"),
        (19, "\n\n\n"),
        (20, "word " * 5000),
        (21, "Licensed under the Apache License, Version 2.0."),
        (22, f"{BASE}\nReleased under the MIT License.\n{LINE}"),
        (23, "*** ### " + " ".join(f"*{w}*" for w in words[:80])),
        (None, f"{BASE}\n{LINE}"),
        (None, None),
    ]
    for k in range(40):
        own = list(near)
        for _ in range(k % 5):
            own[draw.randrange(len(own))] = f"y{draw.randrange(9999)}"
        rows.append((100 + k, " ".join(own)))
    draw.shuffle(rows)
    return rows


CLASHES = [
    "key", "node", "label", "part", "range", "side", "h", "n", "kept", "token", "rare", "ids",
    "keys", "_lost_keys", "_lost_id", "n_shingles", "size", "open", "_part", "spread", "first",
    "segment", "component_id", "sequence_id", "n_words", "prefix", "short", "family", "block",
]


def odd_docs(spark: SparkSession) -> DataFrame:
    """The documents with further columns named like those that operators make."""
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in CLASHES)
    rows = [(*row, *[None if k % 3 else k for k in range(len(CLASHES))]) for row in texts()]
    return spark.createDataFrame(rows, schema).repartition(3)


def empty_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id long, text string")


def corpus() -> list[tuple[int, str | None]]:
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(*(c.to_pylist() for c in table.columns), strict=True))


def shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def components(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(doc_id, size of its set, least id reachable) by comparing everything."""
    sets = [(i, shingles(text)) for i, text in rows]
    ids = [(i, s) for i, s in sets if i is not None and s]
    parent = list(range(len(ids)))

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    for a, (i, x) in enumerate(ids):
        for b in range(a):
            j, y = ids[b]
            if i == j or 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(ids):
        least[root(k)] = min(i, least.get(root(k), i))
    found = {i: least[root(k)] for k, (i, _) in enumerate(ids)}
    return [(i, len(s), None if i is None else found.get(i, i)) for i, s in sets]


def line_keys(text: str | None) -> list[tuple[str, str]]:
    """(line, key) of a text."""
    white, out = " \t\n\x0b\x0c\r", []
    for line in (text or "").split("\n"):
        key = line.strip(white).encode().lower().decode()
        out.append((line, key))
    return out


def kept_lines(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(doc_id, lines, dropped lines, text that stays) by a dictionary of all keys."""
    holders: dict[str, set[int]] = {}
    for i, text in rows:
        for _, key in line_keys(text):
            if i is not None and len(key) >= 10:
                holders.setdefault(key, set()).add(i)
    out = []
    for i, text in rows:
        lines = line_keys(text)
        stays = [
            line
            for line, key in lines
            if i is None or len(holders.get(key, ())) < 2 or min(holders[key]) == i
        ]
        out.append((i, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return out


def ordered(rows) -> list:
    return sorted(rows, key=repr)
