import re
from collections import Counter

import odd
import pyarrow as pa

from panelforge.llm import quality_rules as quality


def features(text):
    """The features by definition, one text at a time."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {
        k + j
        for k in range(len(words) - 2)
        if windows[tuple(words[k : k + 3])] > 1
        for j in range(3)
    }
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n, repeat = len(words), len(covered)
    failed = n < 50 or 100 * repeat > 50 * n
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    chars = sum(map(len, words))
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    kept = not (
        failed
        or 100 * symbols > 10 * n
        or 100 * upper > 40 * (upper + lower)
        or chars < 2 * n
        or chars > 15 * n
        or dup > n // 10
    )
    return n, chars, symbols, dup, repeat, failed, kept


def wanted(rows):
    return odd.ordered((i, *features(text)) for i, text in rows)


def test_odd_documents(docs):
    got = quality.score(docs)
    assert odd.ordered(tuple(r) for r in got.collect()) == wanted(odd.texts())


def test_corpus(small):
    got = quality.score(small[0])
    assert odd.ordered(tuple(r) for r in got.collect()) == wanted(small[1])


def test_labelled_documents(spark, small):
    """Documents labelled good are kept unless a base rule rejects them; bad ones go."""
    labels = spark.read.parquet(f"{odd.SF}/labels.parquet")
    rows = quality.score(small[0]).join(labels, "doc_id").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"])
    assert not any(r["kept"] for r in rows if r["quality"] == 0)


def test_kept_documents_keep_their_columns(docs):
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema
    wanted_rows = [row for row in odd.texts() if features(row[1])[-1]]
    got = kept.select("doc_id", "text").collect()
    assert odd.ordered(tuple(r) for r in got) == odd.ordered(wanted_rows)


def test_empty_table(no_docs):
    assert quality.score(no_docs).collect() == []
    assert quality.keep_good(no_docs).collect() == []


def test_rules_run_by_rejection_per_cost(small):
    def slow(t):
        for _ in range(300):
            rejected = quality.Texts(t.column).n_words < 60
        return rejected

    rules = [
        quality.Rule("none", lambda t: t.n_words < 0),
        quality.Rule("slow", slow),
        quality.Rule("quick", lambda t: t.n_words < 60),
    ]
    assert quality.measure(small[0], rules) == ["quick", "slow", "none"]


def test_later_rules_see_only_what_is_left():
    seen = []

    def second(t):
        seen.append(t.column.to_pylist())
        return t.n_words < 0

    texts = quality.Texts(pa.array(["a", "b c", "d e f"]))
    rules = [quality.Rule("first", lambda t: t.n_words < 2), quality.Rule("second", second)]
    assert quality.cascade(texts, rules).tolist() == [False, True, True]
    assert seen == [["b c", "d e f"]]
