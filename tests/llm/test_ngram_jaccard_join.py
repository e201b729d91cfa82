import numpy as np
import odd
import pytest

from panelforge.llm import ngram_jaccard_join as join
from panelforge.llm.components import components


def rows_of(df):
    return odd.ordered(tuple(r) for r in df.collect())


def test_odd_documents(docs):
    assert rows_of(join.join(docs)) == odd.ordered(odd.components(odd.texts()))


def test_corpus(small):
    assert rows_of(join.join(small[0])) == odd.ordered(odd.components(small[1]))


def test_empty_table(no_docs):
    assert rows_of(join.join(no_docs)) == []


def test_dense_families_in_small_blocks(spark, monkeypatch):
    """A family over several blocks, its outliers, and hot common tokens."""
    monkeypatch.setattr(join, "BLOCK", 8)
    monkeypatch.setattr(join, "DELEGATES", 2)
    draw = np.random.default_rng(5)
    base = [f"b{k}" for k in range(150)]
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(150):
        own = list(base)
        for k in draw.choice(150, draw.integers(0, 9), replace=False):
            own[k] = f"e{draw.integers(10**6)}"
        rows.append((i, " ".join(own)))
    for i in range(150, 260):
        own = [f"u{i}-{k}" for k in range(draw.integers(5, 60))]
        rows.append((i, " ".join([*own, *passage])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(join.join(df)) == odd.ordered(odd.components(rows))


def test_chain_of_links(spark):
    """Each document is similar to the next only."""
    words = [f"w{k}" for k in range(400)]
    rows = [(50 - i, " ".join(words[8 * i : 8 * i + 100])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(join.join(df)) == odd.ordered(odd.components(rows))


def test_one_of_each_group_stays(docs):
    kept = join.keep_one(docs)
    assert kept.columns == docs.columns
    wanted = [
        (i, text)
        for (i, text), (_, _, least) in zip(
            odd.texts(), odd.components(odd.texts()), strict=True
        )
        if i is None or least == i
    ]
    assert rows_of(kept.select("doc_id", "text")) == odd.ordered(wanted)


@pytest.mark.parametrize("n", [1, 2, 4, 5, 17, 100])
def test_match_count_covers_the_prefix(n):
    m = join.best_match_count(n, np.full(n, 50))
    assert 1 <= m <= join.need(n)


def test_components(spark):
    pairs = [(5, 9), (9, 12), (12, 40), (40, 3), (7, 8), (8, 8), (100, 101), (101, 100)]
    df = spark.createDataFrame(pairs, "a long, b long")
    found = {r["node"]: r["label"] for r in components(df).collect()}
    assert found == {5: 3, 9: 3, 12: 3, 40: 3, 3: 3, 7: 7, 8: 7, 100: 100, 101: 100}
