import hashlib

import odd

from panelforge.llm import line_dedup


def wanted(rows):
    return odd.ordered(
        (i, n, gone, hashlib.sha256(kept.encode()).hexdigest())
        for i, n, gone, kept in odd.kept_lines(rows)
    )


def test_odd_documents(docs):
    got = odd.ordered(tuple(r) for r in line_dedup.report(docs).collect())
    assert got == wanted(odd.texts())


def test_corpus_with_a_full_filter(small):
    """With a filter far too small nearly every line is a suspect; the result is the same."""
    got = odd.ordered(tuple(r) for r in line_dedup.report(small[0], max_bits=64).collect())
    assert got == wanted(small[1])


def test_texts_and_other_columns(docs):
    kept = line_dedup.dedup(docs)
    assert kept.schema == docs.schema
    got = odd.ordered((r["doc_id"], r["text"]) for r in kept.collect())
    texts = [
        (i, None if text is None else kept)
        for (i, text), (_, _, _, kept) in zip(odd.texts(), odd.kept_lines(odd.texts()), strict=True)
    ]
    assert got == odd.ordered(texts)
    others = [c for c in docs.columns if c != "text"]
    assert kept.select(others).exceptAll(docs.select(others)).isEmpty()


def test_empty_table(no_docs):
    assert line_dedup.report(no_docs).collect() == []
    assert line_dedup.dedup(no_docs).collect() == []
