import odd
import test_best_fit_packing as packed
import test_quality_rules as quality

import corpus_pipeline
from panelforge.session import materialize


def by_brute_force(rows):
    """The rows after each of the first three stages."""
    rows = [row for row in rows if quality.features(row[1])[-1]]
    yield rows
    rows = [
        (i, None if text is None else kept)
        for (i, text), (_, _, _, kept) in zip(rows, odd.kept_lines(rows), strict=True)
        if (kept or "").split() or not (text or "").split()
    ]
    yield rows
    found = odd.components(rows)
    yield [row for row, (i, _, least) in zip(rows, found, strict=True) if i is None or least == i]


def test_stages(spark, small):
    docs, rows = small
    stages = corpus_pipeline.STAGES
    assert [name for name, _ in stages] == [
        "quality rules", "line dedup", "n-gram Jaccard join", "best-fit packing",
    ]
    for (name, stage), wanted in zip(stages, by_brute_force(rows), strict=False):
        columns = docs.columns
        docs = materialize(stage(spark, docs, odd.SF), "stage")
        assert docs.columns == columns, name
        got = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert odd.ordered(got) == odd.ordered(wanted), name
        assert docs.where("n_chars <> length(text)").isEmpty()
    got = corpus_pipeline.run(spark, odd.SF).collect()
    assert odd.ordered(tuple(r)[:5] for r in got) == packed.wanted_pieces(wanted, 4096)
    packed.check_places(got, 4096)


def odd_frame(spark, n=3):
    """Documents that pass the rules, some copies of others in whole or in part."""
    texts = [t for _, t in odd.texts()]
    long = [t for t in texts if t and len(t.split()) > 60]
    rows = list(odd.texts())
    rows += [(500 + k, t) for k, t in enumerate(long)]
    rows += [(600 + k, f"{t}\nbut this line is of document {k} alone") for k, t in enumerate(long)]
    rows += [(700, long[0])] * 2 + [(None, long[0])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{c}` int" for c in (*odd.CLASHES, "_had_words")
    )
    full = [(*r, "en", None, -1, *range(len(odd.CLASHES) + 1)) for r in rows]
    return spark.createDataFrame(full, schema).repartition(n), rows


def test_odd_documents_and_clashing_columns(spark):
    """No kept document is empty; every stage equals the brute-force version on odd rows."""
    docs, rows = odd_frame(spark)
    for (name, stage), wanted in zip(corpus_pipeline.STAGES, by_brute_force(rows), strict=False):
        columns = docs.columns
        docs = materialize(stage(spark, docs, odd.SF), "stage")
        assert docs.columns == columns, name
        got = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert odd.ordered(got) == odd.ordered(wanted), name
    assert all(text.split() for _, text in got)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, odd.SF).collect()
    assert odd.ordered(tuple(r)[:5] for r in pieces) == packed.wanted_pieces(wanted, 4096)


def test_empty_table(spark, tmp_path):
    docs, _ = odd_frame(spark)
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_no_kept_document_is_empty(spark, small):
    docs, _ = small
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, odd.SF), "stage")
    assert docs.where(~docs["text"].rlike(corpus_pipeline.WORD)).isEmpty()
