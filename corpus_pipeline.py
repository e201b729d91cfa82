"""A corpus made ready for training: filtered, deduplicated by line and document, packed.

Each stage works on all documents that the one before it kept. ``run`` writes every stage's
result to the shared folder and reads it back for the next.

Documents with null ids or texts go through as the operators define: the quality rules reject
texts of few words, null ones among them; rows without an id lose no lines and are linked with
nothing. Repeated rows are kept or dropped alike by the rules; lines and links count them as
one document. Other columns go along whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import best_fit_packing, line_dedup, ngram_jaccard_join, quality_rules
from panelforge.llm.tables import read
from panelforge.session import materialize

# A character of a word.
WORD = r"[^\x20\x09-\x0D]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; ``n_chars`` follows the text.

    So does a document that loses its last word: all it said stands in earlier documents, and
    the join, which links nothing with an empty text, would keep it for ever.
    """
    had = "_had_words"
    while had in docs.columns:
        had += "_"
    has_words = F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False))
    left = line_dedup.dedup(docs.withColumn(had, has_words))
    left = left.where(has_words | ~F.col(had)).drop(had)
    return left.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays."""
    return ngram_jaccard_join.keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return best_fit_packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", packing),
]

# Token ids and packing are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
