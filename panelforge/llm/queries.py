"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import (
    best_fit_packing,
    chat_formatting,
    feistel_sharding,
    fingerprints,
    license_scans,
    line_dedup,
    ngram_jaccard_join,
    prefix_trie,
    quality_rules,
    toxicity,
    url_filters,
    whitening,
    word_bpe,
)
from panelforge.llm.tables import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join.join(read(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.round_trip(read(spark, sf_dir, "documents"))


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_sharding.shard(read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(read(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_formatting.format_chats(read(spark, sf_dir, "conversations"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(read(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(read(spark, sf_dir, "documents"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans.scan(read(spark, sf_dir, "documents"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_bpe_round_trip,
        op3_feistel_sharding,
        op4_line_dedup,
        op5_best_fit_packing,
        op6_chat_formatting,
        op7_url_filters,
        op8_quality_rules,
        op9_document_fingerprints,
        op10_license_scans,
        op11_conversation_prefix_trie,
        op12_toxicity,
        op13_embedding_whitening,
    )
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_jaccard_join.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op6_chat_formatting": chat_formatting.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
    "op11_conversation_prefix_trie": prefix_trie.ORACLE,
}
