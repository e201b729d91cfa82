"""Filters made from key lists."""

import pytest
from pyspark.sql import functions as F

from panelforge.operators import clean


def passing(spark, known, values, n_known):
    df = spark.createDataFrame([(v,) for v in known], "k long").distinct()
    test = clean.key_filter(df, "k", n_known)
    rows = spark.createDataFrame([(v,) for v in values], "k int").where(test(F.col("k")))
    return {r["k"] for r in rows.collect()}


def test_known_keys_pass_and_few_others(spark):
    known = set(range(0, 60_000, 6)) | {-5}
    got = passing(spark, known, range(-5, 60_000), len(known))
    assert known <= got
    assert len(got - known) < 0.02 * 50_000


@pytest.mark.parametrize("max_words", [1, 64])
def test_a_full_filter_loses_nothing(spark, monkeypatch, max_words):
    monkeypatch.setattr(clean, "MAX_WORDS", max_words)
    known = set(range(0, 9_000, 3))
    assert known <= passing(spark, known, range(9_000), len(known))


def test_no_keys_and_missing_keys(spark):
    assert passing(spark, [], range(100), 0) == set()
    assert passing(spark, [1, None], [1, 2, None], 2) >= {1}


@pytest.mark.parametrize("threshold", ["-1", "10485760b", "10m"])
def test_long_and_short_lists_keep_the_same(spark, threshold):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    known = spark.range(0, 5_000, 7).toDF("k")
    df = spark.range(5_000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = clean.keep_known_long(df, known, "k", 715)
        assert ("bit_or" in got._jdf.queryExecution().executedPlan().toString()) == (threshold == "-1")
        assert {r["k"] for r in got.collect()} == set(range(0, 5_000, 7))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_size_settings():
    sizes = {"-1": -1, "10485760b": 10 << 20, "10MB": 10 << 20, "10m": 10 << 20, "2g": 2 << 30, "7": 7}
    assert {k: clean._bytes(k) for k in sizes} == sizes
