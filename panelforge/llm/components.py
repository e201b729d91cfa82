"""Connected components of a graph given as pairs of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.session import materialize


def _minima(pairs: DataFrame) -> DataFrame:
    """Per ``a``: the least of it and its partners. Combined before the shuffle."""
    return pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))


def _state(pairs: DataFrame) -> tuple:
    """Rows and the sum of their whole hashes, by which two rounds are compared."""
    hashes = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(hashes)).first())


def components(pairs: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node that it reaches, for every node of a pair.

    Alternates two steps until nothing changes: every node sends its larger neighbours to
    its least neighbour, then its smaller ones. The pairs become stars around the least nodes
    after about as many rounds as the logarithm of the longest path. Every round is a written
    table, and so are the minima, so that Spark can split the pairs of a hub in the join.
    """
    edges = materialize(
        pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct(),
        "edges",
    )
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        minima = materialize(_minima(both), "minima")
        large = (
            both.join(minima, "a")
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
            .distinct()
        )
        large = materialize(large.where(F.col("a") != F.col("b")), "large")
        minima = materialize(_minima(large), "minima")
        small = large.join(minima, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = small.unionByName(minima.select("a", F.col("least").alias("b")))
        edges = materialize(small.where(F.col("a") != F.col("b")).distinct(), "edges")
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return labels.unionByName(roots)
