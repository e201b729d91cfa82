"""Summaries printed to look a table over."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.constants import HEAD_ROWS, QUARTILES, TOP_K
from panelforge.operators.panel import Panel, Targets
from panelforge.session import materialize

# Parts that a pass of the search for quartiles cuts a range into.
BUCKETS = 4096


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each value occurs, per column; missing values and NaN left out."""
    cast = df.select(*[F.col(name).cast("double").alias(name) for name in columns])
    return (
        cast.unpivot([], list(columns), "column", "value")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@dataclass
class _Rank:
    """A place in a column's sorted values, and the values between which it is known to lie.

    ``at`` counts from the first value of that range.
    """

    column: str
    at: int
    low: float
    high: float


def _scale(low: float, high: float) -> float:
    """What keeps the width of a range finite; 0 for a range that ends at infinity, whose ends
    are parts of their own."""
    if math.isinf(low) or math.isinf(high):
        return 0.0
    return 0.5 if math.isinf(high - low) else 1.0


def _narrowed(counts: DataFrame, ranks: list[_Rank], buckets: int) -> list[_Rank]:
    """One pass over the value counts: the ranges cut into ``buckets``, and which hold the ranks.

    A bucket's own least and largest value are the next range, so a bucket with one value
    ends the search, and a range with two has at least two buckets that are not empty.
    """
    ranges = sorted({(r.column, r.low, r.high) for r in ranks})
    spans = F.array(
        *[
            F.struct(
                F.lit(column).alias("column"),
                F.lit(low).cast("double").alias("low"),
                F.lit(high).cast("double").alias("high"),
                F.lit(_scale(low, high)).alias("scale"),
            )
            for column, low, high in ranges
        ]
    )
    at, value = F.col("_span"), F.col("value")
    low, high = at["low"] * at["scale"], at["high"] * at["scale"]
    share = F.try_divide(value * at["scale"] - low, high - low)
    inside = counts.withColumn("_span", F.explode(spans)).where(
        (F.col("column") == at["column"]) & value.between(at["low"], at["high"])
    )
    ends = F.when(value == at["low"], 0).when(value == at["high"], 2).otherwise(1)
    bucket = F.when(at["scale"] == 0, ends).otherwise(
        F.least(F.floor(share * buckets), F.lit(buckets - 1))
    )
    # A row per range and bucket that is not empty.
    found = (
        inside.groupBy("_span", bucket.alias("_bucket"))
        .agg(F.sum("n").alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"))
        .collect()
    )
    by_range: dict[tuple, list] = {}
    for row in found:
        by_range.setdefault(tuple(row["_span"])[:3], []).append(row)
    out = []
    for rank in ranks:
        at = rank.at
        for row in sorted(by_range[rank.column, rank.low, rank.high], key=lambda r: r["_bucket"]):
            if at < row["rows"]:
                out.append(_Rank(rank.column, at, row["low"], row["high"]))
                break
            at -= row["rows"]
    return out


def values_at(counts: DataFrame, wanted: list[_Rank], buckets: int = BUCKETS) -> list[float]:
    """The exact values at ranks, by histograms that narrow each rank's range.

    Every pass cuts the ranges of all ranks by ``buckets``, without sorting and with sums
    combined before the shuffle; two or three passes are usual.
    """
    ranks = list(wanted)
    while still := [i for i, r in enumerate(ranks) if r.low != r.high]:
        for i, rank in zip(still, _narrowed(counts, [ranks[i] for i in still], buckets), strict=True):
            ranks[i] = rank
    return [r.low for r in ranks]


def describe_counts(
    counts: DataFrame, columns: Sequence[str], buckets: int = BUCKETS
) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles from value counts.

    A column without values has the count 0 and nothing else. Quartiles interpolate between
    the two neighbouring ranks. ``counts`` is read several times, so it should come from a
    written table.
    """
    weighted = F.col("value") * F.col("n")
    # One row per described column.
    overview = {
        row["column"]: row
        for row in counts.groupBy("column")
        .agg(
            F.sum("n").alias("rows"),
            (F.sum(weighted) / F.sum("n")).alias("mean"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
        .collect()
    }
    ranks, places = [], {}
    for name, row in overview.items():
        for share in QUARTILES:
            at = share * (row["rows"] - 1)
            places[name, share] = (len(ranks), at - math.floor(at))
            ranks += [
                _Rank(name, whole, row["low"], row["high"])
                for whole in (math.floor(at), math.ceil(at))
            ]
    values = values_at(counts, ranks, buckets)
    quartiles = {}
    for (name, share), (i, part) in places.items():
        below, above = values[i], values[i + 1]
        quartiles[name, share] = below if below == above else below + (above - below) * part
    mean = _per_column({name: row["mean"] for name, row in overview.items()}, "double")
    squares = F.sum(F.col("n") * F.pow(F.col("value") - mean, F.lit(2.0)))
    n = F.sum("n")
    found = counts.groupBy("column").agg(
        n.alias("count"),
        (F.sum(weighted) / n).alias("mean"),
        F.when(n > 1, F.sqrt(squares / (n - 1))).alias("std"),
        F.min("value").alias("min"),
        *[
            F.max(
                _per_column({name: quartiles[name, share] for name in overview}, "double")
            ).alias(f"q{round(share * 100)}")
            for share in QUARTILES
        ],
        F.max("value").alias("max"),
    )
    named = counts.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(name) for name in columns])).alias("column")
    )
    return named.join(found, "column", "left").fillna(0, ["count"])


def _per_column(values: dict[str, float], kind: str):
    chosen = F.lit(None).cast(kind)
    for name, value in values.items():
        chosen = F.when(F.col("column") == name, F.lit(value).cast(kind)).otherwise(chosen)
    return chosen


def describe(df: DataFrame, *columns: str, **limits: int) -> DataFrame:
    """One row per column of ``df`` named."""
    return describe_counts(materialize(value_counts(df, columns), "counts"), columns, **limits)


def describe_monthly(panel: Panel, targets: Targets, **limits: int) -> DataFrame:
    """Summary of the dense monthly totals before clipping.

    The empty cells all hold 0 sales and 1 row, so they enter as one weighted value.
    """
    blanks = {"item_cnt": 0.0, "item_order": 1.0}
    sold = materialize(value_counts(panel.cells, list(blanks)), "counts")
    one = sold.sparkSession.range(1)
    names = one.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("column"), F.lit(value).alias("value"))
                    for name, value in blanks.items()
                ]
            )
        )
    )
    used = sold.groupBy("column").agg(F.sum("n").alias("_used"))
    empty = F.lit(targets.n_cells(panel.n_blocks)).cast("long") - F.coalesce("_used", F.lit(0))
    blank = names.join(used, "column", "left").select("column", "value", empty.alias("n"))
    counts = sold.unionByName(blank).groupBy("column", "value").agg(F.sum("n").alias("n"))
    return describe_counts(counts.where(F.col("n") > 0), list(blanks), **limits)


def largest(df: DataFrame, column: str, k: int = TOP_K) -> DataFrame:
    """The ``k`` largest values with their place."""
    top = df.select(column).where(F.col(column).isNotNull()).orderBy(F.desc(column)).limit(k)
    place = F.row_number().over(Window.orderBy(F.desc(column)))
    return top.select(place.alias("place"), column)


def first_rows(df: DataFrame, keys: Sequence[str], n: int = HEAD_ROWS) -> DataFrame:
    """The first rows by key."""
    return df.orderBy(*keys).limit(n)


def maximum(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias(f"max_{column}"))


def distinct_keys(targets: DataFrame, *columns: str) -> DataFrame:
    """Distinct values of each key column, in one table."""
    parts = [
        targets.select(F.lit(name).alias("key"), F.col(name).alias("value")) for name in columns
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked.distinct()


def shapes(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    counted = [
        df.agg(
            F.lit(name).alias("name"),
            F.count(F.lit(1)).alias("n_rows"),
            F.lit(len(df.columns)).alias("n_columns"),
        )
        for name, df in tables.items()
    ]
    stacked = counted[0]
    for part in counted[1:]:
        stacked = stacked.unionByName(part)
    return stacked
