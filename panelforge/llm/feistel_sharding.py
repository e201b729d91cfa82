"""Shards by a keyed permutation of global row numbers.

Rows are numbered from 0 in ascending order of id; a Feistel permutation with cycle walking
maps a number to a place, and the place gives shard (remainder) and slot (quotient). Shard
sizes so differ by one row at most, and whoever knows the number of rows and the key can
compute shard and slot of any row number, or the row number at any place.

Only DataFrame functions are used. The law is ``rows``.

Defined results: a null text has no bytes, a size of ``EXTRA`` and the checksum of the empty
text; rows without an id come first; rows with the same id are ordered by checksum and size,
and rows alike in all three may change places with each other, which changes no result;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.session import materialize

SHARDS = 24
KEY = 20_240_229
# Bytes that a record takes besides its text.
EXTRA = 8
ROUNDS = 6
# Rows of a range that one task numbers, where there are more than the session's partitions.
ROWS_PER_RANGE = 1_000_000


def sides(n: int) -> tuple[int, int]:
    """Two moduli, as equal as can be, whose product is at least ``n``."""
    left = math.isqrt(max(n - 1, 0)) + 1
    return left, max(1, -(-n // left))


def feistel(number: Column, n: int, key: int) -> Column:
    """One pass of the permutation of ``[0, left * right)``.

    The number is split into quotient and remainder; each round adds a keyed hash of one
    half to the other, modulo that half's size, so every round can be undone.
    """
    moduli = sides(n)
    halves = [F.call_function("div", number, F.lit(moduli[1])), F.pmod(number, F.lit(moduli[1]))]
    for k in range(ROUNDS):
        to, size = k % 2, F.lit(moduli[k % 2])
        moved = F.pmod(F.xxhash64(halves[1 - to], F.lit(key), F.lit(k)), size)
        halves[to] = F.pmod(halves[to] + moved, size)
    return halves[0] * F.lit(moduli[1]) + halves[1]


def place(number: Column, n: int, key: int = KEY) -> Column:
    """The place in ``[0, n)`` of a row number in ``[0, n)``.

    The cycle is walked from a number outside, which is one in about the root of ``n``. A
    walk meets each number outside at most once, so their count bounds the steps.
    """
    left, right = sides(n)
    first = feistel(number, n, key)
    outside = left * right - n
    if not outside:
        return first
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(outside)),
        first,
        lambda at, _: F.when(at < n, at).otherwise(feistel(at, n, key)),
    )
    return F.when(first < n, first).otherwise(walked)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``_number``, from 0 in the order of ``order``, without one task for all rows.

    Rows are cut into ranges, also among rows that are equal in the order. The ranges are
    written out, so that a row's range cannot change on a retry; each is numbered on its own
    and begins where the ranges before it end.
    """
    spark = rows.sparkSession
    ranges = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_RANGE)
    )
    cut = materialize(
        rows.withColumn("_spread", F.monotonically_increasing_id())
        .repartitionByRange(ranges, *order, "_spread")
        .withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        cut.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_begin"))
    )
    within = Window.partitionBy("_range").orderBy(*order)
    return (
        # One row per range, whose number is set above.
        cut.join(F.broadcast(begins), "_range")
        .withColumn("_number", F.row_number().over(within) - 1 + F.col("_begin"))
        .drop("_range", "_begin", "_spread")
    )


def shard(docs: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """Shard and slot of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + EXTRA).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    n = rows.count()
    at = place(F.col("_number"), n, key)
    return (
        numbered(rows, ["doc_id", "text_crc32", "size"])
        .withColumn("_place", at)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
            F.call_function("div", F.col("_place"), F.lit(shards)).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
