"""Running totals over a global order, without one task holding the whole order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.session import materialize

# Rows of a range that one task sums, where there are more than the session's partitions.
ROWS_PER_SLICE = 1_000_000


def running_total(
    df: DataFrame,
    order: list[str],
    weight: Column,
    out: str,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows strictly before, ordered by ``order``.

    Rows must be distinct on ``order``; ``df`` is read more than once, so it is best a
    written table. Its rows are split into key ranges; the ranges are written out so that a
    row's range cannot change on a retry, each range is summed on its own, and the totals of
    the earlier ranges (one row per range) are added.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(partitions, math.ceil(df.count() / rows_per_slice))
    ranged = materialize(
        df.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()),
        "ranges",
    )
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_slice")
        .agg(F.sum(weight).alias("_total"))
        .select("_slice", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    )
    within = (
        Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        # One row per range, so the broadcast side is as small as the number of ranges.
        ranged.join(F.broadcast(offsets), "_slice")
        .withColumn(out, F.coalesce(F.sum(weight).over(within), F.lit(0)) + F.col("_offset"))
        .drop("_slice", "_offset")
    )


def dense_positions(df: DataFrame, order: list[str], out: str, **limits: int) -> DataFrame:
    """Rank from 0 of each row; rows must be distinct on ``order``."""
    return running_total(df.select(*order), order, F.lit(1), out, **limits)
