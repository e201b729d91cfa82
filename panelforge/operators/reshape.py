"""Long to wide and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.panel import BLOCK, PAIR, Panel


def pivot_sum(
    df: DataFrame, index: Sequence[str], columns: str, values: str, names: Sequence
) -> DataFrame:
    """Sum of ``values`` per index and one column per entry of ``names``, empty cells 0."""
    wide = df.groupBy(*index).pivot(columns, list(names)).agg(F.sum(values))
    return wide.na.fill(0.0, [str(name) for name in names])


def pivot_sum_map(
    df: DataFrame, index: Sequence[str], columns: str, values: str, out: str
) -> DataFrame:
    """The same with one map per index, from the entries of ``columns`` that occur to sums.

    For any number of entries: they stay data and need not be known before.
    """
    sums = df.groupBy(*index, columns).agg(F.sum(values).alias("_sum"))
    entry = F.struct(F.col(columns), F.col("_sum"))
    return sums.groupBy(*index).agg(F.map_from_entries(F.collect_list(entry)).alias(out))


def pivot_monthly(panel: Panel) -> DataFrame:
    """One row per pair, one column per month; read off the series, no shuffle of its own."""
    months = [F.get("_months", F.lit(m)).alias(str(m)) for m in range(panel.n_blocks)]
    return panel.series.withColumn("_months", panel.months()).select(*PAIR, *months)


def unpivot_monthly(wide: DataFrame, n_blocks: int) -> DataFrame:
    """Back to one row per pair and month."""
    months = [str(m) for m in range(n_blocks)]
    return wide.unpivot(PAIR, months, BLOCK, "item_cnt").select(
        F.col(BLOCK).cast("int").alias(BLOCK), *PAIR, "item_cnt"
    )
