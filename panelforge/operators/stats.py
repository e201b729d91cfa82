"""Statistics per pair, per shop and group, and per month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import clip
from panelforge.operators.encode import distinct_values
from panelforge.operators.panel import BLOCK, PAIR, Panel, Targets, product, with_blocks
from panelforge.operators.reshape import pivot_sum, pivot_sum_map


def shop_item_stats(panel: Panel) -> DataFrame:
    """Mean, median and sample deviation of a pair's months, and its mean row count.

    Taken from the non-empty months; the others are zeros that only enter as a number.
    """
    n = panel.n_blocks
    empty_value = float(min(max(0.0, panel.bounds[0]), panel.bounds[1]))

    def total(values: Column, start: Column) -> Column:
        return F.aggregate(values, start, lambda acc, v: acc + v)

    sold = F.map_values("history")
    counts = F.transform(sold, lambda c: clip(c["item_cnt"], panel.bounds))
    orders = total(F.transform(sold, lambda c: c["item_order"]), F.lit(0).cast("long"))
    base = panel.series.select(
        *PAIR,
        counts.alias("_counts"),
        orders.alias("_orders"),
    ).withColumn("_empty", F.lit(n) - F.size("_counts"))
    months = F.array_sort(
        F.concat("_counts", F.array_repeat(F.lit(empty_value), F.col("_empty")))
    )
    mean = (total(F.col("_counts"), F.lit(0.0)) + F.col("_empty") * empty_value) / n
    base = base.withColumn("_months", months).withColumn("cnt_mean_shop", mean)
    squares = F.aggregate(
        "_counts",
        F.col("_empty") * F.pow(F.lit(empty_value) - F.col("cnt_mean_shop"), F.lit(2.0)),
        lambda acc, v: acc + F.pow(v - F.col("cnt_mean_shop"), F.lit(2.0)),
    )
    median = (F.get("_months", F.lit((n - 1) // 2)) + F.get("_months", F.lit(n // 2))) / 2
    deviation = F.sqrt(squares / (n - 1)) if n > 1 else F.lit(None).cast("double")
    return base.select(
        *PAIR,
        "cnt_mean_shop",
        median.alias("cnt_med_shop"),
        deviation.alias("cnt_std_shop"),
        ((F.col("_orders") + F.col("_empty")) / n).alias("order_mean_shop"),
    )


def _group_sizes(targets: Targets, items: DataFrame) -> DataFrame:
    """Target items per group; an item without a group belongs to none."""
    known = items.where(F.col("item_group").isNotNull()).select("item_id", "item_group")
    return (
        targets.items.join(known, "item_id")
        .groupBy("item_group")
        .agg(F.count(F.lit(1)).alias("_items"))
    )


def _groups_by_shop(targets: Targets, items: DataFrame, n_blocks: int) -> DataFrame:
    """All groups with all shops; there are no more groups than items."""
    sizes = _group_sizes(targets, items)
    return product(
        sizes, targets.shops, targets.n_items, targets.n_shops, targets.tasks(n_blocks)
    )


def _group_cells(panel: Panel, items: DataFrame) -> DataFrame:
    known = items.where(F.col("item_group").isNotNull()).select("item_id", "item_group")
    return panel.clipped_cells().join(known, "item_id")


def shop_group_mean(panel: Panel, targets: Targets, items: DataFrame) -> DataFrame:
    """Mean monthly sales per shop and item group over all cells, empty ones included."""
    keys = ["shop_id", "item_group"]
    sums = _group_cells(panel, items).groupBy(*keys).agg(F.sum("item_cnt").alias("_sum"))
    frame = _groups_by_shop(targets, items, 1)
    return frame.join(sums, keys, "left").select(
        *keys,
        (F.coalesce("_sum", F.lit(0.0)) / (F.col("_items") * panel.n_blocks)).alias(
            "cnt_mean_shop_cat"
        ),
    )


def group_lag_mean(panel: Panel, targets: Targets, items: DataFrame) -> DataFrame:
    """Mean of the previous month's sales per month, shop and item group."""
    keys = [BLOCK, "shop_id", "item_group"]
    sums = (
        _group_cells(panel, items)
        .withColumn(BLOCK, F.col(BLOCK) + 1)
        .groupBy(*keys)
        .agg(F.sum("item_cnt").alias("_sum"))
    )
    groups = _groups_by_shop(targets, items, panel.n_blocks)
    frame = with_blocks(groups, 1, panel.n_blocks)
    return frame.join(sums, keys, "left").select(
        *keys, (F.coalesce("_sum", F.lit(0.0)) / F.col("_items")).alias("cnt_prev_cat")
    )


def _all_blocks(panel: Panel) -> DataFrame:
    spark = panel.cells.sparkSession
    return spark.range(panel.n_blocks).select(F.col("id").cast("int").alias(BLOCK))


def monthly_total(panel: Panel) -> DataFrame:
    """Clipped sales of all pairs per month."""
    sums = panel.clipped_cells().groupBy(BLOCK).agg(F.sum("item_cnt").alias("item_cnt"))
    return _all_blocks(panel).join(sums, BLOCK, "left").na.fill(0.0, ["item_cnt"])


def pivot_group(panel: Panel, targets: Targets, items: DataFrame) -> DataFrame:
    """Clipped sales per month, one column per item group found among the target items."""
    groups = distinct_values(_group_sizes(targets, items), "item_group")
    sums = pivot_sum(_group_cells(panel, items), [BLOCK], "item_group", "item_cnt", groups)
    return (
        _all_blocks(panel)
        .join(sums, BLOCK, "left")
        .na.fill(0.0, [str(group) for group in groups])
    )


def pivot_group_map(panel: Panel, items: DataFrame) -> DataFrame:
    """Clipped sales per month as one map by item group; groups without sales are left out."""
    return pivot_sum_map(_group_cells(panel, items), [BLOCK], "item_group", "item_cnt", "sales")
