"""Mean, last and highest prices and the discount against the highest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import discount_rate
from panelforge.operators.clean import keep_known, keep_unknown, reconcile
from panelforge.operators.panel import BLOCK, PAIR


def priced_rows(cells: DataFrame) -> DataFrame:
    """Cells with a mean price; empty cells have none, so the non-empty cells suffice."""
    return cells.where(F.col("item_price").isNotNull()).select(BLOCK, *PAIR, "item_price")


def last_price(price: DataFrame) -> DataFrame:
    """Price of the latest priced month of each pair."""
    return price.groupBy(*PAIR).agg(F.max_by("item_price", BLOCK).alias("item_price"))


def item_max_price(price: DataFrame) -> DataFrame:
    return price.groupBy("item_id").agg(F.max("item_price").alias("item_max_price"))


def unpriced_pairs(targets: DataFrame, price: DataFrame) -> DataFrame:
    """Target pairs of items without a price in any shop."""
    return keep_unknown(targets.select(*PAIR), price, "item_id")


def train_price_discount(price: DataFrame) -> DataFrame:
    """Each price with its discount against the item's highest price."""
    return price.join(item_max_price(price), "item_id", "left").select(
        BLOCK,
        *PAIR,
        "item_price",
        discount_rate(F.col("item_price"), F.col("item_max_price")).alias("discount_rate"),
    )


def target_price_discount(target_price: DataFrame, price: DataFrame) -> DataFrame:
    """The same for target prices; an item without a highest price is its own reference."""
    reference = F.coalesce("item_max_price", "item_price")
    return target_price.join(item_max_price(price), "item_id", "left").select(
        *PAIR,
        "item_price",
        discount_rate(F.col("item_price"), reference).alias("discount_rate"),
    )


def item_mean_price(targets: DataFrame, price: DataFrame) -> DataFrame:
    """Target pairs with the mean over the item's prices, NULL where it has none."""
    means = price.groupBy("item_id").agg(F.avg("item_price").alias("item_price"))
    return targets.select(*PAIR).join(means, "item_id", "left").select(*PAIR, "item_price")


def price_coverage(targets: DataFrame, price: DataFrame, items: DataFrame) -> DataFrame:
    """Which pairs get a target price, and which of them are targets; one row per pair.

    ``status`` is ``known`` or ``predicted`` for a target with a price; ``elsewhere`` for one
    without, whose item has a price in another shop only; ``unknown item`` for one whose item
    has no price and no row in ``items``; ``no target`` for a priced pair nobody asked for.
    """
    predicted = keep_known(unpriced_pairs(targets, price), items, "item_id")
    priced = price.select(*PAIR).unionByName(predicted.select(*PAIR))
    both = reconcile(targets, priced, PAIR, ("n_targets", "n_prices"))
    sold = price.select("item_id").distinct().withColumn("_item_priced", F.lit(True))
    found = both.join(sold, "item_id", "left")
    is_target, is_priced = F.col("n_targets") > 0, F.col("n_prices") > 0
    item_priced = F.coalesce("_item_priced", F.lit(False))
    status = (
        F.when(~is_target, "no target")
        .when(is_priced & item_priced, "known")
        .when(is_priced, "predicted")
        .when(item_priced, "elsewhere")
        .otherwise("unknown item")
    )
    return found.select(
        *PAIR, is_target.alias("is_target"), is_priced.alias("is_priced"), status.alias("status")
    )
