"""Prices of items that never had one, predicted by extremely randomized trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.constants import FOREST
from panelforge.operators import extra_trees
from panelforge.operators.panel import PAIR
from panelforge.operators.prices import last_price, unpriced_pairs
from panelforge.session import materialize

FEATURES = ["shop_id", "item_id", "item_category_id", "item_group"]
# Category and group of an item that has none.
NO_CODE = -1


def _with_features(df: DataFrame, items: DataFrame) -> DataFrame:
    """Items outside the item table drop out; those without a category stay, coded as such."""
    features = items.select(
        "item_id",
        F.coalesce("item_category_id", F.lit(NO_CODE)).alias("item_category_id"),
        F.coalesce("item_group", F.lit(NO_CODE)).alias("item_group"),
    )
    return df.join(features, "item_id")


def fit_price_model(
    price: DataFrame, items: DataFrame, local_rows: int = extra_trees.LOCAL_ROWS
) -> extra_trees.Forest:
    """Trees on all priced rows. The month is no feature, so the priced months of a pair are
    merged into one row with their sum, number and range, which changes no tree.
    """
    features = _with_features(price.select(*PAIR, "item_price"), items)
    rows = materialize(extra_trees.training_rows(features, FEATURES, "item_price"), "priced")
    return extra_trees.fit(rows, FEATURES, **FOREST, local_rows=local_rows)


def impute_price(targets: DataFrame, price: DataFrame, items: DataFrame) -> DataFrame:
    """Predicted prices of the target pairs whose item was never priced.

    Without such pairs no model is trained.
    """
    wanted = materialize(_with_features(unpriced_pairs(targets, price), items), "unpriced")
    if wanted.isEmpty():
        return wanted.select(*PAIR, F.lit(None).cast("double").alias("item_price"))
    return fit_price_model(price, items).predict(wanted, "item_price").select(*PAIR, "item_price")


def target_price(targets: DataFrame, price: DataFrame, items: DataFrame) -> DataFrame:
    """Last known prices of the pairs that have one, and predicted ones."""
    return last_price(price).unionByName(impute_price(targets, price, items))
