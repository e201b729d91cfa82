"""All result tables of the three flows from one set of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelforge.operators import prices, stats
from panelforge.operators.encode import encode_items, encode_shops
from panelforge.operators.impute import target_price
from panelforge.operators.lags import lags
from panelforge.operators.panel import Panel, Targets, build_panel, load_targets, monthly
from panelforge.operators.reshape import pivot_monthly
from panelforge.operators.trend import trend_pair_signal
from panelforge.session import materialize
from panelforge.sources.inputs import Inputs


def demand(panel: Panel, targets: Targets, items: DataFrame) -> dict[str, DataFrame]:
    return {
        "monthly": monthly(panel),
        "shop_item_stats": stats.shop_item_stats(panel),
        "shop_group_mean": stats.shop_group_mean(panel, targets, items),
        "lags": lags(panel),
        "group_lag_mean": stats.group_lag_mean(panel, targets, items),
        "monthly_total": stats.monthly_total(panel),
        "pivot_group": stats.pivot_group(panel, targets, items),
    }


def trend(panel: Panel, targets: Targets) -> dict[str, DataFrame]:
    return {
        "pivot_monthly": pivot_monthly(panel),
        "trend": trend_pair_signal(panel, targets),
    }


def price(panel: Panel, targets: Targets, items: DataFrame) -> dict[str, DataFrame]:
    known = prices.priced_rows(panel.cells)
    wanted = materialize(target_price(targets.pairs, known, items), "test-price")
    return {
        "train_price": prices.train_price_discount(known),
        "test_price": prices.target_price_discount(wanted, known),
    }


def build_features(inputs: Inputs) -> dict[str, DataFrame]:
    """The thirteen result tables.

    Sales are read and aggregated once: the non-empty cells and the series are written to
    the shared folder, and every table is read off them.
    """
    targets = load_targets(inputs.targets)
    items = materialize(encode_items(inputs.items, inputs.item_cats), "items")
    panel = build_panel(inputs.sales, targets, inputs.n_blocks, store=True)
    return {
        "items": items,
        "shops": encode_shops(inputs.shops),
        **demand(panel, targets, items),
        **trend(panel, targets),
        **price(panel, targets, items),
    }
