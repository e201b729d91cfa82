"""The summaries looked at while preparing the features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelforge.operators import clean, encode, profile
from panelforge.operators.panel import BLOCK, PAIR, Panel, Targets, grid_check
from panelforge.sources.inputs import Inputs


def input_reports(inputs: Inputs, targets: Targets) -> dict[str, DataFrame]:
    """Sizes, range, summary, largest sales, never-sold target items and repeats."""
    sales = inputs.sales
    return {
        "shapes": profile.shapes(
            {
                "sales": sales.drop("ord"),
                "targets": inputs.targets,
                "items": inputs.items,
                "item_cats": inputs.item_cats,
                "shops": inputs.shops,
            }
        ),
        "max_block": profile.maximum(sales, BLOCK),
        "describe_cnt": profile.describe(sales, "item_cnt_day"),
        "largest_cnt": profile.largest(sales, "item_cnt_day"),
        "never_sold": clean.keep_unknown(targets.items, sales, "item_id"),
        "repeats": clean.repeat_counts(sales),
        "label_words": encode.label_words(inputs.item_cats, inputs.shops),
    }


def panel_reports(panel: Panel, targets: Targets) -> dict[str, DataFrame]:
    """Size of the grid against its key counts, and totals before clipping."""
    return {
        "grid_check": grid_check(targets, panel.n_blocks),
        "describe_monthly": profile.describe_monthly(panel, targets),
    }


def feature_reports(features: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Summaries and first rows of the result tables."""
    described = {
        "shop_item_stats": ["cnt_mean_shop", "cnt_med_shop", "cnt_std_shop"],
        "shop_group_mean": ["cnt_mean_shop_cat"],
        "group_lag_mean": ["cnt_prev_cat"],
    }
    reports = {
        f"describe_{name}": profile.describe(features[name], *columns)
        for name, columns in described.items()
    }
    for name, df in features.items():
        keys = [key for key in (BLOCK, *PAIR, "item_group") if key in df.columns]
        reports[f"head_{name}"] = profile.first_rows(df, keys or df.columns)
    return reports
