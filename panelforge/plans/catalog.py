"""The named queries over the order-line tables; each takes a session and a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.columns import group_word
from panelforge.operators import clean, encode, impute, prices, profile, reshape, stats
from panelforge.operators import lags as lag_features
from panelforge.operators import panel as panels
from panelforge.operators import trend as trends
from panelforge.operators.panel import COUNTS, PAIR, PRICES, Panel, Targets
from panelforge.session import materialize, scratch_path
from panelforge.sources import csv
from panelforge.sources import order_lines as source

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6
N_BLOCKS = source.FORECAST_BLOCK
SOLD = COUNTS[:1]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to a fixed number of digits; sums in another order differ in the last ones.

    Not needed for sums of sold pieces, which are whole numbers and so exact.
    """
    return df.select(
        *[
            F.round(name, DIGITS).alias(name) if kind == "double" else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def _codes_as_doubles(df: DataFrame) -> DataFrame:
    """Codes of items, which may be NULL, as doubles."""
    codes = [name for name in ("item_category_id", "item_group") if name in df.columns]
    return df.withColumns({name: F.col(name).cast("double") for name in codes})


def _targets(spark: SparkSession, folder: str) -> Targets:
    return panels.load_targets(source.read_targets(spark, folder))


def _panel(spark: SparkSession, folder: str, targets: Targets, measures=COUNTS) -> Panel:
    sales = source.read_sales(spark, folder)
    return panels.build_panel(sales, targets, N_BLOCKS, measures)


def _kept_sales(sales: DataFrame, targets: Targets) -> DataFrame:
    """Sales of target shops and items without repeats."""
    return clean.drop_repeats(panels.target_sales(sales, targets))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    item_cats = source.read_item_cats(spark, folder)
    return encode.encode_items(source.read_items(spark, folder, item_cats), item_cats)


def _price(spark: SparkSession, folder: str, targets: Targets) -> DataFrame:
    return prices.priced_rows(_panel(spark, folder, targets, PRICES).cells)


def _stored_price(spark: SparkSession, folder: str, targets: Targets) -> DataFrame:
    """Priced rows written out, for queries that read them more than once."""
    return materialize(_price(spark, folder, targets), "price")


def _through_csv(df: DataFrame, kinds: dict) -> DataFrame:
    path = scratch_path(df.sparkSession, "csv")
    csv.write_table(df, path)
    return csv.read_table(df.sparkSession, path, kinds)


# Sources


def scan_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales written as CSV with day-first dates and read by the CSV source."""
    path = scratch_path(spark, "csv")
    csv.write_table(source.read_sales(spark, folder).drop("ord"), path)
    return rounded(csv.read_sales(spark, path).drop("ord"))


def scan_targets(spark: SparkSession, folder: str) -> DataFrame:
    return _through_csv(source.read_targets(spark, folder), csv.TARGETS)


def scan_items(spark: SparkSession, folder: str) -> DataFrame:
    return _codes_as_doubles(_through_csv(source.read_items(spark, folder), csv.ITEMS))


def scan_item_cats(spark: SparkSession, folder: str) -> DataFrame:
    return _through_csv(source.read_item_cats(spark, folder), csv.ITEM_CATS)


def scan_shops(spark: SparkSession, folder: str) -> DataFrame:
    return _through_csv(source.read_shops(spark, folder), csv.SHOPS)


# Profiles and cleaning


def table_shapes(spark: SparkSession, folder: str) -> DataFrame:
    sales = source.read_sales(spark, folder)
    targets = _targets(spark, folder)
    kept = _kept_sales(sales, targets)
    return profile.shapes(
        {
            "sales": sales.drop("ord"),
            "targets": targets.pairs,
            "items": source.read_items(spark, folder),
            "item_cats": source.read_item_cats(spark, folder),
            "shops": source.read_shops(spark, folder),
            "clean_sales": kept,
        }
    )


def max_block(spark: SparkSession, folder: str) -> DataFrame:
    return profile.maximum(source.read_sales(spark, folder), "date_block_num")


def describe_cnt(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.describe(source.read_sales(spark, folder), "item_cnt_day"))


def top25_cnt(spark: SparkSession, folder: str) -> DataFrame:
    return profile.largest(source.read_sales(spark, folder), "item_cnt_day")


def anti_items(spark: SparkSession, folder: str) -> DataFrame:
    """Target items never sold, in any shop or month."""
    targets = _targets(spark, folder)
    return clean.keep_unknown(targets.items, source.read_sales(spark, folder), "item_id")


def dup_counts(spark: SparkSession, folder: str) -> DataFrame:
    return clean.repeat_counts(source.read_sales(spark, folder))


def dedup_sales(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(clean.drop_repeats(source.read_sales(spark, folder)))


def distinct_keys(spark: SparkSession, folder: str) -> DataFrame:
    return profile.distinct_keys(_targets(spark, folder).pairs, *PAIR)


def semi_filter(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    return rounded(_kept_sales(source.read_sales(spark, folder), targets))


# The dense panel


def dense_grid(spark: SparkSession, folder: str) -> DataFrame:
    return panels.dense_grid(_targets(spark, folder), N_BLOCKS)


def grid_check(spark: SparkSession, folder: str) -> DataFrame:
    return panels.grid_check(_targets(spark, folder), N_BLOCKS)


def monthly(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    return panels.monthly(_panel(spark, folder, targets))


def head_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return profile.first_rows(monthly(spark, folder), [panels.BLOCK, *PAIR])


def describe_monthly(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    return rounded(profile.describe_monthly(_panel(spark, folder, targets), targets))


# Encoders


def item_group(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode_groups(source.read_item_cats(spark, folder))


def shop_city(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode_shops(source.read_shops(spark, folder))


def label_words(spark: SparkSession, folder: str) -> DataFrame:
    return encode.label_words(
        source.read_item_cats(spark, folder), source.read_shops(spark, folder)
    )


def items_with_group(spark: SparkSession, folder: str) -> DataFrame:
    return _codes_as_doubles(_items(spark, folder))


def item_group_onehot(spark: SparkSession, folder: str) -> DataFrame:
    cats = source.read_item_cats(spark, folder)
    return encode.one_hot(cats, group_word(F.col("item_category_name")), "item_group")


def item_group_onehot_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """The sparse form of the same, shown as length and place of the 1, 0 for none."""
    cats = source.read_item_cats(spark, folder)
    made = encode.one_hot_vector(cats, group_word(F.col("item_category_name")), "_vector")
    values = vector_to_array("_vector")
    return made.select(
        *cats.columns,
        F.size(values).cast("long").alias("length"),
        F.array_position(values, 1.0).cast("long").alias("place"),
    )


def join_item_group(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    panel = _panel(spark, folder, targets)
    return _codes_as_doubles(panels.monthly_with_items(panel, _items(spark, folder)))


# Statistics


def shop_item_stats(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    return rounded(stats.shop_item_stats(_panel(spark, folder, targets)))


def shop_group_mean(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    panel = _panel(spark, folder, targets, SOLD)
    return rounded(stats.shop_group_mean(panel, targets, _items(spark, folder)))


def group_lag_mean(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    panel = _panel(spark, folder, targets, SOLD)
    return rounded(stats.group_lag_mean(panel, targets, _items(spark, folder)))


def describe_shop_item_stats(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    per_pair = stats.shop_item_stats(_panel(spark, folder, targets))
    columns = ["cnt_mean_shop", "cnt_med_shop", "cnt_std_shop"]
    return rounded(profile.describe(per_pair, *columns))


def describe_shop_group_mean(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    panel = _panel(spark, folder, targets, SOLD)
    means = stats.shop_group_mean(panel, targets, _items(spark, folder))
    return rounded(profile.describe(means, "cnt_mean_shop_cat"))


def describe_group_lag_mean(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    panel = _panel(spark, folder, targets, SOLD)
    means = stats.group_lag_mean(panel, targets, _items(spark, folder))
    return rounded(profile.describe(means, "cnt_prev_cat"))


def monthly_total(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    return stats.monthly_total(_panel(spark, folder, targets, SOLD))


# Lags, reshape, trend


def lags(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    wide = lag_features.lags(_panel(spark, folder, targets))
    # Row counts that may be NULL, as doubles.
    orders = {name: F.col(name).cast("double") for name in wide.columns if "order" in name}
    return wide.withColumns(orders)


def pivot_monthly(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    return reshape.pivot_monthly(_panel(spark, folder, targets, SOLD))


def unpivot_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.unpivot_monthly(pivot_monthly(spark, folder), N_BLOCKS)


def pivot_group(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    panel = _panel(spark, folder, targets, SOLD)
    return stats.pivot_group(panel, targets, _items(spark, folder))


def pivot_group_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of the sparse form: one row per month and group with sales."""
    targets = _targets(spark, folder)
    panel = _panel(spark, folder, targets, SOLD)
    made = stats.pivot_group_map(panel, _items(spark, folder))
    return made.select("date_block_num", F.explode("sales").alias("item_group", "item_cnt"))


def trend(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    return rounded(trends.trend(_panel(spark, folder, targets, SOLD), signal_span=None))


def trend_signal_time(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    return rounded(trends.trend(_panel(spark, folder, targets, SOLD)))


def trend_signal_pair(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    return rounded(trends.trend_pair_signal(_panel(spark, folder, targets, SOLD), targets))


# Prices


def mean_price(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    return rounded(panels.mean_price(_panel(spark, folder, targets, PRICES)))


def priced_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_price(spark, folder, _targets(spark, folder)))


def last_price(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(prices.last_price(_price(spark, folder, _targets(spark, folder))))


def item_max_price(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(prices.item_max_price(_price(spark, folder, _targets(spark, folder))))


def unpriced_pairs(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    return prices.unpriced_pairs(targets.pairs, _price(spark, folder, targets))


def price_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Which target pairs get a price and which priced pairs are no target."""
    targets = _targets(spark, folder)
    price = _stored_price(spark, folder, targets)
    return prices.price_coverage(targets.pairs, price, _items(spark, folder))


def item_mean_price(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    return rounded(prices.item_mean_price(targets.pairs, _price(spark, folder, targets)))


def train_price_discount(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(prices.train_price_discount(_stored_price(spark, folder, _targets(spark, folder))))


def known_price_discount(spark: SparkSession, folder: str) -> DataFrame:
    """The part of ``test_price_discount`` that needs no predicted price."""
    price = _stored_price(spark, folder, _targets(spark, folder))
    return rounded(prices.target_price_discount(prices.last_price(price), price))


def impute_price(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    price = _stored_price(spark, folder, targets)
    return rounded(impute.impute_price(targets.pairs, price, _items(spark, folder)))


def impute_price_check(spark: SparkSession, folder: str) -> DataFrame:
    """Which pairs get a predicted price, and whether it is one that training rows can give."""
    targets = _targets(spark, folder)
    price = _stored_price(spark, folder, targets)
    predicted = impute.impute_price(targets.pairs, price, _items(spark, folder))
    means = price.groupBy(*PAIR).agg(F.round(F.avg("item_price"), DIGITS).alias("mean"))
    # One row.
    bounds = means.agg(F.min("mean").alias("low"), F.max("mean").alias("high")).first()
    at = F.round("item_price", DIGITS)
    return predicted.select(
        *PAIR,
        at.isNotNull().alias("is_priced"),
        at.between(bounds["low"], bounds["high"]).alias("in_training_range"),
    )


def test_price_check(spark: SparkSession, folder: str) -> DataFrame:
    """Target prices and discounts, without the value of the predicted prices."""
    targets = _targets(spark, folder)
    price = _stored_price(spark, folder, targets)
    wanted = impute.target_price(targets.pairs, price, _items(spark, folder))
    made = prices.target_price_discount(wanted, price)
    known = prices.last_price(price).select(*PAIR, F.lit(True).alias("is_known"))
    made = made.join(known, PAIR, "left").withColumn(
        "is_known", F.coalesce("is_known", F.lit(False))
    )
    shown = F.when(F.col("is_known"), F.col("item_price")).alias("item_price")
    return rounded(made.select(*PAIR, "is_known", shown, "discount_rate"))


def test_price(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    price = _stored_price(spark, folder, targets)
    return rounded(impute.target_price(targets.pairs, price, _items(spark, folder)))


def test_price_discount(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    price = _stored_price(spark, folder, targets)
    wanted = impute.target_price(targets.pairs, price, _items(spark, folder))
    return rounded(prices.target_price_discount(wanted, price))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        scan_sales,
        scan_targets,
        scan_items,
        scan_item_cats,
        scan_shops,
        table_shapes,
        max_block,
        describe_cnt,
        top25_cnt,
        anti_items,
        dup_counts,
        dedup_sales,
        distinct_keys,
        semi_filter,
        dense_grid,
        grid_check,
        monthly,
        head_monthly,
        describe_monthly,
        item_group,
        shop_city,
        label_words,
        items_with_group,
        item_group_onehot,
        item_group_onehot_sparse,
        join_item_group,
        shop_item_stats,
        shop_group_mean,
        group_lag_mean,
        describe_shop_item_stats,
        describe_shop_group_mean,
        describe_group_lag_mean,
        monthly_total,
        lags,
        pivot_monthly,
        unpivot_monthly,
        pivot_group,
        pivot_group_sparse,
        trend,
        trend_signal_time,
        trend_signal_pair,
        mean_price,
        priced_rows,
        last_price,
        item_max_price,
        unpriced_pairs,
        price_coverage,
        item_mean_price,
        train_price_discount,
        known_price_discount,
        impute_price,
        impute_price_check,
        test_price_check,
        test_price,
        test_price_discount,
    )
}
