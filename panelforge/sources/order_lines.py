"""The input tables derived from an order-line star schema.

Every line is used exactly once as history or as target. Lines shipped before the forecast
month are sales; lines of the forecast month are the pairs to forecast. Parts of the
newest size class have no history yet: their lines are pre-orders, which are targets too.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators.encode import with_label_code
from panelforge.sources.inputs import Inputs

# Fixed values of the mapping.
FIRST_YEAR = 1995
FORECAST_DAY = date(2001, 11, 1)
FORECAST_BLOCK = 82
NEW_SIZE = 50
# Brand whose items have no category.
UNCLASSIFIED = "Brand#13"
# Discount and tax of the lines that are gifts, with the price 0.
GIFT = (0.1, 0.08)
# A second report costs this plus the tax rate, from cheaper to dearer than the first.
SECOND_PRICE = 0.96
SCHEMAS = {
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "supplier": "s_suppkey BIGINT, s_nationkey INT",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _lines(spark: SparkSession, folder: str, where: Column | None = None) -> DataFrame:
    """Order lines with shop, item and month; ``where`` compares columns as they are stored.

    A returned line counts negative.
    """
    lines = _table(spark, folder, "lineitem")
    if where is not None:
        lines = lines.where(where)
    suppliers = _table(spark, folder, "supplier")
    shops = suppliers.select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("shop_id")
    )
    month = (F.year("l_shipdate") - FIRST_YEAR) * 12 + F.month("l_shipdate") - 1
    returned = F.col("l_returnflag") == "R"
    gift = (F.col("l_discount") == GIFT[0]) & (F.col("l_tax") == GIFT[1])
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return lines.join(shops, "l_suppkey").select(
        F.col("l_shipdate").cast("date").alias("date"),
        month.cast("int").alias("date_block_num"),
        "shop_id",
        F.col("l_partkey").alias("item_id"),
        F.when(returned, -F.col("l_quantity"))
        .otherwise(F.col("l_quantity"))
        .alias("item_cnt_day"),
        F.when(gift, F.lit(0.0)).otherwise(price).alias("item_price"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"),
        "l_shipdate",
        "l_returnflag",
        "l_linestatus",
        "l_tax",
    )


def _new_items(spark: SparkSession, folder: str) -> DataFrame:
    parts = _table(spark, folder, "part")
    return parts.where(F.col("p_size") == NEW_SIZE).select(F.col("p_partkey").alias("item_id"))


def read_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales; accepted and finished lines are reported a second time, at another price.

    ``ord`` puts all first reports before the second ones and rows in the order of their
    lines; the price in cents only tells rows of one line apart.
    """
    history = _lines(spark, folder, F.col("l_shipdate") < F.lit(FORECAST_DAY)).join(
        _new_items(spark, folder), "item_id", "left_anti"
    )
    twice = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")
    reports = F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    price = F.when(
        F.col("_report") == 1, F.col("item_price") * (F.lit(SECOND_PRICE) + F.col("l_tax"))
    ).otherwise(F.col("item_price"))
    line = F.col("_report").cast("long") * 10**12 + F.col("line")
    cents = F.round(F.col("item_price") * 100).cast("long")
    return (
        history.withColumn("_report", F.explode(reports))
        .withColumn("item_price", price)
        .select(
            "date",
            "date_block_num",
            "shop_id",
            "item_id",
            "item_price",
            "item_cnt_day",
            (line * 10**6 + cents).alias("ord"),
        )
    )


def read_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct (shop, item) pairs of the forecast month and of pre-orders."""
    new = _new_items(spark, folder).withColumn("_new", F.lit(True))
    wanted = (F.col("l_shipdate") >= F.lit(FORECAST_DAY)) | F.col("_new")
    lines = _lines(spark, folder).join(new, "item_id", "left").where(wanted)
    pairs = lines.select("shop_id", "item_id").distinct()
    # Fewer than 1,000 shops, so the key numbers the pairs.
    return pairs.select(
        (F.col("item_id") * 1000 + F.col("shop_id")).alias("ID"), "shop_id", "item_id"
    )


def read_item_cats(spark: SparkSession, folder: str) -> DataFrame:
    """Categories named by type and brand, numbered in name order."""
    names = _table(spark, folder, "part").select(_category_name()).distinct()
    coded = with_label_code(names, F.col("item_category_name"), "item_category_id")
    return coded.withColumn("item_category_id", F.col("item_category_id").cast("long"))


def read_items(
    spark: SparkSession, folder: str, item_cats: DataFrame | None = None
) -> DataFrame:
    item_cats = read_item_cats(spark, folder) if item_cats is None else item_cats
    parts = _table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("item_name"),
        "p_brand",
        _category_name(),
    )
    category = F.when(F.col("p_brand") != UNCLASSIFIED, F.col("item_category_id"))
    return parts.join(item_cats, "item_category_name").select(
        "item_name", "item_id", category.alias("item_category_id")
    )


def _category_name() -> Column:
    return F.concat_ws(" ", "p_type", "p_brand").alias("item_category_name")


def read_shops(spark: SparkSession, folder: str) -> DataFrame:
    nations = _table(spark, folder, "nation")
    regions = _table(spark, folder, "region")
    return nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("!"), "r_name", F.lit(" "), "n_name").alias("shop_name"),
        F.col("n_nationkey").cast("long").alias("shop_id"),
    )


def read_inputs(spark: SparkSession, folder: str) -> Inputs:
    item_cats = read_item_cats(spark, folder)
    return Inputs(
        sales=read_sales(spark, folder),
        targets=read_targets(spark, folder),
        items=read_items(spark, folder, item_cats),
        item_cats=item_cats,
        shops=read_shops(spark, folder),
        n_blocks=FORECAST_BLOCK,
    )
