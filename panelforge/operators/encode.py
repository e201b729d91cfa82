"""Label codes and indicator columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import city_word, group_word
from panelforge.operators.ordering import dense_positions
from panelforge.session import materialize

# Values that may become columns of a table.
MAX_COLUMNS = 20_000


def with_label_code(df: DataFrame, label: Column, out: str, **limits: int) -> DataFrame:
    """Add ``out``: the rank from 0 of ``label`` among its sorted distinct values.

    Order is binary, the same as by code point. A NULL label keeps a NULL code.
    """
    labelled = df.withColumn("_label", label)
    labels = labelled.where(F.col("_label").isNotNull()).select("_label").distinct()
    codes = dense_positions(labels, ["_label"], out, **limits).withColumn(
        out, F.col(out).cast("int")
    )
    return labelled.join(codes, "_label", "left").drop("_label")


def encode_groups(item_cats: DataFrame) -> DataFrame:
    """Categories with ``item_group``, the code of the first word of the category name."""
    return with_label_code(item_cats, group_word(F.col("item_category_name")), "item_group")


def encode_items(items: DataFrame, item_cats: DataFrame) -> DataFrame:
    """Items with the ``item_group`` of their category; NULL where the category is unknown."""
    groups = encode_groups(item_cats).select("item_category_id", "item_group")
    return items.join(groups, "item_category_id", "left")


def encode_shops(shops: DataFrame) -> DataFrame:
    """Shops with ``city``, the code of the first word of the shop name."""
    return with_label_code(shops, city_word(F.col("shop_name")), "city")


def label_words(item_cats: DataFrame, shops: DataFrame) -> DataFrame:
    """The distinct words behind the codes of categories and shops."""
    groups = item_cats.select(
        F.lit("item_group").alias("code"), group_word(F.col("item_category_name")).alias("word")
    )
    cities = shops.select(F.lit("city").alias("code"), city_word(F.col("shop_name")).alias("word"))
    return groups.unionByName(cities).distinct()


def distinct_values(df: DataFrame, column: str, limit: int = MAX_COLUMNS) -> list:
    """Sorted distinct non-NULL values of a column that is about to become column names.

    A table has its column names in its schema on the driver, so the names go there too. With
    more than ``limit`` a table of so many columns is no use, and this raises: the sparse
    forms (``one_hot_vector``, ``reshape.pivot_sum_map``) have no such limit.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    rows = values.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} values of {column} for columns; use a sparse form")
    return sorted(row[0] for row in rows)


def one_hot(
    df: DataFrame, label: Column, prefix: str, labels: Sequence | None = None
) -> DataFrame:
    """One 0/1 column per label, the first in sort order left out.

    ``labels`` saves looking for them.
    """
    labelled = df.withColumn("_label", label)
    kept = (distinct_values(labelled, "_label") if labels is None else sorted(labels))[1:]
    indicators = {
        f"{prefix}_{value}": (F.col("_label") == F.lit(value)).cast("int") for value in kept
    }
    return labelled.withColumns(indicators).drop("_label")


def one_hot_vector(df: DataFrame, label: Column, out: str, **limits: int) -> DataFrame:
    """The same indicators as one sparse vector: 1 at the place of the label's code minus 1.

    The first label and a missing one have none. Codes come from a global order, so no label
    passes through the driver, which only learns how many there are.
    """
    coded = materialize(with_label_code(df, label, "_code", **limits), "codes")
    last = coded.agg(F.max("_code").alias("last")).first()["last"]
    if not last:
        return coded.drop("_code").withColumn(out, array_to_vector(F.array().cast("array<double>")))
    # Beyond all codes: the encoder keeps that apart, and leaves the last place out.
    none = F.lit(last)
    place = F.when(F.col("_code") > 0, F.col("_code") - 1).otherwise(none).cast("double")
    encoder = OneHotEncoder(
        inputCols=["_place"], outputCols=[out], dropLast=True, handleInvalid="keep"
    )
    sizes = df.sparkSession.range(1).select(F.lit(float(last - 1)).alias("_place"))
    return encoder.fit(sizes).transform(coded.withColumn("_place", place)).drop("_code", "_place")
