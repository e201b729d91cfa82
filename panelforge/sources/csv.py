"""CSV files with a header, read with explicit types and no inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.constants import N_BLOCKS
from panelforge.functions.columns import parse_date
from panelforge.sources.inputs import Inputs

SALES = {
    "date": T.StringType(),
    "date_block_num": T.IntegerType(),
    "shop_id": T.LongType(),
    "item_id": T.LongType(),
    "item_price": T.DoubleType(),
    "item_cnt_day": T.DoubleType(),
}
TARGETS = {"ID": T.LongType(), "shop_id": T.LongType(), "item_id": T.LongType()}
ITEMS = {
    "item_name": T.StringType(),
    "item_id": T.LongType(),
    "item_category_id": T.LongType(),
}
ITEM_CATS = {"item_category_name": T.StringType(), "item_category_id": T.LongType()}
SHOPS = {"shop_name": T.StringType(), "shop_id": T.LongType()}
# The words that stand for a missing value in a file.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Missing keys would match each other in a membership test but never in a join.
KEYS = {"shop_id", "item_id", "date_block_num"}


def read_table(
    spark: SparkSession, path: str, kinds: dict[str, T.DataType], multiline: bool = False
) -> DataFrame:
    """A CSV table by column name, whatever the column order; other columns stay text.

    A quote inside a quoted text is doubled. ``multiline`` allows line breaks in quotes, at
    the price of one task per file. The words of ``MISSING`` become NULL, in numbers and
    texts; a missing key, or a value that is no number where one belongs, stops the read.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
    names = reader.csv(path).columns
    missing = set(kinds) - set(names)
    if missing:
        raise ValueError(f"{path} lacks {sorted(missing)}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = reader.schema(schema).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    return df.withColumns({name: _typed(name, kinds[name], path) for name in kinds})


def _typed(name: str, kind: T.DataType, path: str) -> Column:
    text = F.when(~F.col(name).isin(*MISSING), F.col(name))
    value = text.try_cast(kind)
    bad = F.raise_error(F.concat(F.lit(f"malformed {name} in {path}: "), text)).cast(kind)
    value = F.when(text.isNotNull() & value.isNull(), bad).otherwise(value)
    if name in KEYS:
        lacking = F.raise_error(F.lit(f"missing {name} in {path}")).cast(kind)
        value = F.when(text.isNull(), lacking).otherwise(value)
    return value


def with_file_order(df: DataFrame) -> DataFrame:
    """Add ``ord``, which sorts rows as they stand in the files, files by path.

    Rows of one file split are numbered by the task that reads them; splits are ordered by
    where they begin.
    """
    return df.withColumn(
        "ord",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def read_sales(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    sales = with_file_order(read_table(spark, path, SALES, multiline))
    return sales.withColumn("date", parse_date(F.col("date")))


def read_inputs(
    spark: SparkSession, folder: str, n_blocks: int = N_BLOCKS, multiline: bool = False
) -> Inputs:
    """All five tables from a folder, under their usual names."""

    def table(name: str, kinds: dict[str, T.DataType]) -> DataFrame:
        return read_table(spark, f"{folder}/{name}.csv", kinds, multiline)

    return Inputs(
        sales=read_sales(spark, f"{folder}/sales_train.csv", multiline),
        targets=table("test", TARGETS),
        items=table("items", ITEMS),
        item_cats=table("item_categories", ITEM_CATS),
        shops=table("shops", {"shop_name": T.StringType()}),
        n_blocks=n_blocks,
    )


def write_table(df: DataFrame, path: str) -> None:
    """Write the CSV form that ``read_table`` reads; dates as day-first text."""
    dates = {
        f.name: F.date_format(f.name, "d.M.yyyy")
        for f in df.schema.fields
        if isinstance(f.dataType, T.DateType)
    }
    writer = df.withColumns(dates).write.option("header", True).option("escape", '"')
    for side in ("Leading", "Trailing"):
        writer = writer.option(f"ignore{side}WhiteSpace", False)
    writer.csv(path)
