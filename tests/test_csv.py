"""The CSV source."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from panelforge.operators.clean import drop_repeats
from panelforge.operators.panel import build_panel, load_targets
from panelforge.plans import reports
from panelforge.plans.features import build_features
from panelforge.sources import csv

HEADER = "date,date_block_num,shop_id,item_id,item_price,item_cnt_day\n"


def test_dates_padded_or_not(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text(HEADER + "2.1.2013,0,59,22154,999.0,1.0\n15.01.2013,0,25,2552,899.0,-1.0\n")
    rows = csv.read_sales(spark, str(path)).orderBy("ord").collect()
    assert [r["date"] for r in rows] == [date(2013, 1, 2), date(2013, 1, 15)]
    assert [r["item_cnt_day"] for r in rows] == [1.0, -1.0]


def test_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "i.csv"
    path.write_text('item_category_id,extra,item_id,item_name\n4,x,7,"a, b"\n')
    row = csv.read_table(spark, str(path), csv.ITEMS).first()
    assert (row["item_id"], row["item_category_id"], row["item_name"]) == (7, 4, "a, b")
    assert row["extra"] == "x"


def test_quotes_commas_spaces_and_line_breaks(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('shop_name,shop_id\n"Town ""Mall"", a\\b",1\n lead x,2\n"two\nlines",3\n')
    rows = csv.read_table(spark, str(path), csv.SHOPS, multiline=True).collect()
    names = ['Town "Mall", a\\b', " lead x", "two\nlines"]
    assert [r["shop_name"] for r in rows] == names

    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "shop_name string, shop_id long")
    csv.write_table(df, f"{tmp_path}/back")
    back = csv.read_table(spark, f"{tmp_path}/back", csv.SHOPS, multiline=True)
    assert sorted(back.collect()) == sorted(df.collect())


def test_missing_column_key_or_bad_value(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("ID,shop_id\n1,2\n")
    with pytest.raises(ValueError, match="item_id"):
        csv.read_table(spark, str(path), csv.TARGETS)
    path.write_text("ID,shop_id,item_id\n1,,5\n")
    with pytest.raises(Exception, match="missing shop_id"):
        csv.read_table(spark, str(path), csv.TARGETS).collect()
    path.write_text("ID,shop_id,item_id\n1,x,5\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        csv.read_table(spark, str(path), csv.TARGETS).collect()


def test_file_order_over_splits_and_files(spark, tmp_path):
    """Rows sort as they stand in the files, however the files are cut and packed."""
    n = 4000
    for name, start in (("b.csv", n), ("a.csv", 0), ("c.csv", 2 * n)):
        size = n if name != "a.csv" else n
        lines = [f"1.1.2013,0,1,{start + i},5.0,1.0\n" for i in range(size)]
        (tmp_path / name).write_text(HEADER + "".join(lines))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        sales = csv.read_sales(spark, str(tmp_path))
        assert sales.rdd.getNumPartitions() > 3
        ids = [r["item_id"] for r in sales.orderBy("ord").select("item_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert ids == list(range(3 * n))


def test_first_repeat_in_the_file_wins(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text(HEADER + "".join(f"1.1.2013,0,1,2,{p}.0,1.0\n" for p in (7, 9, 3)))
    row = drop_repeats(csv.read_sales(spark, str(path))).first()
    assert row["item_price"] == 7.0


def test_all_features_from_csv(spark, tmp_path):
    """The five files under their usual names give the thirteen tables."""
    sales = spark.range(600).select(
        F.expr("date_add(date'2013-01-01', cast(id % 1000 as int))").alias("date"),
        (F.col("id") % 34).cast("int").alias("date_block_num"),
        (F.col("id") % 3).alias("shop_id"),
        (F.col("id") % 7).alias("item_id"),
        (F.col("id") % 11 + 1).cast("double").alias("item_price"),
        (F.col("id") % 5 - 1).cast("double").alias("item_cnt_day"),
    )
    csv.write_table(sales, f"{tmp_path}/sales_train.csv")
    texts = {
        "test.csv": ["ID,shop_id,item_id", "0,0,1", "1,1,2", "2,1,9"],
        "items.csv": ["item_name,item_id,item_category_id"]
        + [f"n{i},{i},{i % 2}" for i in (1, 2, 9)],
        "item_categories.csv": ["item_category_name,item_category_id", "Games a,0", "Books b,1"],
        "shops.csv": ["shop_name,shop_id", "!Town x,0", "City y,1"],
    }
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")

    inputs = csv.read_inputs(spark, str(tmp_path))
    tables = build_features(inputs)
    rows = {name: df.count() for name, df in tables.items()}
    assert rows == {
        "items": 3,
        "shops": 2,
        "monthly": 34 * 6,
        "shop_item_stats": 6,
        "shop_group_mean": 4,
        "lags": 34 * 6,
        "group_lag_mean": 34 * 4,
        "monthly_total": 34,
        "pivot_group": 34,
        "pivot_monthly": 6,
        "trend": 34 * 6,
        "train_price": rows["train_price"],
        "test_price": rows["test_price"],
    }
    assert rows["test_price"] >= 1

    targets = load_targets(inputs.targets)
    panel = build_panel(inputs.sales, targets)
    summaries = {
        **reports.input_reports(inputs, targets),
        **reports.panel_reports(panel, targets),
        **reports.feature_reports(tables),
    }
    assert [r["item_id"] for r in summaries["never_sold"].collect()] == [9]
    assert summaries["grid_check"].first()["grid_rows"] == 34 * 6
    assert {n: df.count() for n, df in summaries.items() if n.startswith("head_")} == {
        f"head_{n}": min(5, rows[n]) for n in tables
    }


def test_missing_markers(spark, tmp_path):
    """Words for a missing value are NULL, in numbers and texts, never NaN."""
    words = ["NaN", "NA", "null", "N/A", "", "nan", "None"]
    path = tmp_path / "t.csv"
    lines = [f"02.01.2013,0,1,{k},{w},{w}" for k, w in enumerate(words)]
    lines.append("2.1.2013,0,1,99,5.0,1.0")
    header = "date,date_block_num,shop_id,item_id,item_price,item_cnt_day"
    path.write_text("\n".join([header, *lines]) + "\n")
    rows = {r["item_id"]: r for r in csv.read_sales(spark, str(path)).collect()}
    for k in range(len(words)):
        assert rows[k]["item_price"] is None and rows[k]["item_cnt_day"] is None
    assert (rows[99]["item_price"], rows[99]["item_cnt_day"]) == (5.0, 1.0)
    path.write_text("item_category_name,item_category_id\nNA,1\nname NA,2\n")
    cats = csv.read_table(spark, str(path), csv.ITEM_CATS).collect()
    assert [r["item_category_name"] for r in cats] == [None, "name NA"]
    path.write_text("ID,shop_id,item_id\n1,NA,5\n")
    with pytest.raises(Exception, match="missing shop_id"):
        csv.read_table(spark, str(path), csv.TARGETS).collect()


def test_a_missing_count_is_a_sale_of_nothing(spark, tmp_path):
    from panelforge.operators import panel

    path = tmp_path / "t.csv"
    header = "date,date_block_num,shop_id,item_id,item_price,item_cnt_day"
    path.write_text(f"{header}\n02.01.2013,0,1,1,NaN,NaN\n03.01.2013,0,1,1,5.0,1.0\n")
    targets = spark.createDataFrame([(0, 1, 1)], "ID long, shop_id long, item_id long")
    built = panel.build_panel(csv.read_sales(spark, str(path)), panel.load_targets(targets), 1)
    assert [r["item_cnt"] for r in panel.monthly(built).collect()] == [1.0]
    assert [r["item_price"] for r in panel.mean_price(built).collect()] == [5.0]
