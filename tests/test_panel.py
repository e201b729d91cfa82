"""The dense panel on hand-made sales."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from panelforge.operators import clean, lags, panel, profile, reshape, stats
from small import SALES, by_key, sales_frame, small_panel, targets_frame

KEY = ("date_block_num", "shop_id", "item_id")
ROWS = [
    (0, 1, 10, 5, 100.0),
    (1, 1, 10, 1, 100.0),
    (1, 1, 10, -4, 110.0),
    (2, 2, 11, 15, 50.0),
    (2, 2, 11, 16, 70.0),
    (3, 1, 10, 3, 90.0),
    (6, 1, 10, 9, 90.0),  # after the grid
    (-1, 1, 10, 9, 90.0),  # before the grid
    (0, 3, 10, 7, 90.0),  # shop without target
    (0, 1, 12, 7, 90.0),  # item without target
]
PAIRS = [(1, 10), (2, 11)]


@pytest.fixture(scope="module")
def small(spark):
    return small_panel(spark, ROWS, PAIRS, 6)


def test_monthly(small):
    got = by_key(panel.monthly(small[0]), *KEY)
    assert len(got) == 6 * 2 * 2

    def cell(*key):
        return got[key]["item_cnt"], got[key]["item_order"]

    assert cell(0, 1, 10) == (5, 1)
    assert cell(1, 1, 10) == (0, 2)  # net return, clipped
    assert cell(2, 2, 11) == (20, 2)  # 31, clipped
    assert cell(4, 1, 10) == (0, 1)  # empty
    assert cell(0, 1, 11) == (0, 1)  # pair not among the targets


def test_months_of_full_and_empty_histories(spark):
    """Cells in any order, at both ends, and gaps of any length."""
    blocks = {1: [5, 0, 3, 2], 2: [], 3: [0, 1, 2, 3, 4, 5], 4: [4]}
    rows = [(m, s, 10, m + 1, 1.0) for s, months in blocks.items() for m in months]
    made, _ = small_panel(spark, rows, [(s, 10) for s in blocks], 6)
    for row in made.series.select("shop_id", made.months().alias("x")).collect():
        assert row["x"] == [m + 1 if m in blocks[row["shop_id"]] else 0 for m in range(6)]


def test_total_before_clipping_is_kept(small):
    raw = small[0].cells.agg(F.sum("item_cnt"), F.sum("item_order")).first()
    assert tuple(raw) == (5 + 1 - 4 + 15 + 16 + 3, 6)


def test_grid_check(small):
    row = panel.grid_check(small[1], 6).first()
    assert (row["grid_rows"], row["expected_rows"]) == (24, 24)


def test_product_is_whole(spark):
    left, right = spark.range(57).toDF("a"), spark.range(13).toDF("b")
    pairs = panel.product(left, right, 57, 13, tasks=7)
    assert pairs.count() == pairs.distinct().count() == 57 * 13


def test_mean_price_is_not_weighted(small):
    got = by_key(panel.mean_price(small[0]), *KEY)
    assert got[(1, 1, 10)]["item_price"] == 105.0
    assert got[(2, 2, 11)]["item_price"] == 60.0
    assert got[(4, 1, 10)]["item_price"] is None


def test_missing_count_is_a_sale_of_zero(spark):
    sales = sales_frame(spark, [(0, 1, 1, 2, 5.0), (0, 1, 1, 3, 5.0)]).withColumn(
        "item_cnt_day", F.when(F.col("item_cnt_day") == 2, F.col("item_cnt_day"))
    )
    targets = panel.load_targets(targets_frame(spark, [(1, 1)]))
    row = panel.monthly(panel.build_panel(sales, targets, 1)).first()
    assert (row["item_cnt"], row["item_order"]) == (2, 2)


def test_repeats_keep_the_first_price(spark):
    day = date(2013, 1, 1)
    rows = [
        (day, 0, 1, 1, 2.0, 11.0, 1),
        (day, 0, 1, 1, 2.0, 10.0, 0),
        (day, 0, 1, 1, 3.0, 12.0, 2),
    ]
    sales = spark.createDataFrame(rows, SALES)
    kept = clean.drop_repeats(sales).select("item_cnt_day", "item_price").collect()
    assert sorted(map(tuple, kept)) == [(2.0, 10.0), (3.0, 12.0)]
    counts = {r["is_duplicate"]: r["n_rows"] for r in clean.repeat_counts(sales).collect()}
    assert counts == {False: 2, True: 1}
    unique = clean.repeat_counts(clean.drop_repeats(sales)).collect()
    assert [tuple(r) for r in unique] == [(False, 2)]


def test_lags_are_shifted_months(small):
    monthly = by_key(panel.monthly(small[0]), *KEY)
    got = by_key(lags.lags(small[0], (1, 2, 3)), *KEY)
    assert {key[0] for key in got} == set(range(1, 7))
    for (block, shop, item), row in got.items():
        for k in (1, 2, 3):
            suffix = "" if k == 1 else str(k)
            past = monthly.get((block - k, shop, item), {"item_cnt": None, "item_order": None})
            assert row[f"cnt_prev{suffix}"] == past["item_cnt"]
            assert row[f"order_prev{suffix}"] == past["item_order"]


def test_pivot_and_back(small):
    wide = reshape.pivot_monthly(small[0])
    assert wide.columns == ["shop_id", "item_id", *map(str, range(6))]
    back = by_key(reshape.unpivot_monthly(wide, 6), *KEY)
    monthly = by_key(panel.monthly(small[0]), *KEY)
    assert {k: v["item_cnt"] for k, v in back.items()} == {
        k: v["item_cnt"] for k, v in monthly.items()
    }


def test_pivot_sum_fills_empty_cells(spark):
    long = spark.createDataFrame([(1, 0, 2.0), (1, 0, 3.0), (2, 1, 4.0)], "k int, c int, v double")
    got = by_key(reshape.pivot_sum(long, ["k"], "c", "v", [0, 1, 2]), "k")
    assert got[(1,)] == {"k": 1, "0": 5.0, "1": 0.0, "2": 0.0}


def test_shop_item_stats(small):
    pdf = panel.monthly(small[0]).toPandas()
    wanted = pdf.groupby(["shop_id", "item_id"]).agg(
        mean=("item_cnt", "mean"),
        med=("item_cnt", "median"),
        std=("item_cnt", "std"),
        order=("item_order", "mean"),
    )
    got = by_key(stats.shop_item_stats(small[0]), "shop_id", "item_id")
    assert len(got) == len(wanted)
    for key, row in wanted.iterrows():
        mine = got[key]
        assert mine["cnt_mean_shop"] == pytest.approx(row["mean"])
        assert mine["cnt_med_shop"] == pytest.approx(row["med"])
        assert mine["cnt_std_shop"] == pytest.approx(row["std"])
        assert mine["order_mean_shop"] == pytest.approx(row["order"])


def test_stats_of_one_month(spark):
    one, _ = small_panel(spark, [(0, 1, 1, 3, 1.0)], [(1, 1)], 1)
    row = stats.shop_item_stats(one).first()
    assert (row["cnt_mean_shop"], row["cnt_med_shop"], row["cnt_std_shop"]) == (3, 3, None)


def test_clip_bounds_that_exclude_zero(spark):
    """Empty cells are clipped like all others."""
    one, _ = small_panel(spark, [(0, 1, 1, 3, 1.0)], [(1, 1)], 3, bounds=(1.0, 2.0))
    values = [r["item_cnt"] for r in panel.monthly(one).orderBy("date_block_num").collect()]
    assert values == [2.0, 1.0, 1.0]
    row = stats.shop_item_stats(one).first()
    assert row["cnt_mean_shop"] == pytest.approx(4 / 3)
    assert row["cnt_med_shop"] == 1.0


def _items(spark):
    rows = [(10, 5, 0, "a"), (11, 6, None, "b")]
    return spark.createDataFrame(
        rows, "item_id long, item_category_id long, item_group int, item_name string"
    )


def test_group_means_leave_out_items_without_group(spark, small):
    got = by_key(stats.shop_group_mean(*small, _items(spark)), "shop_id", "item_group")
    assert {k: v["cnt_mean_shop_cat"] for k, v in got.items()} == {
        (1, 0): pytest.approx(8 / 6),
        (2, 0): 0.0,
    }
    lagged = by_key(stats.group_lag_mean(*small, _items(spark)), *KEY[:2], "item_group")
    assert len(lagged) == 6 * 2
    assert lagged[(1, 1, 0)]["cnt_prev_cat"] == 5.0
    assert lagged[(6, 2, 0)]["cnt_prev_cat"] == 0.0


def test_monthly_totals_and_groups(spark, small):
    totals = {r["date_block_num"]: r["item_cnt"] for r in stats.monthly_total(small[0]).collect()}
    assert totals == {0: 5, 1: 0, 2: 20, 3: 3, 4: 0, 5: 0}
    wide = by_key(stats.pivot_group(*small, _items(spark)), "date_block_num")
    assert [wide[(m,)]["0"] for m in range(6)] == [5, 0, 0, 3, 0, 0]


def test_monthly_with_items(spark, small):
    got = by_key(panel.monthly_with_items(small[0], _items(spark)), *KEY)
    assert len(got) == 24
    assert got[(0, 1, 10)]["item_group"] == 0
    assert got[(0, 1, 11)]["item_group"] is None


def test_stored_panel_gives_the_same(spark, small):
    stored, _ = small_panel(spark, ROWS, PAIRS, 6, store=True)
    assert panel.monthly(stored).exceptAll(panel.monthly(small[0])).isEmpty()
    assert panel.monthly(small[0]).exceptAll(panel.monthly(stored)).isEmpty()


def test_describe_monthly_is_before_clipping(small):
    got = by_key(profile.describe_monthly(*small), "column")
    assert got[("item_cnt",)]["min"] == -3.0
    assert got[("item_cnt",)]["max"] == 31.0
    assert got[("item_cnt",)]["count"] == 24
    assert got[("item_order",)]["mean"] == pytest.approx(26 / 24)


def test_a_hot_cell_and_a_hot_key(spark):
    """A third of all rows are copies of one sale, another third one item's."""
    n = 9000
    base = spark.range(n).select(
        F.lit(date(2013, 1, 1)).alias("date"),
        F.when(F.col("id") % 3 == 0, 0).otherwise((F.col("id") % 4).cast("int")).alias(KEY[0]),
        F.lit(1).cast("long").alias("shop_id"),
        F.when(F.col("id") % 3 == 2, F.col("id") % 50).otherwise(0).alias("item_id"),
        F.when(F.col("id") % 3 == 0, 2.0).otherwise(F.col("id").cast("double")).alias(
            "item_cnt_day"
        ),
        F.lit(1.0).alias("item_price"),
        F.col("id").alias("ord"),
    )
    targets = panel.load_targets(targets_frame(spark, [(1, i) for i in range(50)]))
    cells = panel.monthly_cells(base, targets, 4).toPandas()
    wanted = (
        base.toPandas()
        .drop_duplicates(["date", *KEY, "item_cnt_day"])
        .groupby(list(KEY))["item_cnt_day"]
        .agg(["sum", "count"])
    )
    got = cells.set_index(list(KEY)).sort_index()
    assert (got["item_cnt"] == wanted["sum"]).all()
    assert (got["item_order"] == wanted["count"]).all()
    assert len(got) == len(wanted)
