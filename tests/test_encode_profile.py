"""Codes, running totals and summaries against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions.columns import discount_rate
from panelforge.operators import encode, ordering, profile, reshape
from small import by_key

LIMITS = [{}, {"rows_per_slice": 7}]


@pytest.mark.parametrize("limits", LIMITS)
def test_codes_follow_code_points(spark, limits):
    names = ["Игры PC", "Книги x", "éa b", "Z a", "a z", "中 文", "😀 x", " lead", "", "Z b"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    got = by_key(
        encode.with_label_code(df, F.substring_index("name", " ", 1), "code", **limits), "id"
    )
    words = pd.Categorical([n.split(" ")[0] for n in names])
    assert [got[(i,)]["code"] for i in range(len(names))] == list(words.codes)


def test_missing_category_name_is_a_group(spark):
    cats = spark.createDataFrame(
        [(0, "zoo a"), (1, None), (2, "abc d")], "item_category_id int, item_category_name string"
    )
    got = by_key(encode.encode_groups(cats), "item_category_id")
    assert [got[(i,)]["item_group"] for i in range(3)] == [2, 1, 0]


def test_items_of_unknown_category_have_no_group(spark):
    cats = spark.createDataFrame([(0, "x y")], "item_category_id int, item_category_name string")
    items = spark.createDataFrame([(1, 0), (2, 9)], "item_id int, item_category_id int")
    got = by_key(encode.encode_items(items, cats), "item_id")
    assert [got[(i,)]["item_group"] for i in (1, 2)] == [0, None]


def test_city_ignores_marks(spark):
    shops = spark.createDataFrame([("!AB Cd",), ("AB x",), ("AA! q",)], "shop_name string")
    got = by_key(encode.encode_shops(shops), "shop_name")
    assert [got[(n,)]["city"] for n in ("!AB Cd", "AB x", "AA! q")] == [1, 1, 0]


def test_one_hot_drops_the_first(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "w string")
    got = by_key(encode.one_hot(df, F.col("w"), "g"), "w")
    assert got[("a",)] == {"w": "a", "g_b": 0, "g_c": 0}
    assert got[("c",)] == {"w": "c", "g_b": 0, "g_c": 1}


def test_too_many_label_columns_are_an_error(spark):
    assert encode.distinct_values(spark.range(12_000), "id") == list(range(12_000))
    with pytest.raises(ValueError, match="sparse"):
        encode.distinct_values(spark.range(31), "id", limit=30)


def test_sparse_indicators_equal_the_columns(spark):
    words = ["b", "a", "c", None, "d", "b", "a"]
    df = spark.createDataFrame(list(enumerate(words)), "id int, w string")
    wide = by_key(encode.one_hot(df, F.col("w"), "g"), "id")
    sparse = by_key(encode.one_hot_vector(df, F.col("w"), "v"), "id")
    assert len(sparse) == len(words)
    for key, row in sparse.items():
        assert [float(wide[key][f"g_{x}"] or 0) for x in "bcd"] == row["v"].toArray().tolist()


def test_sparse_indicators_of_many_labels(spark):
    n = 100_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("w"), F.lit("x").alias("_place"))
    made = encode.one_hot_vector(df.drop("_place"), F.lpad(F.col("w").cast("string"), 6, "0"), "v")
    size = F.udf(lambda v: [v.size, *v.indices.tolist()], "array<int>")
    wrong = made.where(size("v") != F.when(F.col("w") > 0, F.array(F.lit(n - 1), (F.col("w") - 1).cast("int"))).otherwise(F.array(F.lit(n - 1))))
    assert made.count() == n and wrong.isEmpty()


def test_sparse_indicators_of_few_labels(spark):
    for words in ([], ["a", "a"], [None]):
        df = spark.createDataFrame([(w,) for w in words], "w string")
        got = encode.one_hot_vector(df, F.col("w"), "v").collect()
        assert [r["v"].toArray().tolist() for r in got] == [[]] * len(words)


def test_sparse_pivot_equals_the_columns(spark):
    rows = [(1, "x", 2.0), (1, "x", 3.0), (1, "y", -1.0), (2, "z", 4.0)]
    df = spark.createDataFrame(rows, "k int, c string, v double")
    wide = by_key(reshape.pivot_sum(df, ["k"], "c", "v", ["x", "y", "z"]), "k")
    for key, row in by_key(reshape.pivot_sum_map(df, ["k"], "c", "v", "m"), "k").items():
        assert {c: row["m"].get(c, 0.0) for c in "xyz"} == {c: wide[key][c] for c in "xyz"}


def test_one_hot_with_labels_given(spark):
    df = spark.createDataFrame([("b",), ("a",)], "w string")
    assert encode.one_hot(df, F.col("w"), "g", ["c", "b", "a"]).columns == ["w", "g_b", "g_c"]


@pytest.mark.parametrize("limits", LIMITS)
def test_running_total(spark, limits):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("k"), (F.col("id") % 5).alias("w"))
    got = ordering.running_total(df, ["k"], F.col("w"), "t", **limits).toPandas().sort_values("k")
    assert list(got["t"]) == list(got["w"].cumsum() - got["w"])


@pytest.mark.parametrize("limits", [{}, {"buckets": 2}])
def test_describe_matches_pandas(spark, limits):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(
        {"a": rng.integers(-5, 9, 237).astype(float), "b": rng.normal(size=237), "c": 1.0}
    )
    pdf.loc[::7, "b"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double")
    got = by_key(profile.describe(df, "a", "b", "c", **limits), "column")
    wanted = pdf.describe()
    names = dict(zip(wanted.index, ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]))
    for column in pdf:
        for theirs, mine in names.items():
            assert got[(column,)][mine] == pytest.approx(wanted.loc[theirs, column])


@pytest.mark.parametrize("buckets", [2, 3, 4096])
def test_values_at_any_rank(spark, buckets):
    """Equal, close, huge and skewed values; every rank is the one of the sorted list."""
    draw = np.random.default_rng(7)
    lists = {
        "close": (1.0 + np.arange(40) * 2.0**-52).tolist(),
        "huge": [-1.7e308, 1.7e308, 0.0, 1e-300, -1e-300, 5e-324, 1e300] * 3,
        "equal": [3.25] * 50,
        "infinite": [-np.inf, -np.inf, 1.0, 2.0, 5.0, np.inf],
        "skewed": np.exp(draw.normal(0, 20, 300)).tolist() + [0.0] * 200,
    }
    rows = [(name, v) for name, values in lists.items() for v in values]
    df = spark.createDataFrame([(c, float(v)) for c, v in rows], "column string, value double")
    counts = df.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).cache()
    ranks = [
        profile._Rank(name, k, min(values), max(values))
        for name, values in lists.items()
        for k in range(0, len(values), 1 + len(values) // 6)
    ]
    wanted = [sorted(lists[r.column])[r.at] for r in ranks]
    assert profile.values_at(counts, ranks, buckets) == wanted


def test_describe_sorts_nothing(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003 / 3).alias("v"))
    made = profile.describe(df, "v")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "rangepartitioning" not in plan and "Window" not in plan


def test_describe_keeps_a_column_without_values(spark):
    none = F.lit(None).cast("double").alias("none")
    for df in (spark.range(0).select("id", none), spark.range(3).select("id", none)):
        got = by_key(profile.describe(df, "id", "none"), "column")
        assert set(got) == {("id",), ("none",)}
        row = got[("none",)]
        assert row.pop("count") == 0
        assert set(row.pop("column")) == set("none") and set(row.values()) == {None}


def test_largest_and_shapes(spark):
    df = spark.range(100).toDF("v")
    assert [r["v"] for r in profile.largest(df, "v", 3).collect()] == [99, 98, 97]
    assert profile.shapes({"t": df}).collect() == [("t", 100, 1)]
    assert [r["v"] for r in profile.first_rows(df, ["v"], 2).collect()] == [0, 1]


def test_discount(spark):
    df = spark.createDataFrame([(8.0, 10.0), (0.0, 0.0), (5.0, 5.0)], "p double, m double")
    rates = [r[0] for r in df.select(discount_rate(F.col("p"), F.col("m"))).collect()]
    assert rates[0] == pytest.approx(0.2)
    assert rates[1:] == [None, 0.0]
