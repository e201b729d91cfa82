"""Last prices, discounts and predicted prices on hand-made sales."""

import pytest

from panelforge.operators import clean, impute, prices
from small import by_key, sent_to_tasks, small_panel

ROWS = [
    (2, 1, 10, 1, 10.0),
    (5, 1, 10, 1, 12.0),
    (3, 2, 10, 1, 8.0),
    (1, 1, 11, 1, 0.0),
]
PAIRS = [(1, 10), (2, 11), (1, 12), (2, 12), (3, 10)]
PAIR = ("shop_id", "item_id")


@pytest.fixture(scope="module")
def priced(spark):
    panel, targets = small_panel(spark, ROWS, PAIRS, 6)
    return prices.priced_rows(panel.cells), targets.pairs


def _items(spark, ids=(10, 11, 12)):
    rows = [(i, i % 2, 0) for i in ids]
    return spark.createDataFrame(rows, "item_id long, item_category_id long, item_group int")


def test_last_price(priced):
    got = by_key(prices.last_price(priced[0]), *PAIR)
    assert {k: v["item_price"] for k, v in got.items()} == {
        (1, 10): 12.0,
        (2, 10): 8.0,
        (1, 11): 0.0,
    }


def test_unpriced_is_by_item(priced):
    """(2, 11) has no price, but its item has one elsewhere."""
    got = by_key(prices.unpriced_pairs(priced[1], priced[0]), *PAIR)
    assert set(got) == {(1, 12), (2, 12)}


def test_train_discount(priced):
    got = by_key(prices.train_price_discount(priced[0]), "date_block_num", *PAIR)
    assert got[(2, 1, 10)]["discount_rate"] == pytest.approx(1 - 10 / 12)
    assert got[(5, 1, 10)]["discount_rate"] == 0
    assert got[(1, 1, 11)]["discount_rate"] is None  # highest price is zero


def test_item_mean_price(priced):
    got = by_key(prices.item_mean_price(priced[1], priced[0]), *PAIR)
    assert got[(1, 10)]["item_price"] == pytest.approx(10.0)
    assert got[(1, 12)]["item_price"] is None
    assert len(got) == len(PAIRS)


def test_coverage(spark, priced):
    price, targets = priced
    got = by_key(prices.price_coverage(targets, price, _items(spark, (10, 11))), *PAIR)
    assert {k: (v["is_target"], v["is_priced"], v["status"]) for k, v in got.items()} == {
        (1, 10): (True, True, "known"),
        (2, 10): (False, True, "no target"),
        (1, 11): (False, True, "no target"),
        (2, 11): (True, False, "elsewhere"),
        (3, 10): (True, False, "elsewhere"),
        (1, 12): (True, False, "unknown item"),
        (2, 12): (True, False, "unknown item"),
    }
    got = by_key(prices.price_coverage(targets, price, _items(spark)), *PAIR)
    assert got[(1, 12)]["status"] == "predicted" and got[(1, 12)]["is_priced"]


def test_reconcile_counts_rows_and_missing_keys(spark):
    left = spark.createDataFrame([(1, None), (1, None), (2, 5)], "a int, b int")
    right = spark.createDataFrame([(1, None), (3, 3)], "a int, b int")
    got = clean.reconcile(left, right, ["a", "b"], ("n", "m")).collect()
    assert sorted(map(tuple, got), key=str) == [(1, None, 2, 1), (2, 5, 1, 0), (3, 3, 0, 1)]


def test_target_prices(spark, priced):
    price, targets = priced
    wanted = impute.target_price(targets, price, _items(spark))
    got = by_key(prices.target_price_discount(wanted, price), *PAIR)
    assert set(got) == {(1, 10), (2, 10), (1, 11), (1, 12), (2, 12)}
    assert 0 <= got[(1, 12)]["item_price"] <= 12
    assert got[(1, 12)]["discount_rate"] == 0


def test_items_without_a_row_are_not_predicted(spark, priced):
    got = impute.impute_price(priced[1], priced[0], _items(spark, (10, 11)))
    assert got.count() == 0
    assert got.columns == ["shop_id", "item_id", "item_price"]


def test_no_unpriced_item(spark, priced):
    price, targets = priced
    known = targets.where("item_id != 12")
    got = impute.target_price(known, price, _items(spark))
    assert got.count() == 3


def test_items_without_a_category_get_a_price(spark, priced):
    items = spark.createDataFrame(
        [(10, 0, 0), (11, None, None), (12, None, None)],
        "item_id long, item_category_id long, item_group int",
    )
    got = by_key(impute.impute_price(priced[1], priced[0], items), *PAIR)
    assert set(got) == {(1, 12), (2, 12)}
    assert all(0 <= row["item_price"] <= 12 for row in got.values())


def test_the_model_does_not_follow_the_partitions(spark):
    """Equal predictions however the rows come, as from another cluster."""
    rows = [(m % 6, s, i, 1, 1.0 + (s * 7 + i * 13 + m) % 50) for m, s, i in TRIPLES]
    pairs = [(s, i) for s in range(8) for i in range(40, 50)]
    panel, targets = small_panel(spark, rows, pairs + [(s, i) for _, s, i in TRIPLES], 6)
    price = prices.priced_rows(panel.cells)
    found = [
        by_key(impute.impute_price(targets.pairs, price.repartition(n), _items(spark, range(50))), *PAIR)
        for n in (1, 7)
    ]
    assert len(found[0]) == len(pairs)
    assert found[0] == found[1]


@pytest.mark.parametrize("local_rows", [10**6, 60])
def test_tasks_get_little_of_a_small_price_model(spark, monkeypatch, local_rows):
    """25 trees of depth 15 on 320 pairs, with and without passes over the rows."""
    rows = [(m, s, i, 1, 1.0 + (s * 7 + i * 13 + m) % 50) for m, s, i in TRIPLES]
    pairs = [(s, i) for s in range(8) for i in range(50)]
    panel, targets = small_panel(spark, rows, pairs, 6)
    price, items = prices.priced_rows(panel.cells), _items(spark, range(50))
    sent = sent_to_tasks(price, monkeypatch)
    model = impute.fit_price_model(price, items, local_rows)
    wanted = impute._with_features(prices.unpriced_pairs(targets.pairs, price), items)
    got = by_key(model.predict(wanted, "item_price"), *PAIR)
    assert set(got) == {(s, i) for s in range(8) for i in range(40, 50)}
    assert {"mapInArrow", "pandas_udf"} <= {name for name, _ in sent}
    assert max(size for _, size in sent) < 100_000 + 9 * 25 * 2 * 320, sent


TRIPLES = [(m, s, i) for m in range(3) for s in range(8) for i in range(40) if (m + s * i) % 3]
