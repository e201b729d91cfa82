"""Every named query against DuckDB on the same tables, values equal."""

import os

import pytest

import __spark_entry__ as contract
import compare
from oracle.sql import ORACLES
from panelforge.plans.catalog import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
ROWS_ONLY = {"impute_price", "test_price", "test_price_discount"}


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


def test_only_model_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = contract.queries()[name](spark, FOLDER).toPandas()
    wanted = duck.execute(contract.oracle_sql()[name]).df()
    assert len(got) > 0
    assert compare.difference(got, wanted) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["date_block_num", "shop_id", "item_id", "item_cnt", "item_order"]
    assert df.count() > 0


def test_target_prices(spark, duck):
    """Predicted pairs are the unpriced ones; known prices and their discounts are kept."""
    got = contract.queries()["test_price_discount"](spark, FOLDER).toPandas()
    known = duck.execute(contract.oracle_sql()["known_price_discount"]).df()
    unpriced = duck.execute(contract.oracle_sql()["unpriced_pairs"]).df()
    prices = duck.execute(contract.oracle_sql()["priced_rows"]).df()["item_price"]

    keys = ["shop_id", "item_id"]
    predicted = got.merge(unpriced, on=keys)
    rest = got.merge(unpriced, on=keys, how="left", indicator=True).query("_merge=='left_only'")
    assert compare.difference(predicted[keys], unpriced) is None
    assert compare.difference(rest[got.columns], known) is None
    assert predicted["item_price"].between(prices.min(), prices.max()).all()
    assert (predicted["discount_rate"] == 0).all()
    assert predicted["item_price"].nunique() > 1
