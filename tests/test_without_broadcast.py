"""The same results when every join side is too large to broadcast."""

import pytest

import compare
from panelforge.plans import catalog

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "semi_filter",
    "anti_items",
    "monthly",
    "join_item_group",
    "shop_group_mean",
    "group_lag_mean",
    "trend_signal_pair",
    "train_price_discount",
    "known_price_discount",
    "items_with_group",
]


@pytest.mark.parametrize("name", NAMES)
def test_shuffle_joins_agree(spark, name):
    wanted = catalog.QUERIES[name](spark, FOLDER).toPandas()
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalog.QUERIES[name](spark, FOLDER)
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = df.toPandas()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    # Only the totals of ranges, one row per range, are still broadcast.
    broadcast = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert all(" [_slice#" in line for line in broadcast)
    assert compare.difference(got, wanted) is None
