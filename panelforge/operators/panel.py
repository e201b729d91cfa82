"""The dense panel, held as one row per (shop, item) with a map of its non-empty months.

Most cells of a dense panel are empty. Sales are aggregated to the cells that have any,
these are gathered per pair (at most one entry per month) and joined to the pairs once.
Dense rows are made from the map where they are needed, after the last shuffle, so the
months x shops x items rows are never shuffled, and only sorted where a result needs it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.constants import CLIP, DEDUP_KEYS, N_BLOCKS
from panelforge.functions.columns import clip
from panelforge.operators.clean import drop_repeats, keep_known_long
from panelforge.session import materialize

BLOCK = "date_block_num"
PAIR = ["shop_id", "item_id"]
COUNTS = ("item_cnt", "item_order")
PRICES = ("item_price",)
# Dense rows that one task makes, where they are more than the session's partitions make.
ROWS_PER_TASK = 2_000_000
# Pieces of a product per task, so that tasks come out about equal.
PIECES_PER_TASK = 64


def _measure(name: str) -> Column:
    """Aggregates of one cell's sales rows; a missing count is a sale of 0."""
    return {
        "item_cnt": F.coalesce(F.sum("item_cnt_day"), F.lit(0.0)),
        "item_order": F.count(F.lit(1)),
        "item_price": F.avg("item_price"),
    }[name].alias(name)


@dataclass(frozen=True)
class Targets:
    """What to forecast: the pairs, and the distinct shops and items among them.

    The key lists are written out when first used, so the planner knows how large each is.
    Its choice between broadcast and shuffle joins then rests on true sizes.
    """

    pairs: DataFrame

    @cached_property
    def shops(self) -> DataFrame:
        return materialize(self.pairs.select("shop_id").distinct(), "shops")

    @cached_property
    def items(self) -> DataFrame:
        return materialize(self.pairs.select("item_id").distinct(), "items")

    @cached_property
    def n_items(self) -> int:
        return self.items.count()

    @cached_property
    def n_shops(self) -> int:
        return self.shops.count()

    def n_cells(self, n_blocks: int) -> int:
        return n_blocks * self.n_shops * self.n_items

    def tasks(self, n_blocks: int) -> int:
        """Tasks for the dense rows of so many months."""
        partitions = int(self.pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return max(partitions, math.ceil(self.n_cells(n_blocks) / ROWS_PER_TASK))


def load_targets(pairs: DataFrame) -> Targets:
    """The pairs, written out because both key lists are made from them."""
    return Targets(materialize(pairs, "targets"))


def target_sales(sales: DataFrame, targets: Targets) -> DataFrame:
    """Sales of target shops and target items.

    Short key lists are broadcast. With long ones a filter made from both lists runs at the
    scan, and Spark can split the sales of a popular item in the exact join.
    """
    kept = keep_known_long(sales, targets.items, "item_id", targets.n_items)
    return keep_known_long(kept, targets.shops, "shop_id", targets.n_shops)


def monthly_cells(
    sales: DataFrame,
    targets: Targets,
    n_blocks: int = N_BLOCKS,
    measures: Sequence[str] = COUNTS + PRICES,
) -> DataFrame:
    """Non-empty cells of the panel: de-duplicated sales per month, shop and item.

    The filters on month, shop and item come first, so the shuffle by all five keys moves
    only rows that stay.
    """
    wanted = target_sales(sales.where(F.col(BLOCK).between(0, n_blocks - 1)), targets)
    return (
        drop_repeats(wanted, DEDUP_KEYS)
        .groupBy(BLOCK, *PAIR)
        .agg(*[_measure(name) for name in measures])
    )


@dataclass(frozen=True)
class Deal:
    """How a product of two tables is dealt into ``tasks``.

    Both sides are cut into chunks by hash, and each pair of chunks is one value of a key.
    """

    left_chunks: int
    right_chunks: int
    tasks: int

    @classmethod
    def of(cls, n_left: int, n_right: int, tasks: int) -> Deal:
        """``n_left`` and ``n_right`` are the rows of the sides or bounds on them."""
        keys = tasks * PIECES_PER_TASK
        n_left, n_right = max(1, n_left), max(1, n_right)
        right = max(1, min(n_right, round(math.sqrt(keys * n_right / n_left))))
        return cls(max(1, min(n_left, math.ceil(keys / right))), right, tasks)

    def key(self, left: Column, right: Column) -> Column:
        """The key of a row from the hashes of its two sides."""
        left_chunk = F.pmod(left, F.lit(self.left_chunks))
        return left_chunk * F.lit(self.right_chunks) + F.pmod(right, F.lit(self.right_chunks))

    def product(self, left: DataFrame, right: DataFrame, left_hash: Column, right_hash: Column):
        """Every row of ``left`` with every row of ``right``, and their ``_key``.

        Rows are repeated once per chunk of the other side, far less often than the product
        has rows. A hint keeps Spark from broadcasting a side whose repeats its size estimate
        does not count.
        """

        def upto(n: int) -> Column:
            return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

        def dealt(df: DataFrame, key: Column) -> DataFrame:
            return df.withColumn("_key", key).drop("_other").repartition(self.tasks, "_key")

        own = self.key(left_hash, F.col("_other"))
        lefts = dealt(left.withColumn("_other", upto(self.right_chunks)), own)
        own = self.key(F.col("_other"), right_hash)
        rights = dealt(right.withColumn("_other", upto(self.left_chunks)), own)
        return lefts.join(rights.hint("merge"), "_key")


def product(
    left: DataFrame, right: DataFrame, n_left: int, n_right: int, tasks: int
) -> DataFrame:
    """Every row of ``left`` with every row of ``right``, in ``tasks`` partitions."""
    deal = Deal.of(n_left, n_right, tasks)
    hashes = (F.xxhash64(*df.columns) for df in (left, right))
    return deal.product(left, right, *hashes).drop("_key")


def _key_hash(name: str) -> Column:
    """The same for a key in any integer type."""
    return F.xxhash64(F.col(name).cast("long"))


def _deal(targets: Targets, n_blocks: int) -> Deal:
    return Deal.of(targets.n_items, targets.n_shops, targets.tasks(n_blocks))


def _dealt_pairs(targets: Targets, n_blocks: int) -> DataFrame:
    """All target shops with all target items, also where targets lack the pair."""
    hashes = (_key_hash(name) for name in ("item_id", "shop_id"))
    return _deal(targets, n_blocks).product(targets.items, targets.shops, *hashes)


def target_pairs(targets: Targets, n_blocks: int = 1) -> DataFrame:
    """All target shops with all target items.

    The partitions are meant for ``n_blocks`` dense rows per pair.
    """
    return _dealt_pairs(targets, n_blocks).select(*PAIR)


def with_blocks(df: DataFrame, first: int, last: int) -> DataFrame:
    """Each row once per month from ``first`` to ``last``."""
    return df.withColumn(BLOCK, F.explode(F.sequence(F.lit(first), F.lit(last))))


def dense_grid(targets: Targets, n_blocks: int = N_BLOCKS) -> DataFrame:
    """Keys of the dense panel."""
    pairs = target_pairs(targets, n_blocks)
    return with_blocks(pairs, 0, n_blocks - 1).select(BLOCK, *PAIR)


@dataclass(frozen=True)
class Panel:
    """``cells``: non-empty cells. ``series``: one row per pair, ``history`` its cells by month."""

    cells: DataFrame
    series: DataFrame
    n_blocks: int
    bounds: tuple[float, float] = CLIP

    def by_month(self) -> Column:
        """The cells of all months as one array, NULL where a cell is empty.

        The non-empty cells in order, each after as many NULLs as months lie between: one
        step per month, not one search per month.
        """
        cell = self.series.schema["history"].dataType.valueType.simpleString()
        found = F.array_sort(F.map_entries("history"))

        def gap(first: Column, last: Column) -> Column:
            return F.array_repeat(F.lit(None).cast(cell), last - first)

        def filled(entry: Column, i: Column, entries: Column) -> Column:
            first = F.when(i > 0, F.get(entries, i - 1)["key"] + 1).otherwise(0)
            return F.concat(gap(first, entry["key"]), F.array(entry["value"]))

        def whole(entries: Column) -> Column:
            runs = F.transform(entries, lambda entry, i: filled(entry, i, entries))
            last = F.coalesce(F.get(entries, F.size(entries) - 1)["key"] + 1, F.lit(0))
            return F.concat(F.flatten(runs), gap(last, F.lit(self.n_blocks)))

        # An array of the entries alone lets them be named once.
        return F.flatten(F.transform(F.array(found), whole))

    def rows(self, first: int, last: int, *extra: str) -> DataFrame:
        """Each pair once per month, for ``count``, ``order`` and ``price`` of any month."""
        pairs = self.series.select(*PAIR, *extra, self.by_month().alias("_cells"))
        return with_blocks(pairs, first, last)

    def count(self, block: Column) -> Column:
        """Sales of a month, 0 where there are none, clipped."""
        return self._clipped(F.get("_cells", block))

    def _clipped(self, cell: Column) -> Column:
        return clip(F.coalesce(cell["item_cnt"], F.lit(0.0)), self.bounds)

    def months(self) -> Column:
        """Clipped sales of all months as one array."""
        return F.transform(self.by_month(), self._clipped)

    def order(self, block: Column) -> Column:
        """Sales rows of a month; an empty cell counts as one row of zero sales."""
        return F.coalesce(F.get("_cells", block)["item_order"], F.lit(1).cast("long"))

    def price(self, block: Column) -> Column:
        return F.get("_cells", block)["item_price"]

    def clipped_cells(self) -> DataFrame:
        return self.cells.withColumn("item_cnt", clip(F.col("item_cnt"), self.bounds))


def build_panel(
    sales: DataFrame,
    targets: Targets,
    n_blocks: int = N_BLOCKS,
    measures: Sequence[str] = COUNTS + PRICES,
    bounds: tuple[float, float] = CLIP,
    store: bool = False,
) -> Panel:
    """The panel of ``sales`` on the target shops and items.

    The cells are dealt by the key that deals the product of shops and items. So pairs and
    cells are grouped where the pairs are made, and no pair is shuffled. With ``store`` cells
    and series are written out, the series from the written cells: for several outputs that
    together read the sales once.
    """
    cells = monthly_cells(sales, targets, n_blocks, measures)
    if store:
        cells = materialize(cells, "cells")
    deal = _deal(targets, n_blocks)
    keyed = cells.withColumn("_key", deal.key(_key_hash("item_id"), _key_hash("shop_id")))
    # A number of partitions that is set here is not merged for the small rows of cells.
    dealt = keyed.repartition(deal.tasks, "_key")
    entry = F.struct(F.col(BLOCK), F.struct(*measures))
    both = dealt.select("_key", *PAIR, entry.alias("_entry")).unionByName(
        _dealt_pairs(targets, n_blocks), allowMissingColumns=True
    )
    series = both.groupBy("_key", *PAIR).agg(
        F.map_from_entries(F.collect_list("_entry")).alias("history")
    )
    series = series.select(*PAIR, "history")
    if store:
        series = materialize(series, "series")
    return Panel(cells, series, n_blocks, bounds)


def monthly(panel: Panel) -> DataFrame:
    """Dense month x shop x item totals, sales clipped, row counts at least 1."""
    block = F.col(BLOCK)
    return panel.rows(0, panel.n_blocks - 1).select(
        BLOCK,
        *PAIR,
        panel.count(block).alias("item_cnt"),
        panel.order(block).alias("item_order"),
    )


def mean_price(panel: Panel) -> DataFrame:
    """Dense mean price, NULL where nothing was sold."""
    return panel.rows(0, panel.n_blocks - 1).select(
        BLOCK, *PAIR, panel.price(F.col(BLOCK)).alias("item_price")
    )


def monthly_with_items(panel: Panel, items: DataFrame) -> DataFrame:
    """Monthly totals with the columns of ``items``, joined per pair and not per month."""
    looked_up = panel.series.join(items, "item_id", "left")
    extra = [name for name in items.columns if name != "item_id"]
    block = F.col(BLOCK)
    return replace(panel, series=looked_up).rows(0, panel.n_blocks - 1, *extra).select(
        BLOCK,
        *PAIR,
        panel.count(block).alias("item_cnt"),
        panel.order(block).alias("item_order"),
        *extra,
    )


def grid_check(targets: Targets, n_blocks: int = N_BLOCKS) -> DataFrame:
    """Rows of the dense grid and the product of its three key counts."""
    rows = dense_grid(targets, n_blocks).agg(F.count(F.lit(1)).alias("grid_rows"))
    return rows.withColumn("expected_rows", F.lit(targets.n_cells(n_blocks)).cast("long"))
