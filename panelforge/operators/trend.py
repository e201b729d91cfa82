"""Exponential moving averages, MACD and its signal line.

The average with span ``s`` is the bias-adjusted one: with ``q = 1 - 2 / (s + 1)`` the
value at step t is ``sum(q^(t-j) x_j) / sum(q^(t-j))`` over j <= t. Along the months it is a
recurrence. Spark's array functions can only append to an array by copying it, so the
recurrences run in numpy inside ``mapInArrow``: a task unfolds the non-empty months of some
pairs, carries all averages, MACD and signal in one pass over the months for these pairs side
by side, and writes the dense rows, in time linear in them. Pairs are shuffled, months are not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.constants import EMA_SPANS, SIGNAL_SPAN
from panelforge.operators.ordering import dense_positions
from panelforge.operators.panel import BLOCK, PAIR, Panel, Targets
from panelforge.session import materialize, with_package

# Pairs per slice of the pair order.
MAX_SLICE = 1024
# Dense rows that are made at a time.
PIECE_ROWS = 500_000
# The place of what earlier slices add, before the first row of a slice.
CARRIED = -1
NAMES = ("ema_s", "ema_m", "ema_l", "macd", "sig")

Batches = Iterator[pa.RecordBatch]


def decay(span: float) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def _averages(values: np.ndarray, spans: Sequence[float]) -> np.ndarray:
    """Moving averages along the first axis: one matrix per span, in one pass."""
    q = np.array([decay(span) for span in spans])[:, None]
    out = np.empty((len(spans), *values.shape))
    top, bottom = np.zeros((len(spans), values.shape[1])), np.zeros((len(spans), 1))
    for t, now in enumerate(values):
        top = top * q + now
        bottom = bottom * q + 1.0
        out[:, t] = top / bottom
    return out


@dataclass(frozen=True)
class _Months:
    """How the non-empty months of a pair become an array of all months."""

    n_blocks: int
    bounds: tuple[float, float]

    def columns(self) -> list[Column]:
        """The non-empty months of a pair and their sales."""
        counts = F.transform(F.map_values("history"), lambda cell: cell["item_cnt"])
        return [F.map_keys("history").alias("_blocks"), counts.alias("_counts")]

    def pieces(self, batches: Batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Some rows of a batch with their sales before clipping, a row per pair."""
        size = max(1, PIECE_ROWS // self.n_blocks)
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                values = np.zeros((piece.num_rows, self.n_blocks))
                _scatter(values, piece.column("_blocks"), piece.column("_counts"))
                yield piece, values

    def clipped(self, values: np.ndarray) -> np.ndarray:
        return np.clip(values, *self.bounds)

    def rows(self, piece: pa.RecordBatch, found: dict[str, np.ndarray]) -> pa.RecordBatch:
        """Matrices by month and pair as rows; the value of month m is a feature of m + 1."""
        n = piece.num_rows
        at = pa.array(np.repeat(np.arange(n), self.n_blocks))
        arrays = [piece.column(name).take(at) for name in PAIR]
        arrays += [pa.array(np.ascontiguousarray(m.T).ravel()) for m in found.values()]
        arrays.append(pa.array(np.tile(np.arange(1, self.n_blocks + 1, dtype=np.int32), n)))
        return pa.RecordBatch.from_arrays(
            arrays, [*PAIR, *[f"cnt_{name}_prev" for name in found], BLOCK]
        )

    def schema(self, df: DataFrame, names: Sequence[str]) -> str:
        kinds = dict(df.dtypes)
        columns = [f"{name} {kinds[name]}" for name in PAIR]
        columns += [f"cnt_{name}_prev double" for name in names]
        return ", ".join([*columns, f"{BLOCK} int"])


def _scatter(values: np.ndarray, blocks: pa.Array, numbers: pa.Array) -> None:
    """Put each row's numbers at its months."""
    counts = np.diff(blocks.offsets.to_numpy())
    row = np.repeat(np.arange(len(counts)), counts)
    values[row, blocks.flatten().to_numpy()] = numbers.flatten().to_numpy()


def trend(
    panel: Panel, spans: Sequence[float] = EMA_SPANS, signal_span: float | None = SIGNAL_SPAN
) -> DataFrame:
    """Averages, MACD and, unless ``signal_span`` is None, its signal along the months."""
    months = _Months(panel.n_blocks, panel.bounds)
    names = NAMES if signal_span is not None else NAMES[:-1]

    def averaged(batches: Batches) -> Batches:
        for piece, values in months.pieces(batches):
            values = np.ascontiguousarray(months.clipped(values).T)
            short, middle, long = _averages(values, spans)
            found = [short, middle, long, short - long]
            if signal_span is not None:
                found += list(_averages(found[3], [signal_span]))
            yield months.rows(piece, dict(zip(names, found, strict=True)))

    with_package(panel.series.sparkSession)
    pairs = panel.series.select(*PAIR, *months.columns())
    return pairs.mapInArrow(averaged, months.schema(pairs, names))


@dataclass(frozen=True)
class PairOrder:
    """Ranks of the target shops and items, for the rank of a pair by (shop, item).

    The pairs are a full product, so that rank is ``shop rank * items + item rank``; only
    the two key lists are ordered.
    """

    shops: DataFrame
    items: DataFrame
    n_items: int

    @classmethod
    def of(cls, targets: Targets, **limits: int) -> PairOrder:
        """Both key lists are ranked in one pass, the items after the shops."""
        shops, items = (
            keys.select(F.lit(k).alias("_list"), F.col(name).alias("_id"))
            for k, (name, keys) in enumerate(zip(PAIR, (targets.shops, targets.items), strict=True))
        )
        ranks = dense_positions(shops.unionByName(items), ["_list", "_id"], "_rank", **limits)
        ranks = materialize(ranks, "ranks")

        def ranked(k: int, keys: DataFrame, pos: Column, out: str) -> DataFrame:
            (name, kind), *_ = keys.dtypes
            own = ranks.where(F.col("_list") == k)
            return own.select(F.col("_id").cast(kind).alias(name), pos.alias(out))

        item_pos = F.col("_rank") - F.lit(targets.n_shops)
        return cls(
            ranked(0, targets.shops, F.col("_rank"), "_shop_pos"),
            ranked(1, targets.items, item_pos, "_item_pos"),
            targets.n_items,
        )

    def place(self, df: DataFrame, length: int) -> DataFrame:
        """Add a row's rank, its slice of ``length`` ranks and its place in the slice."""
        pos = F.col("_shop_pos") * F.lit(self.n_items).cast("long") + F.col("_item_pos")
        return (
            df.join(self.items, "item_id")
            .join(self.shops, "shop_id")
            .withColumn("_pos", pos)
            .withColumn("_slice", F.floor(F.col("_pos") / F.lit(length)))
            .withColumn("_off", F.col("_pos") % F.lit(length))
            .drop("_shop_pos", "_item_pos")
        )


def decayed_totals(totals: DataFrame, decay_per_slice: float, n_slices: int) -> DataFrame:
    """Per slice and month: its ``_total`` and those before, each decayed by its distance.

    A scan in steps of doubling distance: after step k a slice holds what comes from the
    2^k slices up to it, and sends that on 2^k slices further, weighted by the decay over
    that distance. So a slice's total is copied once per step however far it reaches, and
    the steps end with the slices or where the weight is zero in double precision.
    """
    distance = 1
    while distance < n_slices and decay_per_slice**distance > 0.0:
        sent = F.array(
            F.struct(F.lit(0).cast("long").alias("ahead"), F.col("_total").alias("total")),
            F.struct(
                F.lit(distance).cast("long").alias("ahead"),
                (F.col("_total") * F.lit(decay_per_slice**distance)).alias("total"),
            ),
        )
        totals = (
            totals.select("_slice", BLOCK, F.explode(sent).alias("_sent"))
            .groupBy((F.col("_slice") + F.col("_sent.ahead")).alias("_slice"), BLOCK)
            .agg(F.sum("_sent.total").alias("_total"))
            .where(F.col("_slice") < n_slices)
        )
        distance *= 2
    return totals


def _carried(placed_cells: DataFrame, q: float, length: int, n_slices: int) -> DataFrame:
    """Per slice: the months and decayed sums of everything in earlier slices, placed before
    its first row. Only non-empty cells add to a total.
    """
    to_end = F.pow(F.lit(q), F.lit(length - 1) - F.col("_off"))
    totals = placed_cells.groupBy("_slice", BLOCK).agg(
        F.sum(F.col("item_cnt") * to_end).alias("_total")
    )
    sums = decayed_totals(totals, q**length, n_slices - 1)
    months = F.sort_array(F.collect_list(F.struct(BLOCK, "_total")))
    return (
        sums.groupBy((F.col("_slice") + 1).alias("_slice"))
        .agg(months.alias("_months"))
        .select(
            "_slice",
            F.lit(CARRIED).cast("long").alias("_off"),
            F.col(f"_months.{BLOCK}").alias("_blocks"),
            F.col("_months._total").alias("_counts"),
        )
    )


def trend_pair_signal(
    panel: Panel,
    targets: Targets,
    spans: Sequence[float] = EMA_SPANS,
    signal_span: float = SIGNAL_SPAN,
    max_slice: int = MAX_SLICE,
    **limits: int,
) -> DataFrame:
    """As ``trend``, but the signal of a month runs down the pairs in (shop, item) order.

    Averaging down the pairs and averaging along the months are both linear, so they may
    change places: sales are averaged down the pairs first, and the signal is the MACD of
    that. The pair order is cut into slices of equal length; one task holds a slice, and
    what earlier slices add comes from their totals. Down the pairs all months are summed
    side by side on one row per pair; the dense months unfold after the last shuffle.
    """
    q = decay(signal_span)
    order = PairOrder.of(targets, **limits)
    n_slices = math.ceil(targets.n_shops * targets.n_items / max_slice)
    carried = _carried(order.place(panel.clipped_cells(), max_slice), q, max_slice, n_slices)
    months = _Months(panel.n_blocks, panel.bounds)
    short, _, long = spans

    def down(batches: Batches) -> Batches:
        state, start = np.zeros(months.n_blocks), None
        for piece, values in months.pieces(batches):
            place = piece.column("_off").to_numpy()
            pairs = np.flatnonzero(place != CARRIED)
            sums, clipped = np.empty_like(values), months.clipped(values)
            for row, off in enumerate(place.tolist()):
                if off == CARRIED:
                    start = values[row]
                    continue
                if off == 0:
                    state = np.zeros(months.n_blocks) if start is None else start
                    start = None
                sums[row] = state = state * q + clipped[row]
            piece, sums, clipped = piece.take(pa.array(pairs)), sums[pairs], clipped[pairs]
            rank = piece.column("_pos").to_numpy().astype(float)
            weights = -np.expm1((rank + 1) * math.log(q)) / (1.0 - q) if q else np.ones(len(rank))
            averages = _averages(np.ascontiguousarray(clipped.T), spans)
            signal = _averages(np.ascontiguousarray((sums / weights[:, None]).T), [short, long])
            found = [*averages, averages[0] - averages[2], signal[0] - signal[1]]
            yield months.rows(piece, dict(zip(NAMES, found, strict=True)))

    with_package(panel.series.sparkSession)
    placed = order.place(panel.series.select(*PAIR, *months.columns()), max_slice)
    sliced = (
        placed.unionByName(carried, allowMissingColumns=True)
        .repartition(targets.tasks(panel.n_blocks), "_slice")
        .sortWithinPartitions("_slice", "_off")
        .select(*PAIR, "_off", "_pos", "_blocks", "_counts")
    )
    return sliced.mapInArrow(down, months.schema(sliced, NAMES))
