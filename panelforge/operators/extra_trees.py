"""Extremely randomized regression trees on distributed rows.

Every tree sees all rows. At a node one threshold per feature is drawn evenly between the
least and the largest value of the feature there, and the feature whose threshold lowers the
squared error most splits the node. The prediction is the mean of the trees' leaves.

All trees grow together. While a node has more than ``local_rows`` rows, a level takes two
passes over the rows, which are routed through the splits known so far: one for the ranges of
the features, one for the sums left of the thresholds; per partition and node one row is
shuffled. What is below a smaller node fits into memory and grows in one task. Thresholds come
from a hash of seed, tree, node and feature, and targets are summed as whole numbers, so the
trees depend neither on how rows are split over tasks nor on ``local_rows``. The driver holds
the trees, at most ``trees * 2 ** (depth + 1)`` nodes, and never rows. Tasks get the nodes found
so far, 9 bytes each, and thresholds only of the nodes that a pass is about.

Defined results: rows with a null feature or target are left out of fitting; a row with a null
feature gets a null prediction; without rows to fit all predictions are null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from panelforge.session import with_package

# Rows of a node that grows in one task.
LOCAL_ROWS = 100_000
# Targets are whole multiples of 10 ** -DIGITS; their sums are kept in two parts, so that
# neither leaves 64 bits.
DIGITS, LOW_BITS = 6, 30
# Pieces of so many rows are routed at a time.
PIECE_ROWS = 65_536
LEAF = -1
_ALL = (1 << 64) - 1

Batches = Iterator[pa.RecordBatch]


@dataclass
class Rows:
    """Features by row, and of the targets merged into it: sums, number and range."""

    x: np.ndarray
    high: np.ndarray
    low: np.ndarray
    weight: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def take(self, at: np.ndarray) -> Rows:
        return Rows(*[getattr(self, name)[at] for name in self.__dataclass_fields__])


@dataclass
class Routes:
    """The known nodes of every tree in heap order, without gaps and from the root on: the
    children of the k-th node that is split, from 0, are the nodes 2k + 1 and 2k + 2.

    ``number`` is the threshold of a node that is split, and what ends there of another.
    """

    split: list[np.ndarray]
    number: list[np.ndarray]

    @property
    def trees(self) -> int:
        return len(self.split)

    def ends(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The number of the deepest known node of every row."""
        split, number = self.split[tree], self.number[tree]
        left = 2 * np.cumsum(split != LEAF) - 1
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            rows = rows[split[node[rows]] != LEAF]
            if not len(rows):
                return number[node]
            at = node[rows]
            node[rows] = left[at] + (x[rows, split[at]] > number[at])


@dataclass
class Forest:
    """Nodes by tree in heap order: the children of node k are 2k and 2k + 1, the root is 1."""

    features: Sequence[str]
    depth: int
    seed: int
    split: np.ndarray = field(repr=False)
    threshold: np.ndarray = field(repr=False)
    value: np.ndarray = field(repr=False)
    trained: bool = False

    @classmethod
    def empty(cls, features: Sequence[str], trees: int, depth: int, seed: int) -> Forest:
        shape = (trees, 2 << depth)
        return cls(
            list(features), depth, seed,
            np.full(shape, LEAF, np.int8), np.zeros(shape), np.zeros(shape),
        )

    @property
    def trees(self) -> int:
        return len(self.split)

    def set_nodes(self, tree, node, split, threshold, value) -> None:
        self.split[tree, node] = split
        self.threshold[tree, node] = threshold
        self.value[tree, node] = value

    def routes(self, ends: np.ndarray) -> Routes:
        """What tasks need to route rows; ``ends`` is what they want to know, by tree and node."""
        routes = Routes([], [])
        for split, threshold, end in zip(self.split, self.threshold, ends, strict=True):
            inner = np.flatnonzero(split != LEAF)
            node = np.append(1, (2 * inner[:, None] + [0, 1]).ravel())
            routes.split.append(split[node])
            routes.number.append(np.where(split[node] != LEAF, threshold[node], end[node]))
        return routes

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with the prediction of every row."""
        if not self.trained:
            return df.withColumn(out, F.lit(None).cast("double"))
        # Read from a file by each worker; as a part of the function it would lie there twice.
        routes = df.sparkSession.sparkContext.broadcast(self.routes(self.value))
        predict = F.pandas_udf(lambda *columns: _predicted(routes.value, columns), DoubleType())
        complete = F.lit(True)
        for name in self.features:
            complete = complete & F.col(name).isNotNull()
        inputs = [F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name in self.features]
        return df.withColumn(out, F.when(complete, predict(*inputs)))


def _predicted(routes: Routes, columns):
    import pandas as pd

    x = np.column_stack([c.to_numpy(float) for c in columns])
    total = np.zeros(len(x))
    for tree in range(routes.trees):
        total += routes.ends(tree, x)
    return pd.Series(total / routes.trees)


def _uniform(seed: int, tree: np.ndarray, node: np.ndarray, features: int) -> np.ndarray:
    """Numbers from 0 to 1 by tree, node and feature: a hash of all (splitmix64)."""
    key = (np.asarray(tree, np.uint64) << np.uint64(32)) + np.asarray(node, np.uint64)
    key = key[:, None] * np.uint64(features) + np.arange(features, dtype=np.uint64)
    key = (key + np.uint64(seed * 0x632BE59BD9B4E019 & _ALL)) * np.uint64(0x9E3779B97F4A7C15)
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    key ^= key >> np.uint64(31)
    return (key >> np.uint64(11)).astype(float) * 2.0**-53


def _thresholds(seed: int, tree, node, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """By node and feature; below the largest value, so that both sides get rows."""
    drawn = least + _uniform(seed, tree, node, least.shape[1]) * (most - least)
    return np.where(drawn < most, drawn, least)


def _total(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(float) * 2.0**LOW_BITS + low.astype(float)


def _orders(seed: int, tree, node, features: int) -> np.ndarray:
    """The order by node in which features are looked at: of equally good ones the first wins."""
    return np.argsort(_uniform(~seed, tree, node, features), axis=1)


def _best(orders, usable, left_weight, left_sum, weight, total) -> np.ndarray:
    """The feature by node that lowers the squared error most."""
    right_weight, right_sum = weight[:, None] - left_weight, total[:, None] - left_sum
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_sum**2 / left_weight + right_sum**2 / right_weight
    gain = np.take_along_axis(np.where(usable, gain, -np.inf), orders, axis=1)
    best = np.take_along_axis(orders, gain.argmax(axis=1)[:, None], axis=1)[:, 0]
    return np.where(usable.any(axis=1), best, LEAF)


def _sums(rows: Rows, starts: np.ndarray) -> tuple:
    """Per stretch of rows: ranges of the features, sums, number and range of the targets."""
    return (
        np.minimum.reduceat(rows.x, starts),
        np.maximum.reduceat(rows.x, starts),
        *[np.add.reduceat(a, starts) for a in (rows.high, rows.low, rows.weight)],
        np.minimum.reduceat(rows.least, starts),
        np.maximum.reduceat(rows.most, starts),
    )


def _left_sums(rows: Rows, starts: np.ndarray, thresholds: np.ndarray) -> tuple:
    """Per stretch and feature: sums, number and rows on the left."""
    counts = np.diff(np.append(starts, len(rows.x)))
    left = rows.x <= np.repeat(thresholds, counts, axis=0)
    parts = (rows.high, rows.low, rows.weight, np.ones(len(rows.x), np.int64))
    return tuple(np.add.reduceat(np.where(left, a[:, None], 0), starts) for a in parts)


def _open(depth: int, node, least, most, target_least, target_most) -> np.ndarray:
    """Which nodes are split by which features: not those with equal targets or rows."""
    splits = (target_least < target_most) & (node < 1 << depth)
    return (least < most) & splits[:, None]


def _sorted(rows: Rows, node: np.ndarray) -> tuple[Rows, np.ndarray, np.ndarray]:
    order = np.argsort(node, kind="stable")
    node = node[order]
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    return rows.take(order), node, starts


def grow(tree: int, root: int, rows: Rows, depth: int, seed: int) -> tuple[np.ndarray, ...]:
    """All nodes below and at ``root``: numbers, splits, thresholds, values. One level a step."""
    node, found = np.full(len(rows.x), root, np.int64), []
    while len(node):
        rows, node, starts = _sorted(rows, node)
        ids = node[starts]
        least, most, high, low, weight, target_least, target_most = _sums(rows, starts)
        usable = _open(depth, ids, least, most, target_least, target_most)
        trees = np.full(len(ids), tree)
        cut = _thresholds(seed, trees, ids, least, most)
        left_high, left_low, left_weight, _ = _left_sums(rows, starts, cut)
        total = _total(high, low)
        orders = _orders(seed, trees, ids, cut.shape[1])
        left_total = _total(left_high, left_low)
        split = _best(orders, usable, left_weight, left_total, weight, total)
        chosen = cut[np.arange(len(ids)), split]
        found.append((ids, split, chosen, total / weight / 10**DIGITS))
        counts = np.diff(np.append(starts, len(node)))
        own, at = np.repeat(split, counts), np.repeat(chosen, counts)
        goes_on = np.flatnonzero(own != LEAF)
        rows, own, at = rows.take(goes_on), own[goes_on], at[goes_on]
        node = 2 * node[goes_on] + (rows.x[np.arange(len(own)), own] > at)
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def training_rows(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rows with equal features merged; targets as sums of whole numbers, best written out."""
    whole = F.round(F.col(target) * F.lit(10.0**DIGITS)).cast("long")
    complete = F.col(target).isNotNull()
    for name in features:
        complete = complete & F.col(name).isNotNull()
    inputs = [F.col(name).cast("double").alias(f"x{i}") for i, name in enumerate(features)]
    return (
        df.where(complete)
        .select(*inputs, whole.alias("target"))
        .groupBy(*[f"x{i}" for i in range(len(features))])
        .agg(
            F.sum(F.shiftright("target", LOW_BITS)).alias("high"),
            F.sum(F.col("target").bitwiseAND(F.lit((1 << LOW_BITS) - 1))).alias("low"),
            F.count(F.lit(1)).alias("weight"),
            F.min("target").alias("least"),
            F.max("target").alias("most"),
        )
    )


def _rows_of(batch: pa.RecordBatch, features: int) -> Rows:
    x = np.column_stack([batch.column(f"x{i}").to_numpy() for i in range(features)])
    names = ("high", "low", "weight", "least", "most")
    return Rows(x, *[batch.column(name).to_numpy() for name in names])


def _pieces(batches: Batches, features: int) -> Iterator[Rows]:
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            yield _rows_of(batch.slice(at, PIECE_ROWS), features)


def _numbered(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tree and node of the marked nodes, and their numbers by tree and node; others have -1."""
    tree, node = np.nonzero(marked)
    number = np.full(marked.shape, -1, np.int32)
    number[tree, node] = np.arange(len(tree))
    return tree, node, number


def _partials(rows: DataFrame, routes: Routes, n: int, cut: np.ndarray | None):
    """Sums per wanted node: of all rows, or left of the thresholds ``cut``.

    The ways of ``routes`` end with the number of a wanted node or a negative one; ``n`` features.
    Every piece of a partition gives one row per node.
    """
    if cut is None:
        numbers = ["high", "low", "weight"]
        ranges = [f"{side}{i}" for side in ("least", "most") for i in range(n)]
        ranges += ["target_least", "target_most"]
    else:
        numbers = [f"{name}{i}" for name in ("high", "low", "weight", "rows") for i in range(n)]
        ranges = []
    names = ["wanted", *numbers, *ranges]

    def sums(batches: Batches) -> Batches:
        for piece in _pieces(batches, n):
            for tree in range(routes.trees):
                wanted = routes.ends(tree, piece.x).astype(np.int64)
                own = np.flatnonzero(wanted >= 0)
                if not len(own):
                    continue
                rows, wanted, starts = _sorted(piece.take(own), wanted[own])
                ids = wanted[starts]
                if cut is None:
                    least, most, high, low, weight, *targets = _sums(rows, starts)
                    columns = [high, low, weight, *least.T, *most.T, *targets]
                else:
                    found = _left_sums(rows, starts, cut[ids])
                    columns = [column for part in found for column in part.T]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(a)) for a in (ids, *columns)], names
                )

    kinds = {name: "double" if name.startswith(("least", "most")) else "long" for name in names}
    schema = ", ".join(f"{name} {kind}" for name, kind in kinds.items())
    fold = [F.sum(c).alias(c) for c in numbers]
    fold += [(F.min if "least" in c else F.max)(c).alias(c) for c in ranges]
    made = rows.mapInArrow(sums, schema).groupBy("wanted").agg(*fold)
    found = made.toArrow().sort_by("wanted")

    def matrix(*prefixes: str) -> list[np.ndarray]:
        return [
            np.column_stack([found.column(f"{p}{i}").to_numpy() for i in range(n)]) for p in prefixes
        ]

    ids = found.column("wanted").to_numpy()
    if cut is not None:
        return ids, *matrix("high", "low", "weight", "rows")
    rest = [found.column(c).to_numpy() for c in (*numbers, "target_least", "target_most")]
    return ids, *matrix("least", "most"), *rest


def _grow_large(rows: DataFrame, forest: Forest, n_rows: int, local_rows: int) -> np.ndarray:
    """Split nodes with many rows, level by level; marks the nodes that are left to grow."""
    shape = forest.split.shape
    small = np.zeros(shape, bool)
    small[:, 1] = n_rows <= local_rows
    large = np.zeros(shape, bool)
    large[:, 1] = n_rows > local_rows
    size = np.zeros(shape, np.int64)
    size[:, 1] = n_rows
    while large.any():
        tree, node, number = _numbered(large)
        routes, n = forest.routes(number), len(forest.features)
        cut = np.zeros((len(node), n))
        ids, least, most, high, low, weight, target_least, target_most = _partials(
            rows, routes, n, None
        )
        tree, node = tree[ids], node[ids]
        cut[ids] = drawn = _thresholds(forest.seed, tree, node, least, most)
        usable = _open(forest.depth, node, least, most, target_least, target_most)
        left = _partials(rows, routes, n, cut)[1:]
        total = _total(high, low)
        orders = _orders(forest.seed, tree, node, n)
        split = _best(orders, usable, left[2], _total(left[0], left[1]), weight, total)
        chosen = drawn[np.arange(len(node)), split]
        forest.set_nodes(tree, node, split, chosen, total / weight / 10**DIGITS)
        large[:] = False
        divided = split != LEAF
        tree, node, count = tree[divided], node[divided], left[3][divided, split[divided]]
        for child, number in ((2 * node, count), (2 * node + 1, size[tree, node] - count)):
            size[tree, child] = number
            large[tree, child] = number > local_rows
            small[tree, child] = number <= local_rows
    return small


def _grow_small(rows: DataFrame, forest: Forest, small: np.ndarray) -> None:
    """Grow what is below the marked nodes, one task each, into the forest."""
    n, depth, seed = len(forest.features), forest.depth, forest.seed
    columns = [*[f"x{i}" for i in range(n)], "high", "low", "weight", "least", "most"]
    trees, roots, number = _numbered(small)
    routes = forest.routes(number)

    def deal(batches: Batches) -> Batches:
        for batch in batches:
            x = _rows_of(batch, n).x
            for tree in range(routes.trees):
                at = routes.ends(tree, x).astype(np.int64)
                own = np.flatnonzero(at >= 0)
                kept = batch.select(columns).take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(trees[at[own]]), pa.array(roots[at[own]]), *kept.columns],
                    ["tree", "root", *columns],
                )

    def below(table: pa.Table) -> pa.Table:
        own = _rows_of(table.combine_chunks(), n)
        tree, root = table.column("tree")[0].as_py(), table.column("root")[0].as_py()
        node, split, threshold, value = grow(tree, root, own, depth, seed)
        return pa.table(
            {
                "tree": np.full(len(node), tree),
                "node": node,
                "split": split.astype(np.int64),
                "threshold": threshold,
                "value": value,
            }
        )

    features = ", ".join(f"x{i} double" for i in range(n))
    numbers = "high long, low long, weight long, least long, most long"
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*columns).mapInArrow(deal, f"tree long, root long, {features}, {numbers}")
    grown = (
        dealt.repartition(max(partitions, forest.trees), "tree", "root")
        .groupBy("tree", "root")
        .applyInArrow(below, "tree long, node long, split long, threshold double, value double")
    )
    found = grown.toArrow()
    forest.set_nodes(*[found.column(name).to_numpy() for name in found.column_names])


def fit(
    rows: DataFrame,
    features: Sequence[str],
    trees: int,
    depth: int,
    seed: int,
    local_rows: int = LOCAL_ROWS,
) -> Forest:
    """Trees of ``training_rows``, which are read several times."""
    forest = Forest.empty(features, trees, depth, seed)
    with_package(rows.sparkSession)
    n_rows = rows.count()
    if n_rows:
        small = _grow_large(rows, forest, n_rows, local_rows)
        if small.any():
            _grow_small(rows, forest, small)
        forest.trained = True
    return forest
