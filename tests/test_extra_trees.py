"""Randomized trees against a plain recursion over all rows."""

import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from panelforge.operators import extra_trees
from small import sent_to_tasks

FEATURES = ["a", "b", "c"]
SCHEMA = "a double, b long, c int, y double, x0 int, weight int"


def made_rows(n=400, seed=3):
    draw = random.Random(seed)
    rows = [
        (draw.choice([0.5, 1.5, 2.25, 7.0]), draw.randrange(40), draw.randrange(3)) for _ in range(n)
    ]
    rows += rows[: n // 4]
    return [(*x, round(10 * x[0] - x[1] + draw.choice([0, 5.25]) * x[2], 2), 1, 2) for x in rows]


def plain_tree(rows, tree, depth, seed):
    """{node: (feature, threshold, value)} by recursion, sums as fractions."""
    out = {}

    def split(node, own):
        targets = [Fraction(round(y * 10**6), 10**6) for _, y in own]
        value = sum(targets) / len(own)
        out[node] = (extra_trees.LEAF, None, value)
        if node >= 1 << depth or min(targets) == max(targets):
            return
        columns = list(zip(*(x for x, _ in own), strict=True))
        least, most = ([[float(f(c)) for c in columns]] for f in (min, max))
        cut = extra_trees._thresholds(seed, [tree], [node], np.array(least), np.array(most))[0]
        best = None
        for k in extra_trees._orders(seed, [tree], [node], len(columns))[0].tolist():
            column = columns[k]
            if min(column) == max(column):
                continue
            left = [t for v, t in zip(column, targets, strict=True) if v <= cut[k]]
            right = [t for v, t in zip(column, targets, strict=True) if v > cut[k]]
            gain = sum(left) ** 2 / len(left) + sum(right) ** 2 / len(right)
            if best is None or float(gain) > best[0] * (1 + 1e-12):
                best = (float(gain), k, cut[k])
        if best:
            out[node] = (best[1], best[2], value)
            split(2 * node, [r for r in own if r[0][best[1]] <= best[2]])
            split(2 * node + 1, [r for r in own if r[0][best[1]] > best[2]])

    split(1, [(r[:3], r[3]) for r in rows])
    return out


def fitted(spark, rows, partitions=3, **limits):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    merged = extra_trees.training_rows(df, FEATURES, "y").repartition(partitions)
    return extra_trees.fit(merged, FEATURES, trees=4, depth=6, seed=42, **limits)


@pytest.mark.parametrize("local_rows", [10**6, 40, 1])
def test_equals_a_plain_recursion(spark, local_rows):
    """Grown in one task per tree, partly by passes, or by passes alone."""
    rows = made_rows()
    forest = fitted(spark, rows, local_rows=local_rows)
    for tree in range(4):
        wanted = plain_tree(rows, tree, 6, 42)
        for node, (feature, threshold, value) in wanted.items():
            assert forest.split[tree, node] == feature
            assert forest.value[tree, node] == pytest.approx(float(value), rel=1e-12)
            if feature != extra_trees.LEAF:
                assert forest.threshold[tree, node] == threshold
        inner = (forest.split[tree] != extra_trees.LEAF).sum()
        assert inner == sum(f != extra_trees.LEAF for f, _, _ in wanted.values())


def test_trees_differ_and_do_not_follow_partitions(spark):
    rows = made_rows()
    one, other = (fitted(spark, rows, n, local_rows=m) for n, m in ((1, 10**6), (7, 30)))
    assert len({one.threshold[t].tobytes() for t in range(4)}) == 4
    for name in ("split", "threshold", "value"):
        assert (getattr(one, name) == getattr(other, name)).all()


def test_predictions(spark):
    rows = made_rows()
    forest = fitted(spark, rows)
    df = spark.createDataFrame([*rows[:50], (None, 1, 1, None, None, None)], SCHEMA)
    got = forest.predict(df, "guess").collect()
    trees = [plain_tree(rows, t, 6, 42) for t in range(4)]
    for r in got:
        x = (r["a"], r["b"], r["c"])
        if None in x:
            assert r["guess"] is None
            continue
        values = []
        for tree in trees:
            node = 1
            while tree[node][0] != extra_trees.LEAF:
                node = 2 * node + (x[tree[node][0]] > tree[node][1])
            values.append(float(tree[node][2]))
        assert r["guess"] == pytest.approx(sum(values) / 4, rel=1e-12)


def test_thresholds_are_even():
    """Drawn evenly between the ends of each node, independent by tree, node and feature."""
    tree, node = (a.ravel() for a in np.meshgrid(np.arange(50), np.arange(1, 200)))
    least, most = np.zeros((len(tree), 3)), np.full((len(tree), 3), 8.0)
    drawn = extra_trees._thresholds(42, tree, node, least, most)
    assert (drawn >= 0).all() and (drawn < 8).all()
    assert np.histogram(drawn, 8, (0, 8))[0].max() < 1.1 * drawn.size / 8
    assert np.abs(np.corrcoef(drawn.T) - np.eye(3)).max() < 0.05
    assert len(np.unique(drawn)) == drawn.size


def test_rows_without_a_target_or_feature_and_no_rows(spark):
    rows = [(1.0, 2, 0, 3.0, 0, 0), (None, 2, 0, 9.0, 0, 0), (1.0, 2, 0, None, 0, 0)]
    forest = fitted(spark, rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r["g"] for r in forest.predict(df, "g").collect()] == [3.0, None, 3.0]
    none = fitted(spark, [])
    assert {r["g"] for r in none.predict(df, "g").collect()} == {None}


def test_large_and_negative_targets_are_exact(spark):
    rows = [(float(k % 2), 0, 0, (-1) ** k * 1e11 + k, 0, 0) for k in range(40)]
    forest = fitted(spark, rows)
    by_side = defaultdict(list)
    for r in rows:
        by_side[r[0]].append(r[3])
    df = spark.createDataFrame(rows, SCHEMA)
    for r in forest.predict(df, "g").collect():
        assert r["g"] == pytest.approx(sum(by_side[r["a"]]) / 20, rel=1e-13)


def test_tasks_get_only_the_nodes_found(spark, monkeypatch):
    """functions and broadcasts grow with the nodes, not with what the depth allows."""
    rows = made_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    merged = extra_trees.training_rows(df, FEATURES, "y").localCheckpoint()
    sent = sent_to_tasks(df, monkeypatch)
    forest = extra_trees.fit(merged, FEATURES, trees=25, depth=15, seed=42, local_rows=100)
    got = forest.predict(df, "guess").select("y", "guess").collect()
    assert {"mapInArrow", "pandas_udf"} <= {name for name, _ in sent}
    nodes = 25 * 2 * merged.count()
    assert max(size for _, size in sent) < 100_000 + 9 * nodes, sent
    assert all(r["guess"] is not None for r in got)
