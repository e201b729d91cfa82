import math

import numpy as np
import odd
import pytest

from panelforge.llm import whitening
from panelforge.llm.tables import read

SCHEMA = "vec_id long, embedding array<float>, n int, x string, component int, row long"


def usable(rows):
    out = []
    for i, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            out.append((i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]))
    width = max((len(x) for _, x in out), default=0)
    return [(i, x + [100_000] * (width - len(x))) for i, x in out]


def check(got, rows, count):
    """Against eigh over all vectors; projections up to sign, by row."""
    rows = usable(rows)
    n, matrix = len(rows), np.array([x for _, x in rows], float)
    sums = [sum(column) for column in zip(*(x for _, x in rows), strict=True)]
    centred = matrix - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    assert len(got) == n * count
    deviations = sorted(
        (repr(i), sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))) for i, x in rows
    )
    for c in range(1, count + 1):
        own = [r for r in got if r["component"] == c]
        assert sorted((repr(r["vec_id"]), r["deviation"]) for r in own) == deviations
        wanted = centred @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        key = sorted(zip(map(repr, (i for i, _ in rows)), wanted.tolist(), strict=True))
        flipped = sorted((i, -z) for i, z in key)
        found = sorted((repr(r["vec_id"]), r["whitened"]) for r in own)
        close = [
            all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-8 for a, b in zip(found, side, strict=True))
            for side in (key, flipped)
        ]
        assert any(close), c
        assert all(r["n"] == n and r["identity_error"] < 1e-9 for r in own)
        share = values[c - 1] / np.trace(centred.T @ centred / n)
        assert all(abs(r["explained"] / share - 1) < 1e-9 for r in own)


def odd_vectors():
    draw = np.random.default_rng(5)
    made = draw.standard_normal((300, 40)) * np.linspace(0.2, 0.4, 40)
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(made)]
    rows += [(7, rows[7][1])] * 150
    rows += [(None, rows[3][1]), (900, None), (901, [0.5, None]), (902, [math.nan] * 40)]
    rows += [(903, [math.inf] + [0.0] * 39), (904, []), (905, [0.25] * 7)]
    return rows


def test_against_eigh(spark):
    rows = odd_vectors()
    extra = [(*r, 1, None, 2, None) for r in rows]
    df = spark.createDataFrame(extra, SCHEMA).repartition(5)
    check(whitening.whiten(df).collect(), rows, 8)


def test_smallest_table(spark):
    df = read(spark, odd.SF, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    check(whitening.whiten(df).collect(), rows, 8)


def test_fewer_dimensions_than_components(spark):
    draw = np.random.default_rng(2).standard_normal((50, 3)) * [1, 0.5, 0.2]
    rows = [(k, v) for k, v in enumerate(draw.astype("float32").tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check(whitening.whiten(df).collect(), rows, 3)


def test_no_variance_and_no_rows(spark):
    same = spark.createDataFrame([(k, [0.5, 0.25]) for k in range(4)], "vec_id long, embedding array<double>")
    got = whitening.whiten(same).collect()
    assert len(got) == 8
    assert {(r["whitened"], r["explained"], r["deviation"]) for r in got} == {(None, 0.0, 0)}
    for rows in ([], [(1, None)]):
        none = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert whitening.whiten(none).collect() == []


def test_large_entries_are_exact(spark):
    rows = [(1, [2.0**40, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df).collect()}
    assert got == {1: None, 2: None, 3: None}


class Given(whitening.Covariance):
    """A covariance that is given as a matrix."""

    def __init__(self, matrix):
        self.matrix, self.width, self.passes = matrix, len(matrix), 0
        self.trace = float(np.trace(matrix))

    def times(self, block):
        self.passes += 1
        return self.matrix @ block


@pytest.mark.parametrize("kind", ["flat", "long tail", "low rank", "equal", "gap"])
def test_components_of_many_spectra(kind):
    width = 200
    values = {
        "flat": np.linspace(1.0, 1.3, width),
        "long tail": 1.0 / np.arange(1, width + 1) ** 2,
        "low rank": np.r_[np.arange(1.0, 6.0), np.zeros(width - 5)],
        "equal": np.r_[np.full(20, 3.0), np.ones(width - 20)],
        "gap": np.r_[np.full(9, 1e6) + np.arange(9), np.ones(width - 9)],
    }[kind]
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((width, width)))[0]
    given = Given((turn * values) @ turn.T)
    found, vectors = whitening.principal_components(given)
    wanted = np.sort(values)[::-1][:8]
    assert np.allclose(found, wanted, rtol=1e-10, atol=1e-12)
    assert np.abs(given.matrix @ vectors - vectors * found).max() <= 1e-10 * wanted[0]
    assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-10)
    assert given.passes < 200
