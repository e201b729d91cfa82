"""Embeddings projected on their leading principal components, with unit variance.

The components come from subspace iteration with a Chebyshev filter. A block of up to
``BLOCK`` directions is multiplied by the covariance in passes over the distributed
vectors: every pass centres the vectors, sums ``X'(XQ)`` per partition in numpy and adds the
partial sums up in a shuffle of one row per dimension. A three-term recurrence of ``DEGREE``
such products is a Chebyshev polynomial that stays small on the unwanted part of the
spectrum and grows fast above it. Then the block is made orthogonal, and Rayleigh-Ritz
rotates it to approximate components, whose residuals ``Vq - eq`` are measured. Rounds go on
until the residuals of the wanted components are at the rounding level of doubles, which
certifies them. The driver holds the block (dimensions x ``BLOCK``), never vectors.

An entry c becomes ``x = floor(1024 c) + 100000``. Sums of x are exact numbers, and so is
``deviation``, the sum over dimensions of (n x - S)^2.

Defined results: rows whose vector is null, or holds a null or a number that is not finite,
are left out; a shorter vector counts as followed by zeros; repeated rows count each;
``vec_id`` is only passed on and may be null; a component without variance has the
eigenvalue and ``explained`` 0 and a null ``whitened``, and does not enter
``identity_error``; with fewer than 8 dimensions there are as many components; a component's
sign makes its largest entry positive; equal eigenvalues leave their components free to
turn; a deviation beyond a long is null; an entry must lie within 2^42; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.tables import schema
from panelforge.session import materialize

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
# Directions that are iterated: the more, the sooner the wanted ones stand out.
BLOCK = 32
# Products with the covariance per round.
DEGREE = 8
# Residuals over the largest eigenvalue that count as rounding; beyond the second bound a
# block that no longer improves is not accepted.
ROUNDING, ACCEPTED = 1e-13, 1e-10
MAX_ROUNDS = 500
# Shares of the trace below which an eigenvalue is none.
NO_VARIANCE = 1e-14
# Rows that are worked on together.
PIECE_ROWS = 4096
LONGEST = 2**63 - 1

Batches = Iterator[pa.RecordBatch]


def _usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id`` and the vectors without null and non-finite entries."""
    vector = F.col("embedding").cast("array<double>")
    wrong = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
        .where(F.col("vector").isNotNull())
        .where(~wrong)
    )


def _scaled(rows: DataFrame, width: int) -> DataFrame:
    """``vec_id`` and ``x``: the scaled entries as packed doubles, ``width`` in every row."""

    def scale(batches: Batches) -> Batches:
        for batch in batches:
            vectors = batch.column("vector")
            sizes = np.diff(vectors.offsets.to_numpy())
            x = np.zeros((len(sizes), width))
            x[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy()
            x = np.floor(x * SCALE) + SHIFT
            packed = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), packed], ["vec_id", "x"])

    return rows.mapInArrow(scale, schema(vec_id="bigint", x="binary"))


def _blocks(batches: Batches, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of the batches with their vectors as a matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            piece = batch.slice(at, PIECE_ROWS)
            packed = b"".join(piece.column("x").to_pylist())
            yield piece, np.frombuffer(packed).reshape(-1, width)


def _exact_sums(vectors: DataFrame, width: int) -> list[int]:
    """Per dimension the sum of x, in whole numbers."""

    def sums(batches: Batches) -> Batches:
        total = np.zeros(width, np.int64)
        for _, x in _blocks(batches, width):
            total += x.astype(np.int64).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width)), pa.array(total)], ["dim", "total"]
        )

    parts = vectors.select("x").mapInArrow(sums, schema(dim="bigint", total="bigint"))
    found = parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return [int(row["total"]) for row in sorted(found.collect())]


def _summed(
    vectors: DataFrame, width: int, rows: int, columns: int, part: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray:
    """The sum of ``part`` over all vectors, a matrix of ``rows`` x ``columns``.

    Every task adds up its own pieces; the matrices of the tasks meet by their rows.
    """
    names = [f"s{j}" for j in range(columns)]

    def sums(batches: Batches) -> Batches:
        total = np.zeros((rows, columns))
        for _, x in _blocks(batches, width):
            total += part(x)
        arrays = [pa.array(np.arange(rows)), *map(pa.array, np.ascontiguousarray(total.T))]
        yield pa.RecordBatch.from_arrays(arrays, ["row", *names])

    parts = vectors.select("x").mapInArrow(sums, schema(row="bigint", **dict.fromkeys(names, "double")))
    found = parts.groupBy("row").agg(*[F.sum(name).alias(name) for name in names]).collect()
    return np.array([tuple(row)[1:] for row in sorted(found)])


class Covariance:
    """Products of the covariance of the vectors with a block, one pass each."""

    def __init__(self, vectors: DataFrame, width: int, n: int, sums: list[int]):
        self.vectors, self.width, self.n = vectors, width, n
        self.mean = np.array([s / n for s in sums])
        self.trace = 0.0
        self.passes = 0

    def times(self, block: np.ndarray) -> np.ndarray:
        mean = self.mean

        def part(x: np.ndarray) -> np.ndarray:
            x = x - mean
            return np.column_stack([x.T @ (x @ block), (x * x).sum(axis=0)])

        found = _summed(self.vectors, self.width, self.width, block.shape[1] + 1, part) / self.n
        self.trace = float(found[:, -1].sum())
        self.passes += 1
        return found[:, :-1]


def _rotated(
    block: np.ndarray, product: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: eigenvalues by size, the block and its product turned to them."""
    inner = block.T @ product
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], block @ turn, product @ turn


def _filtered(
    covariance: Covariance, block: np.ndarray, product: np.ndarray, low: float, high: float, top: float
) -> np.ndarray:
    """The Chebyshev polynomial of ``DEGREE`` in the covariance, applied to the block.

    It is small between ``low`` and ``high`` and scaled to 1 at ``top``. ``product`` is the
    covariance times the block, known from Rayleigh-Ritz, and saves the first pass.
    """
    centre, half = (high + low) / 2, (high - low) / 2
    scale = first = half / (top - centre)
    before, now = block, (product - centre * block) * (first / half)
    for _ in range(DEGREE - 1):
        following = 1 / (2 / first - scale)
        moved = (covariance.times(now) - centre * now) * (2 * following / half)
        before, now, scale = now, moved - scale * following * before, following
    return now


def principal_components(
    covariance: Covariance, wanted: int = COMPONENTS, block_size: int = BLOCK
) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of the covariance and their unit eigenvectors, as columns."""
    width = covariance.width
    wanted, size = min(wanted, width), min(max(block_size, 2 * wanted), width)
    start = np.random.default_rng(0).standard_normal((width, size))
    block = np.linalg.qr(start)[0]
    low, best, stuck = None, np.inf, 0
    for _ in range(MAX_ROUNDS):
        values, block, product = _rotated(block, covariance.times(block))
        residuals = np.linalg.norm(product - block * values, axis=0)
        largest = max(float(values[0]), 0.0)
        worst = float(residuals[:wanted].max())
        if largest <= NO_VARIANCE * covariance.trace or worst <= ROUNDING * largest:
            break
        stuck = stuck + 1 if worst > best / 2 else 0
        if stuck >= 2 and best <= ACCEPTED * largest:
            break
        best = min(best, worst)
        if low is None:
            # The least value of a random block and its residual tell where the spectrum
            # ends; a bound that is too high only slows the filter down.
            low = max(0.0, float(values[-1] - 3 * residuals[-1]))
        elif stuck >= 2:
            low = 0.0
        high = float(values[-1])
        if high - low <= 1e-9 * largest:
            low = 0.0
        if size == width or high <= 0 or largest - high <= 1e-12 * largest:
            # The block holds the whole space, or nothing tells wanted from unwanted.
            block = np.linalg.qr(product + largest * block)[0]
        else:
            block = _filtered(covariance, block, product, low, high, largest)
            block = np.linalg.qr(block)[0]
    else:
        raise ArithmeticError(f"components not certified: residual {worst} of {largest}")
    values, block = values[:wanted], block[:, :wanted]
    signs = np.sign(block[np.abs(block).argmax(axis=0), np.arange(wanted)])
    return np.where(values > NO_VARIANCE * covariance.trace, values, 0.0), block * signs


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sums of (n x - S)^2 as whole numbers; None beyond a long."""
    x = x.astype(np.int64)
    reach = max((max(abs(n * int(m) - s) for m in side) for side, s in
                 zip(zip(x.min(axis=0), x.max(axis=0), strict=True), sums, strict=True)), default=0)
    if reach * reach * max(1, len(sums)) <= LONGEST and n * int(np.abs(x).max(initial=0)) <= LONGEST:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    found = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v <= LONGEST else None for v in found]


def _identity_error(
    vectors: DataFrame, width: int, n: int, project: Callable[[np.ndarray], np.ndarray], size: int
) -> float:
    """The largest entry of the covariance of the projections minus the identity."""
    if not size:
        return 0.0
    mean = _summed(vectors, width, 1, size, lambda x: project(x).sum(axis=0)[None])[0] / n

    def squares(x: np.ndarray) -> np.ndarray:
        z = project(x) - mean
        return z.T @ z

    covariance = _summed(vectors, width, size, size, squares) / n
    return float(np.abs(covariance - np.eye(size)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component."""
    out = schema(
        vec_id="bigint",
        component="int",
        n="bigint",
        deviation="bigint",
        whitened="double",
        explained="double",
        identity_error="double",
    )
    usable = _usable(embeddings)
    size = usable.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    n, width = size["n"], size["width"]
    if not width:
        return embeddings.sparkSession.createDataFrame([], out)
    vectors = materialize(_scaled(usable, width), "vectors")
    sums = _exact_sums(vectors, width)
    covariance = Covariance(vectors, width, n, sums)
    values, vectors_of = principal_components(covariance, components)
    mean, real = covariance.mean, int((values > 0).sum())
    axes = vectors_of[:, :real] / np.sqrt(values[:real])

    def project(x: np.ndarray) -> np.ndarray:
        return (x - mean) @ axes

    error = _identity_error(vectors, width, n, project, real)
    count = len(values)
    explained = values / covariance.trace if covariance.trace else np.zeros(count)

    def rows(batches: Batches) -> Batches:
        for piece, x in _blocks(batches, width):
            m = len(x)
            z = np.full((m, count), np.nan)
            z[:, :real] = project(x)
            z = pa.array(z.ravel(), mask=np.tile(np.arange(count) >= real, m))
            at = pa.array(np.repeat(np.arange(m), count))
            deviation = pa.array(_deviations(x, n, sums), pa.int64())
            arrays = [
                piece.column("vec_id").take(at),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                pa.array(np.full(m * count, n)),
                deviation.take(at),
                z,
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * count, error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, out.names)

    return vectors.mapInArrow(rows, out)
