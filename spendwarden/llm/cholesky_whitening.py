"""Whitening of embeddings by shifted CholeskyQR.

Centred rows X are orthogonalised by distributed passes: each adds up the Gram matrix of the rows as they are so far, its
Cholesky factor (of a shifted matrix, where rounding or dependent columns would stop it) is one more triangular solve for
the next pass. The product R of the factors has X = QR; the decomposition of the small R gives the principal axes.
Only sums over the rows, of a size set by the dimension, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

COMPONENTS = 32
SCALE, OFFSET = 64.0, 1_000_000
LARGEST = 2.0**62  # scaled entries beyond stay here
BLOCK = 2048  # rows that are added to a Gram matrix at once
PASSES = 12
ROUNDING = 2.0**-53
DEAD = 1e-12  # axes of a spread below this part of the greatest hold rounding only
SETTLED = 1e-11


def scaled(rows: DataFrame) -> DataFrame:
    """vec_id, x: floor(64 c) + 1000000 of every entry; rows whose vector is null or holds null or non-finite entries go.

    A null vec_id stays. Entries whose 64-fold passes 2^62 count as that.
    """
    c = F.col("embedding")
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    whole = lambda e: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.lit(SCALE) * e.cast("double")))).cast("long") + F.lit(OFFSET)
    return rows.where(c.isNotNull() & ~bad).select(F.col("vec_id").cast("long"), F.transform(c, whole).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, integer rows) of bounded blocks; shorter vectors are filled up as if with zeros."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            x = part.column(1)
            size = np.diff(np.asarray(x.offsets))
            out = np.full((len(x), dim), OFFSET, np.int64)
            out[np.arange(dim) < size[:, None]] = x.flatten().to_numpy(zero_copy_only=False)
            yield part.column(0), out


def _summed(points: DataFrame, dim: int, of_block: Callable[[np.ndarray], np.ndarray], kind: str) -> list:
    """Sums over all rows of the values that of_block gives for a block, each task's own sum first; kind: double or decimal(38,0)."""
    whole = kind != "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, dim):
            part = of_block(x)
            total = part if total is None else total + part
        if total is not None:
            values = pa.array([[str(v) for v in total]], pa.list_(pa.string())) if whole else pa.array([total], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([values], names=["part"])

    parts = points.mapInArrow(run, f"part array<{'string' if whole else 'double'}>")
    sums = parts.select(F.posexplode("part").alias("place", "value")).groupBy("place").agg(F.sum(F.col("value").cast(kind)).alias("value")).collect()
    return [r["value"] for r in sorted(sums, key=lambda r: r["place"])]


class Centre:
    """n rows with per-dimension sums S. Deviations n x - S are exact: 64-bit where they fit, else Python integers."""

    def __init__(self, n: int, sums: list[int], greatest: int):
        self.n, self.sums = n, sums
        self.small = 2 * n * max(greatest, 1) < 2**62

    def deviations(self, x: np.ndarray) -> np.ndarray:
        if self.small:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in doubles, centred before rounding."""
        return (self.deviations(x) / self.n).astype(float)

    def squares(self, x: np.ndarray) -> list[int | None]:
        """Sum of squared deviations of each row; None where it passes the range of a long."""
        d = self.deviations(x)
        most = max(abs(int(d.max())), abs(int(d.min()))) if d.size else 0
        if most * most * max(d.shape[1], 1) >= 2**62:
            d = d.astype(object)
        return [v if v < 2**63 else None for v in map(int, (d * d).sum(1))]


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows times the inverse of each upper triangular factor in turn, by forward substitution over columns."""
    q = np.asfortranarray(rows)
    for r in factors:
        for j in range(len(r)):
            if j:
                q[:, j] -= q[:, :j] @ r[:j, j]
            q[:, j] /= r[j, j]
    return q


def _triangle(dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(dim)


def _square(values: list[float], dim: int) -> np.ndarray:
    g = np.zeros((dim, dim))
    g[_triangle(dim)] = values
    return g + np.triu(g, 1).T


def factor(gram: Callable[[list[np.ndarray]], np.ndarray], dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(spreads of the axes by falling size, axes as columns, passes): R of the centred rows, and its decomposition.

    gram(factors) is the Gram matrix of the rows after these solves. Axes whose spread is rounding only are left out.
    """
    factors: list[np.ndarray] = []
    r = np.eye(dim)
    left, spread, axes = r, np.zeros(dim), r
    for done in range(PASSES):
        g = gram(factors)
        if not g.any():
            break
        if factors:
            alive = left[:, spread > DEAD * spread[0]]
            if np.abs(alive.T @ g @ alive - np.eye(alive.shape[1])).max() < SETTLED:
                break
        shift = 11 * (BLOCK * dim + dim * (dim + 1)) * ROUNDING * np.linalg.norm(g, 2)
        try:
            low = np.linalg.cholesky(g if factors else g + shift * np.eye(dim))
        except np.linalg.LinAlgError:
            low = np.linalg.cholesky(g + shift * np.eye(dim))
        factors.append(low.T.copy())
        r = factors[-1] @ r
        left, spread, turned = np.linalg.svd(r)
        axes = turned.T
    if not factors:
        return np.zeros(0), np.zeros((dim, 0)), 0
    keep = spread > DEAD * spread[0]
    axes = axes[:, keep]
    top = np.abs(axes).argmax(0)
    return spread[keep], axes * np.where(axes[top, np.arange(axes.shape[1])] < 0, -1.0, 1.0), len(factors)


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each whole vector and component.

    n: vectors; deviation: sum over dimensions of (n x - S)^2, null where that passes a long; whitened: centred row on
    the component over the root of its eigenvalue; explained: its share of the variance; identity_error: largest entry of
    the whitened values' covariance minus the identity, added up in a pass of its own. Components are numbered by falling
    eigenvalue, their largest entry is positive. Shorter vectors count as filled up with zeros; repeated rows and ids all
    count and all return. Directions without variance have no component: an empty table, a single vector and equal
    vectors give no rows.
    """
    spark = rows.sparkSession
    points = written(scaled(rows), "vectors")
    dim, greatest = points.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))).first()
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not dim:
        return spark.createDataFrame([], schema)

    def totals(x: np.ndarray) -> np.ndarray:
        exact = x if int(np.abs(x).max()) * len(x) < 2**62 else x.astype(object)
        return np.array([len(x), *map(int, exact.sum(0))], object)

    n, *sums = map(int, _summed(points, dim, totals, "decimal(38,0)"))
    centre = Centre(n, sums, max(int(greatest), OFFSET))

    def gram(factors: list[np.ndarray]) -> np.ndarray:
        def of_block(x: np.ndarray) -> np.ndarray:
            q = solved(centre.rows(x), factors)
            return (q.T @ q)[_triangle(dim)]

        return _square(_summed(points, dim, of_block, "double"), dim)

    spread, axes, _ = factor(gram, dim)
    k = min(components, len(spread))
    if not k:
        return spark.createDataFrame([], schema)
    turn = axes[:, :k] * (n**0.5 / spread[:k])
    explained = spread[:k] ** 2 / (spread**2).sum()

    def moments(x: np.ndarray) -> np.ndarray:
        z = centre.rows(x) @ turn
        return np.concatenate([z.sum(0), (z.T @ z)[_triangle(k)]])

    first = np.array(_summed(points, dim, moments, "double")) / n
    error = float(np.abs(_square(first[k:], k) - np.outer(first[:k], first[:k]) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, dim):
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            z = centre.rows(x) @ turn
            yield pa.RecordBatch.from_arrays(
                [ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(centre.squares(x), pa.int64()).take(each),
                 pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return points.mapInArrow(run, schema)
