"""Embedding whitening by contour integration (FEAST).

Vectors become whole numbers, equal ones are folded to a fit list, and sums and centred products of the list are added up in
tasks: about the rounded mean, where they are exact as long as they stay below 2 ** 53, so that the covariance does not depend
on the order of rows. The spectrum is cut into intervals by inertia counts: the number of eigenvalues above a shift is the
number of positive pivots of the shifted covariance, factored with symmetric pivoting; the shifts of a round are counted in
parallel tasks. Each interval that holds one of the wanted eigenvalues is then a task of its own: a quadrature of complex shifted
solves along a circle about the interval filters a random block, Rayleigh-Ritz extracts the pairs inside, and this repeats until
residuals vanish and there are as many pairs as the inertia counts say. A last Rayleigh-Ritz over all intervals makes the
vectors orthogonal to each other. What the driver holds is the covariance, which grows with the dimension only.

Defined cases: rows without a vector, with an empty one, with null or non-finite entries, or of another length than ``dim`` (by
default the most frequent length, the longer of two) are dropped; entries beyond 2 ** 42 saturate; repeated rows and a null id
are returned as often as they stand; components whose eigenvalue vanishes against the trace are left out, so that less than two
distinct vectors give no rows; a deviation that exceeds a long is null; other columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
MOST = float(1 << 48)
SLICE = 4096
NODES, EXTRA, PER_INTERVAL, CUTS = 8, 6, 8, 15
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def packed(rows: DataFrame, dim: int | None = None, vector: str = "embedding", name: str = "vec_id") -> tuple[DataFrame, int]:
    """``vec_id, key`` of the usable rows, and their dimension: the key holds floor(64 * c) of every entry c."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = rows.select(F.col(name).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    if dim is None:
        found = usable.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        dim = found.d if found else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.clip(np.floor(SCALE * batch.column(1).flatten().to_numpy().reshape(-1, dim)), -MOST, MOST)
            small = (np.abs(whole) < 32768).all(axis=1)
            keys = [b"h" + row.astype("<i2").tobytes() if s else b"q" + row.astype("<i8").tobytes() for s, row in zip(small, whole)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["vec_id", "key"])
    return usable.where(F.size("v") == dim).mapInArrow(run, "vec_id long, key binary"), dim


def unpacked(keys: pa.Array, dim: int) -> np.ndarray:
    """The whole numbers of the keys, one row each."""
    out = np.empty((len(keys), dim), np.int64)
    for k, key in enumerate(keys.to_pylist()):
        out[k] = np.frombuffer(key, "<i2" if key[:1] == b"h" else "<i8", offset=1)
    return out


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and their sum per dimension, exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in slices(batches):
            n += batch.num_rows
            total = [a + b for a, b in zip(total, unpacked(batch.column(0), dim).sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(map(str, total))], names=["i", "n", "s"])
    found = fit.select("key").mapInArrow(run, "i int, n long, s string").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r.i: r for r in found}
    return (by[0].n if by else 0), [int(by[i].s) if by else 0 for i in range(dim)]


def products(fit: DataFrame, width: int, make: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """The sum of ``make(keys).T @ make(keys)`` over all vectors: one row of it per partition and column, added up by column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in slices(batches):
            block = make(batch.column(0))
            total += block.T @ block
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[i] = held.get(i, 0) + row.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["i", "row"])
    kind = "i int, row array<double>"
    out = np.zeros((width, width))
    for r in fit.select("key").mapInArrow(run, kind).repartition("i").mapInArrow(add, kind).collect():
        out[r.i] = r.row
    return out


def positive_pivots(matrix: np.ndarray) -> int:
    """Positive eigenvalues of a symmetric matrix, by Sylvester's law from a factorisation with pivots of one or two rows."""
    a, found = matrix.copy(), 0
    limit = (1 + math.sqrt(17)) / 8
    while len(a):
        size = np.abs(a)
        i = int(np.argmax(size.diagonal()))
        p, q = divmod(int(np.argmax(size)), len(a))
        if size[p, q] == 0:
            break
        pick = [i] if size[i, i] >= limit * size[p, q] else [p, q]
        block = a[np.ix_(pick, pick)]
        # a pivot of two rows has a negative determinant: one eigenvalue on either side
        found += int(block[0, 0] > 0) if len(pick) == 1 else 1
        a = np.delete(a - a[:, pick] @ np.linalg.solve(block, a[pick]), pick, 0)
        a = np.delete(a, pick, 1)
    return found


def counts_above(spark: SparkSession, cov: np.ndarray, shifts: list[float]) -> dict[float, int]:
    """Eigenvalues above each shift, one task a shift."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([positive_pivots(cov - s * np.eye(len(cov))) for s in at], pa.int64())], names=["shift", "above"])
    rows = spark.createDataFrame([(s,) for s in shifts], "shift double").repartition(min(len(shifts), 32), "shift")
    return {r.shift: r.above for r in rows.mapInArrow(run, "shift double, above long").collect()}


def intervals(spark: SparkSession, cov: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """``low, high, eigenvalues in (low, high]`` of intervals that hold the ``wanted`` largest eigenvalues, few in each."""
    high = float(np.abs(cov).sum(axis=1).max()) * 1.01
    low = high * len(cov) * float(np.finfo(float).eps) * 8
    above = counts_above(spark, cov, [low]) | {high: 0}
    done, open_ = [], [(low, high)]
    while open_:
        within = [(a, b) for a, b in open_ if above[b] < wanted and above[a] > above[b]]
        full = [(a, b) for a, b in within if above[a] - above[b] > PER_INTERVAL and b - a > 1e-11 * high]
        done += [(a, b, above[a] - above[b]) for a, b in within if (a, b) not in full]
        if not full:
            break
        edges = {(a, b): [a, *np.geomspace(a, b, CUTS + 2)[1:-1].tolist(), b] for a, b in full}
        above |= counts_above(spark, cov, sorted({s for cut in edges.values() for s in cut[1:-1]}))
        open_ = [pair for cut in edges.values() for pair in zip(cut, cut[1:])]
    return sorted(done)


def contour_pairs(cov: np.ndarray, low: float, high: float, count: int, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in (low, high] and their vectors, one per column."""
    size, centre, radius = len(cov), (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 - nodes))
    width = min(size, max(count + EXTRA, count * 3 // 2))
    block = np.random.default_rng(7).standard_normal((size, width))
    tolerance = 4e-15 * size * float(np.abs(cov).sum(axis=1).max())
    for step in range(most):
        filtered = np.zeros(block.shape)
        for z, w in zip(turn, weights):
            filtered += 0.5 * w * (radius * z * np.linalg.solve((centre + radius * z) * np.eye(size) - cov, block)).real
        basis = np.linalg.qr(filtered)[0]
        values, inner = np.linalg.eigh(basis.T @ cov @ basis)
        vectors = basis @ inner
        inside = (values > low) & (values <= high)
        rest = np.linalg.norm(cov @ vectors - vectors * values, axis=0)
        if inside.sum() == count and (rest[inside] <= tolerance).all():
            break
        block = vectors
        if step % 20 == 19 and width < size:  # a subspace that is too narrow for the neighbourhood of the interval
            width = min(size, 2 * width)
            block = np.hstack([vectors, np.random.default_rng(step).standard_normal((size, width - vectors.shape[1]))])
    if inside.sum() != count:
        raise ArithmeticError(f"{inside.sum()} of {count} eigenvalues found between {low} and {high}")
    return values[inside], vectors[:, inside]


def leading(spark: SparkSession, cov: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and their unit vectors in columns: as many as do not vanish."""
    parts = intervals(spark, cov, wanted) if len(cov) and np.abs(cov).max() > 0 else []
    if not parts:
        return np.empty(0), np.empty((len(cov), 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, count in zip(*(c.to_pylist() for c in batch.columns)):
                vectors = contour_pairs(cov, low, high, count)[1]
                yield pa.RecordBatch.from_arrays([pa.array(list(vectors.T), pa.list_(pa.float64()))], names=["vector"])
    rows = spark.createDataFrame(parts, "low double, high double, count long").repartition(len(parts), "low")
    found = np.array([r.vector for r in rows.mapInArrow(run, "vector array<double>").collect()]).T
    if found.shape[1] != sum(p[2] for p in parts):
        raise ArithmeticError("fewer eigenvectors than the inertia counts say")
    basis = np.linalg.qr(found)[0]
    values, inner = np.linalg.eigh(basis.T @ cov @ basis)
    vectors = (basis @ inner)[:, ::-1][:, :wanted]
    heavy = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values[::-1][:wanted], vectors * np.sign(heavy)


def whitened(rows: DataFrame, components: int = 16, dim: int | None = None, vector: str = "embedding", name: str = "vec_id") -> DataFrame:
    """One row per usable row and component: the columns of ``RESULT``."""
    spark = rows.sparkSession
    coded, dim = packed(rows, dim, vector, name)
    empty = spark.createDataFrame([], RESULT)
    if not dim:
        return empty
    every = stored(coded, "vectors")
    fit = stored(every.select("key").distinct(), "fit")
    n, total = sums(fit, dim)
    if not n:
        return empty
    middle = [(2 * s + n) // (2 * n) for s in total]  # the rounded mean
    left = [s - n * m for s, m in zip(total, middle)]  # what rounding left, at most n / 2
    centre, mean = np.array(middle, np.int64), np.array([s / n for s in left])

    def near(keys: pa.Array) -> np.ndarray:
        return (unpacked(keys, dim) - centre).astype(float)
    cov = products(fit, dim, near) / n - np.outer(mean, mean)
    cov = (cov + cov.T) / 2
    values, vectors = leading(spark, cov, components)
    if not len(values):
        return empty
    turn = vectors / np.sqrt(values)
    k = len(values)

    def moved(keys: pa.Array) -> np.ndarray:
        return (near(keys) - mean) @ turn
    second = products(fit, k + 1, lambda keys: np.hstack([moved(keys), np.ones((len(keys), 1))])) / n
    error = float(np.abs(second[:k, :k] - np.outer(second[k, :k], second[k, :k]) - np.eye(k)).max())
    shares = values / np.trace(cov)

    def deviations(keys: pa.Array) -> list[int | None]:
        away = unpacked(keys, dim) - centre
        reach = n * int(np.abs(away).max(initial=0)) + max(map(abs, left))
        if dim * reach ** 2 < 1 << 63:
            return ((n * away - np.array(left, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((n * a - s) ** 2 for a, s in zip(row, left)) for row in away.tolist()]
        return [d if d < 1 << 63 else None for d in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            size = batch.num_rows
            owner = pa.array(np.repeat(np.arange(size), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(owner), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, n)),
                pa.array(deviations(batch.column(1)), pa.int64()).take(owner), pa.array(moved(batch.column(1)).ravel()),
                pa.array(np.tile(shares, size)), pa.array(np.full(size * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return every.mapInArrow(run, RESULT)
