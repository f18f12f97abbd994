"""Whitening against a dense eigensolver, exact sums and awkward rows."""
from __future__ import annotations

import math

import numpy as np
import pytest

from alertloom.llm import feast_whitening as fw
from alertloom.llm import queries

SMALL = "/root/testdata/sf0.001"


def usable(v, dim):
    return v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)


def check(frame, rows, dim, components=16):
    """Every contract column against plain arithmetic; whitened values up to the sign of a component."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if usable(v, dim)]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(n * a - s) / n for a, s in zip(x, total)] for x in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = min(components, int((values > values.max() * dim * 4e-15).sum()))
    got = frame.collect()
    assert len(got) == rank * len(kept)
    assert {r.identity_error for r in got if r.identity_error > 1e-9} == set() and {r.n for r in got} <= {n}
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9
    deviation = lambda x: sum((n * a - s) ** 2 for a, s in zip(x, total))
    for k, found in by.items():
        score = lambda x: float(np.array([float(n * a - s) / n for a, s in zip(x, total)]) @ vectors[:, k - 1] / math.sqrt(values[k - 1]))  # noqa: E731, B023
        want = sorted((str(i), deviation(x), score(x)) for i, x in kept)
        best = min(max(abs(a[2] - b[2]) for a, b in zip(sorted((str(r.vec_id), r.deviation, s * r.whitened) for r in found), want)) for s in (1, -1))
        assert [w[:2] for w in sorted(want)] == sorted((str(r.vec_id), r.deviation) for r in found)
        assert best < 1e-7, (k, best)


def test_query_on_the_smallest_tables(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    frame = queries.op11_embedding_whitening(spark, SMALL)
    assert frame.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(frame, rows, len(rows[0][1]))


def test_defined_cases(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rnd.normal(5, [1, 2, 3, 4, 1e-9], 5)]) for i in range(40)]
    rows += [(3, rows[3][1]), (50, rows[4][1]), (None, rows[5][1]), (60, None), (61, []), (62, [1.0, None, 2.0, 3.0, 4.0]),
             (63, [float("nan")] + [0.0] * 4), (64, [float("-inf")] + [0.0] * 4), (65, [1.0, 2.0]), (66, [9.0] * 6)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, key string, n int").repartition(6)
    check(fw.whitened(frame), rows, 5)
    check(fw.whitened(frame, components=2), rows, 5, 2)
    assert fw.whitened(frame.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], "vec_id long, embedding array<double>")
    assert fw.whitened(alone).count() == 0 and fw.whitened(alone).columns == frame.limit(0).transform(fw.whitened).columns


def test_far_and_huge_entries(spark):
    rnd = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rnd.normal([1e6, -3e7, 0.0], [0.5, 1.0, 2.0])]) for i in range(50)]
    check(fw.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), rows, 3)
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 3e38])], "vec_id long, embedding array<double>")
    got = fw.whitened(huge).collect()
    assert len(got) == 6 and all(r.deviation is None and math.isfinite(r.whitened) for r in got)


@pytest.mark.parametrize("values", [range(1, 41), [5.0] * 12 + [1.0] * 12, [10.0 ** -k for k in range(20)], [3, 3 + 1e-9, 3 + 2e-9] + [1] * 20 + [0] * 9])
def test_intervals_and_pairs(spark, values):
    size = len(values)
    turn = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))[0]
    cov = turn * np.array(values, float) @ turn.T
    cov = (cov + cov.T) / 2
    exact = np.linalg.eigvalsh(cov)
    for shift in (0.5, 2.5, exact[-1] + 1, -1.0, exact[-3] + 1e-7):
        assert fw.positive_pivots(cov - shift * np.eye(size)) == (exact > shift).sum()
    found, vectors = fw.leading(spark, cov, 7)
    assert np.allclose(found, exact[::-1][:7], atol=1e-13 * exact[-1] * size)
    assert np.abs(vectors.T @ vectors - np.eye(7)).max() < 1e-13
    assert np.abs(cov @ vectors - vectors * found).max() < 1e-12 * exact[-1]


def test_a_missed_pair_is_an_error():
    cov = np.diag([1.0, 2.0, 3.0, 9.0])
    assert np.allclose(fw.contour_pairs(cov, 1.5, 4.0, 2)[0], [2, 3])
    with pytest.raises(ArithmeticError):
        fw.contour_pairs(cov, 1.5, 4.0, 3)
