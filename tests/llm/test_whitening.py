"""Incremental whitening against a direct eigendecomposition of the exact covariance."""

import math
from collections import Counter

import numpy as np
import pytest

from spanguard.llm import whitening
from spanguard.llm.whitening import fit, rank_one, secular_roots, whiten

SCHEMA = "vec_id bigint, embedding array<float>, n string, component string, whitened int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "n", "c", 1) for i, v in rows], SCHEMA).repartition(parts)


def direct(rows, dim):
    usable = [(i, [float(np.float32(c)) for c in v]) for i, v in rows
              if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in usable], dtype=object)
    n = len(x)
    centred = n * x - x.sum(axis=0)
    near = centred.astype(np.float64) / n
    values, vectors = np.linalg.eigh(near.T @ near / n)
    return [i for i, _ in usable], n, (centred * centred).sum(axis=1), near, values[::-1], vectors[:, ::-1]


def some_rows(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim)) * np.linspace(2.0, 0.2, dim) + 1e3 * rng.normal(size=dim)
    return [(i, data[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("parts, fan_in, compact", [(1, 16, 16), (7, 2, 1), (5, 3, 4)])
def test_whitening_is_that_of_the_covariance(spark, parts, fan_in, compact):
    rows = some_rows(400, 10) + [(500 + i, [1.0] * 10) for i in range(150)]  # a hot vector
    rows += [(900, None), (901, [1.0] * 9 + [None]), (902, [float("nan")] * 10), (903, [float("-inf")] + [0.0] * 9), (904, [1.0]), (905, []), (None, [2.0] * 10), (3, rows[3][1])]
    df = frame(spark, rows, parts)
    model = fit(df, fan_in=fan_in, compact=compact)
    got = whiten(df, model).collect()
    ids, n, deviation, near, values, vectors = direct(rows, 10)
    assert {r.n for r in got} == {n} and len(got) == 8 * n
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter(zip(ids, map(int, deviation)))
    assert np.allclose(model.explained, values[:8] / values.sum(), rtol=1e-10)
    assert {r.identity_error for r in got} == {model.identity_error} and model.identity_error < 1e-10
    want = near @ vectors[:, :8] / np.sqrt(values[:8])
    for c in range(8):
        mine = {}
        for r in got:
            if r.component == c + 1:
                mine[r.vec_id] = r.whitened
        there = dict(zip(ids, want[:, c]))
        sign = np.sign(sum(mine[i] * there[i] for i in mine))
        assert max(abs(mine[i] - sign * there[i]) for i in mine) < 1e-8


def test_fewer_components_than_eight(spark):
    rows = [(i, [float(i % 5), 2.0 * (i % 5), float(i % 3)]) for i in range(60)]  # rank 2
    got = whiten(frame(spark, rows), fit(frame(spark, rows))).collect()
    assert Counter(r.component for r in got) == {1: 60, 2: 60}


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.5])] * 5, [(1, [3.0])]):
        df = frame(spark, rows)
        assert whiten(df, fit(df)).collect() == []


def test_large_components(spark):
    rows = [(i, [1e30 if i % 2 else -1e30, float(i)]) for i in range(6)]
    got = whiten(frame(spark, rows), fit(frame(spark, rows))).collect()
    assert {r.deviation for r in got} == {None} and all(math.isfinite(r.whitened) for r in got)


def test_rank_one_updates_follow_the_matrix():
    rng = np.random.default_rng(1)
    for dim in (1, 2, 5, 30):
        values, vectors, matrix = np.zeros(dim), np.eye(dim), np.zeros((dim, dim))
        rows = rng.integers(-300, 300, (150, dim)).astype(float)
        rows[::7], rows[3] = rows[0], 0.0
        rows[:, -1] = rows[:, 0]
        rows[40:60, : dim // 2] = 0.0
        for row in rows:
            weight = float(rng.integers(1, 4))
            values, vectors = rank_one(values, vectors, weight, row)
            matrix += weight * np.outer(row, row)
        size = np.abs(matrix).max()
        assert np.abs(np.linalg.eigvalsh(matrix) - values).max() < 1e-11 * size
        assert np.abs(vectors.T @ vectors - np.eye(dim)).max() < 1e-11
        assert np.abs((vectors * values) @ vectors.T - matrix).max() < 1e-11 * size


def test_secular_roots_lie_between_the_poles():
    poles, squares = np.array([0.0, 1e-9, 1.0, 1e6]), np.array([1e-12, 0.3, 1e-20, 0.7])
    near, x = secular_roots(poles, squares, 2.5)
    roots = poles[near] + x
    assert np.all(roots >= poles) and np.all(roots[:-1] <= poles[1:])
    matrix = np.diag(poles) + 2.5 * np.outer(np.sqrt(squares), np.sqrt(squares))
    assert np.allclose(np.sort(roots), np.linalg.eigvalsh(matrix), rtol=1e-9, atol=1e-9)


def test_deviation_beyond_64_bits():
    near = np.array([[3_037_000_499, 0], [3_037_000_500, 0], [1 << 62, 1 << 62]], dtype=object)
    assert whitening._deviations(near).to_pylist() == [3_037_000_499**2, None if 3_037_000_500**2 >= 1 << 63 else 3_037_000_500**2, None]
