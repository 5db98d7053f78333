"""Matrix helpers on array columns against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitlab.functions import linalg as L


def frame(spark, ms, vs):
    return spark.createDataFrame([(i, [[float(x) for x in r] for r in m], [float(x) for x in v]) for i, (m, v) in enumerate(zip(ms, vs))],
                                 "k int, m array<array<double>>, v array<double>")


@pytest.mark.parametrize("n", [1, 2, 4, 6])
def test_solve_cholesky_and_density_parts(spark, n):
    rng = np.random.default_rng(n)
    ms = [(lambda a: a @ a.T + 0.1 * np.eye(n))(rng.standard_normal((n, n))) for _ in range(30)]
    vs = [rng.standard_normal(n) for _ in range(30)]
    df = frame(spark, ms, vs).withColumn("c", L.cholesky(F.col("m")))
    got = df.select("k", L.solve(F.col("m"), F.col("v")).alias("x"), "c", L.forward(F.col("c"), F.col("v")).alias("z"),
                    L.log_det_half(F.col("c")).alias("d"), L.quadratic(F.col("m"), F.col("v")).alias("q"),
                    L.is_positive_definite(F.col("m")).alias("ok")).collect()
    for r in got:
        m, v = ms[r.k], vs[r.k]
        c = np.linalg.cholesky(m)
        assert np.allclose(r.x, np.linalg.solve(m, v), rtol=1e-8)
        assert all(np.allclose(r.c[i], c[i, :i + 1]) for i in range(n))
        assert np.allclose(r.z, np.linalg.solve(c, v)) and np.isclose(r.d, 0.5 * np.linalg.slogdet(m)[1])
        assert np.isclose(r.q, v @ m @ v) and r.ok


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_negative_eigenvalues_are_cut(spark, n):
    rng = np.random.default_rng(n + 10)
    ms = [(lambda a: (a + a.T) / 2)(rng.standard_normal((n, n))) for _ in range(20)] + [np.diag(rng.standard_normal(n)), np.zeros((n, n))]
    got = frame(spark, ms, [np.zeros(n)] * len(ms)).select("k", L.nearest_valid(F.col("m")).alias("p")).collect()
    for r in got:
        w, v = np.linalg.eigh(ms[r.k])
        assert np.allclose(r.p, (v * np.maximum(w, 0)) @ v.T, atol=1e-9)


def test_singular_invalid_and_null_matrices(spark):
    ms = [[[1, 1], [1, 1]], [[1, 2], [2, 1]], [[0, 0], [0, 0]], [[1, 0.5], [0.5, 1]], [[2, 0.5], [0.5, 1]], [[1, 0.5], [0.4, 1]]]
    df = frame(spark, ms, [[1, 2]] * len(ms))
    df = df.unionByName(spark.createDataFrame([(9, [[1.0, None], [None, 1.0]], [1.0, 2.0]), (10, None, None)], df.schema))
    got = {r.k: r for r in df.select("k", L.solve(F.col("m"), F.col("v")).alias("x"), L.is_positive_definite(F.col("m")).alias("pd"),
                                     L.is_correlation(F.col("m")).alias("cor"), L.nearest_valid(F.col("m")).alias("p")).collect()}
    assert [got[k].pd for k in (0, 1, 2, 3, 4, 5, 9, 10)] == [False, False, False, True, True, True, False, False]
    assert [got[k].cor for k in (0, 1, 2, 3, 4, 5, 9, 10)] == [False, False, False, True, False, False, False, False]
    assert got[0].x == [None, None] and got[9].x in (None, [None, None]) and got[10].x is None
    assert got[9].p is None and got[10].p is None
