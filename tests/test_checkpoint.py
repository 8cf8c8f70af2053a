"""Extendable sensor factors, and the separable process against the dense product."""

import numpy as np

from fieldloom.functions import kernels as kn
from fieldloom.operators import checkpoint as cp
from fieldloom.operators import predict as pr
from fieldloom.operators import selection as sl

KERNEL = sl.RadialKernel(kn.matern, nu=1.5, ls=3.0)


def points(spark, n=80, seed=1):
    x = np.random.default_rng(seed).uniform(0, 10, size=(n, 2))
    return x, spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


def test_extended_equals_fresh(spark, tmp_path):
    x, df = points(spark)
    path, ways = str(tmp_path / "f"), []
    for k in (5, 12, 7, 12, 20):
        got = cp.factor_at(spark, path, df, KERNEL, 1e-2, k, ways.append)
        want = cp.fresh(df, KERNEL, 1e-2, k)
        assert got.ids.tolist() == want.ids.tolist() and got.k == k
        assert np.allclose(got.low, want.low) and np.allclose(got.inverse, want.inverse)
        assert np.allclose(got.low @ got.low.T, KERNEL(got.coords, got.coords) + 1e-2 * np.eye(k))
        y = np.sin(got.coords[:, 0])
        assert np.allclose(got.solve(y), np.linalg.solve(KERNEL(got.coords, got.coords) + 1e-2 * np.eye(k), y))
    assert ways == ["fresh", "extended", "prefix", "prefix", "extended"]


def test_other_covariance_and_broken_version_are_not_used(spark, tmp_path):
    _, df = points(spark)
    path, ways = str(tmp_path / "f"), []
    cp.factor_at(spark, path, df, KERNEL, 1e-2, 6, ways.append)
    cp.factor_at(spark, path, df, sl.RadialKernel(kn.matern, nu=1.5, ls=2.0), 1e-2, 4, ways.append)
    part = spark.createDataFrame([(0, 1)], "rank bigint, id bigint")
    part.write.parquet(f"{path}/k=50/{'0' * 32}")
    assert cp.load(spark, path).k == 6 and ways == ["fresh", "fresh"]


def test_no_variance_left(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(9)], "id long, x array<double>")
    assert cp.fresh(df, KERNEL, 1e-2, 6).ids.tolist() == [0, 2, 1]


def test_space_time_equals_the_dense_product(spark):
    """Six times and forty places: the mean of the joint process with covariance K_t x K_s."""
    rng = np.random.default_rng(2)
    xy = np.array([(i // 8, i % 8) for i in range(40)], float)
    rows = [(i, float(p[0]), float(p[1]), [0.0] * 6) for i, p in enumerate(xy)]
    prof = spark.createDataFrame(rows, "loc long, y double, x double, vec array<double>")
    times, at = np.array([0, 2, 3, 5]), np.array([1, 9, 17, 22, 30, 38])
    readings = rng.normal(size=(4, 6))
    k_t, k_s = sl.RadialKernel(kn.matern, nu=2.5, ls=2.0), KERNEL
    out = pr.kronecker_kriging(prof, 6, times, xy[at], readings, k_t, k_s, 1.4, 0.05).orderBy("loc").collect()
    t_all = np.arange(6.0)[:, None]
    left = np.kron(k_t(t_all, t_all[times]), k_s(xy, xy[at])) * 1.4
    inner = np.kron(k_t(t_all[times], t_all[times]), k_s(xy[at], xy[at])) * 1.4 + 0.05 * np.eye(24)
    want = (left @ np.linalg.solve(inner, readings.ravel())).reshape(6, 40).T
    assert np.allclose(np.stack([r["pred"] for r in out]), want)
