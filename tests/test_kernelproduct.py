"""Implicit covariance products, eigenpairs and pivoted QR against dense numpy."""

import numpy as np
import pytest

from fieldloom.functions import kernels as kn
from fieldloom.operators import kernelproduct as kp
from fieldloom.operators import selection as sl

KERNEL = sl.RadialKernel(kn.matern, nu=1.5, ls=3.0)


def points(spark, n, seed=0, side=20.0):
    x = np.random.default_rng(seed).uniform(0, side, size=(n, 2))
    return x, spark.createDataFrame([(i * 7, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


@pytest.mark.parametrize("left, right", [(4096, 1024), (60, 37)])
def test_product_with_any_vectors(spark, left, right):
    x, df = points(spark, 230)
    v = np.random.default_rng(1).normal(size=(230, 3))
    vectors = spark.createDataFrame([(i * 7, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, v))], "id long, x array<double>, v array<double>")
    got = kp.kernel_product(df, vectors, KERNEL, 230, left, right).orderBy("id").collect()
    assert [r["id"] for r in got] == [i * 7 for i in range(230)]
    assert np.allclose([r["y"] for r in got], KERNEL(x, x) @ v)


def test_eigenpairs_of_500_points(spark):
    x, df = points(spark, 500, 3)
    kernel = sl.RadialKernel(kn.rbf, ls=4.0)
    lam, modes = kp.randomised_eigen(df, kernel, 8, oversample=24, power=3, left=200, right=100)
    dense = kernel(x, x)
    want = np.linalg.eigvalsh(dense)[::-1][:8]
    assert np.allclose(lam, want, atol=1e-6, rtol=0)
    q = np.stack([r["x"] for r in modes.orderBy("id").collect()])
    assert np.allclose(q.T @ q, np.eye(8), atol=1e-9)
    assert np.abs(dense @ q - q * lam).max() < 1e-3


@pytest.mark.parametrize("pool", [4, 64])
def test_pivots_equal_dense_and_stay_off_the_driver(spark, monkeypatch, pool):
    x, df = points(spark, 150, 5)
    left, want = KERNEL(x, x), []
    for _ in range(12):
        j = int(np.argmax(np.round((left**2).sum(0), sl.ROUND)))
        want.append(j * 7)
        q = left[:, j] / np.linalg.norm(left[:, j])
        left = left - np.outer(q, q @ left)
    from pyspark.sql.classic.dataframe import DataFrame

    real, seen = DataFrame.toPandas, []

    def counted(self):
        out = real(self)
        seen.append(len(out))
        return out

    monkeypatch.setattr(DataFrame, "toPandas", counted)
    picks = kp.direct_qr(df, KERNEL, 12, pool=pool, left=64, right=50)
    assert picks.ids.tolist() == want
    assert max(seen) <= pool + 1
    assert np.allclose(picks.rows, x[picks.ids // 7])


def test_draws_do_not_depend_on_partitioning():
    ids = np.arange(20_000)
    z = kp.normals(ids, 3, 4)
    assert np.array_equal(z[500:600], kp.normals(ids[500:600], 3, 4))
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01
    assert abs(np.corrcoef(z.T)[0, 1]) < 0.03


class _Counted:
    """A covariance that is zero from 6 on and remembers how many entries were asked for."""

    reach = 6.0

    def __init__(self, counter):
        self.counter = counter

    def __call__(self, a, b):
        self.counter.add(len(a) * len(b))
        return np.maximum(1 - sl.distance_matrix(a, b) / self.reach, 0.0) ** 2


def test_product_within_a_reach_leaves_far_tiles_out(spark):
    import pyspark.cloudpickle as cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    entries = []
    for length in (200, 400):
        x = np.array([(y, c) for y in range(length) for c in range(5)], float)
        v = np.random.default_rng(1).normal(size=(len(x), 3))
        vectors = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, v))], "id long, x array<double>, v array<double>")
        kernel = _Counted(spark.sparkContext.accumulator(0))
        got = kp.kernel_product(vectors.select("id", "x"), vectors, kernel, len(x), 3, 4, kernel.reach).orderBy("id").collect()
        dense = np.maximum(1 - sl.distance_matrix(x, x) / 6.0, 0.0) ** 2
        assert [r["id"] for r in got] == list(range(len(x))) and np.allclose([r["y"] for r in got], dense @ v)
        entries.append(kernel.counter.value)
    assert entries[1] < 2.2 * entries[0]


def test_a_covariance_is_zero_from_its_reach_on():
    for kernel in (sl.RadialKernel(kn.rbf, ls=3.0), sl.RadialKernel(kn.matern, nu=0.5, ls=2.0), sl.RadialKernel(kn.matern, nu=1.5, ls=3.0),
                   sl.RadialKernel(kn.matern, nu=2.5, ls=0.7), sl.RadialKernel(kn.multiscale, ls=2.0)):
        at = np.array([[0.0, 0.0]])
        assert kernel(at, np.array([[kernel.reach, 0.0]]))[0, 0] == 0.0 < kernel(at, np.array([[kernel.reach * 0.5, 0.0]]))[0, 0]
