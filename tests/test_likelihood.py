"""Likelihood fits against dense searches, and three-dimensional ordinary Kriging."""

import numpy as np
import pytest

from fieldloom.functions import kernels as kn
from fieldloom.operators import decompose as dc
from fieldloom.operators import likelihood as lk
from fieldloom.operators import selection as sl
from fieldloom.operators import variogram as vg


def sample(n=60, d=2, m=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 10, size=(n, d))
    k = kn.matern(sl.distance_matrix(x, x), 1.5, 2.0, 1.7, m=np) + 0.05 * np.eye(n)
    return x, np.linalg.cholesky(k) @ rng.normal(size=(n, m))


def objectives():
    x, y = sample()
    x3, y3 = sample(40, 3, 1, 2)
    b = np.array([[1.0, 0.4], [0.4, 0.8]])
    fields = np.stack([y.T, 0.5 * y.T + 0.1], axis=2)
    return {
        "planar": (lk.Isotropic(x, y, 1.5), [0.5, 0.3, -2.0]), "fixed": (lk.Isotropic(x, y, 2.5, 1e-2), [0.4, 0.1]),
        "half": (lk.Isotropic(x, y, 0.5), [0.5, 0.3, -2.0]), "volume": (lk.Anisotropic(x3, y3), [0.2, 0.6, 0.1, -2.0]),
        "scale": (lk.LengthScale(x, y, 1.5, 1e-2), [0.7]), "fields": (lk.Coregional(x, fields, b, 1.5, 1e-2), [0.6]),
    }


@pytest.mark.parametrize("name", list(objectives()))
def test_gradients(name):
    fn, theta = objectives()[name]
    theta = np.array(theta)
    _, g = fn(theta)
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-5
        assert g[i] == pytest.approx((fn(theta + step)[0] - fn(theta - step)[0]) / 2e-5, rel=1e-5, abs=1e-6)


def test_values_equal_the_plain_likelihoods():
    x, y = sample()
    theta = np.log([1.3, 0.8, 0.1])
    cov = kn.matern(sl.distance_matrix(x, x), 1.5, 1.3, 0.8, m=np) + 0.1 * np.eye(len(x))
    assert lk.Isotropic(x, y, 1.5)(theta)[0] == pytest.approx(dc.gp_nll(cov, y), rel=1e-6)
    b = np.array([[1.0, 0.4], [0.4, 0.8]])
    lam, q = np.linalg.eigh(b)
    fields = np.stack([y.T, y.T * 0.5], axis=2)
    cov = kn.matern(sl.distance_matrix(x, x), 1.5, 1.3, m=np)
    assert lk.Coregional(x, fields, b, 1.5, 0.01)(theta[:1])[0] == pytest.approx(dc.lmc_nll(lam, q, cov, fields, 0.01), rel=1e-6)


def test_fits_reach_the_dense_optimum(spark):
    x, y = sample()
    fn = lk.Isotropic(x, y, 1.5)
    bounds = [(-2.3, 6.9), (-4.6, 9.2), (-13.8, 2.3)]
    found = lk.fit(spark, fn, bounds, 4)
    best = min((fn(np.array([a, b, c]))[0], a, b, c) for a in np.linspace(0, 1.5, 13) for b in np.linspace(-0.5, 1.5, 13) for c in np.linspace(-5, -1, 13))
    assert found.value <= best[0] + 1e-9
    for i in range(3):  # no better value around it
        for sign in (-1e-3, 1e-3):
            other = found.theta.copy()
            other[i] += sign
            assert fn(other)[0] >= found.value - 1e-9
    assert len(found.runs) == 4 and found.runs["nll"].min() == pytest.approx(found.value)
    one = lk.fit(spark, lk.LengthScale(x, y, 1.5, 1e-2), [(-2.3, 4.6)], 3)
    grid = np.linspace(-2.3, 4.6, 70_001)[::10]
    dense = grid[int(np.argmin([lk.LengthScale(x[:30], y[:30], 1.5, 1e-2)(np.array([g]))[0] for g in grid[::50]])) * 50]
    half = lk.fit(spark, lk.LengthScale(x[:30], y[:30], 1.5, 1e-2), [(-2.3, 4.6)], 3)
    assert abs(half.theta[0] - dense) < 0.06 and one.value < lk.LengthScale(x, y, 1.5, 1e-2)(np.array([1.5]))[0]


def test_a_bound_can_be_the_optimum():
    def slope(t):
        return float(t @ t - 6 * t[0] - t[1]), 2 * t - np.array([6.0, 1.0])

    at, value, _ = lk.minimise(slope, np.array([-1.0, -1.0]), np.array([-2.0, -2.0]), np.array([1.0, 4.0]))
    assert np.allclose(at, [1.0, 0.5], atol=1e-6)


def test_ordinary_kriging_equals_dense_and_keeps_axes_apart(spark):
    rng = np.random.default_rng(3)
    pts = np.array([(lv, y, x) for lv in range(5) for y in range(5) for x in range(4)])
    v = np.sin(pts[:, 0]) + 0.3 * pts[:, 1] + rng.normal(size=100) * 0.1
    rows = [(int(a), int(b * 10 + c), int(b), int(c), float(z)) for (a, b, c), z in zip(pts, v)]
    df = spark.createDataFrame(rows, "level long, loc long, y long, x long, v double")
    scales = (0.5, 2.0, 1.0)
    s = pts / np.array(scales)
    lags = {r["lag"]: (r["n"], r["distance"], r["gamma"]) for r in vg.semivariogram(df, "v", 2.5, 5, scales).collect()}
    d = np.sqrt(((s[:, None] - s[None]) ** 2).sum(-1))
    i, j = np.triu_indices(100, 1)
    near = d[i, j] <= 2.5
    i, j, h = i[near], j[near], d[i, j][near]
    bins = np.clip(np.ceil(h / 0.5).astype(int) - 1, 0, 4)
    for b in np.unique(bins):
        m = bins == b
        assert lags[b] == (m.sum(), pytest.approx(h[m].mean()), pytest.approx((0.5 * (v[i] - v[j])[m] ** 2).mean()))
    assert lags.keys() == set(np.unique(bins).tolist())

    model = vg.Spherical(3.0, 1.5, 0.2)
    pick = rng.choice(100, 12, replace=False)
    out = vg.ordinary_kriging(df, "v", pts[pick].astype(float), v[pick], model, scales).orderBy("level", "loc").toPandas()
    order = np.lexsort((pts[:, 1] * 10 + pts[:, 2], pts[:, 0]))
    gamma = lambda h: np.where(h > 0, 0.2 + 1.5 * np.where(h < 3, 1.5 * h / 3 - 0.5 * (h / 3) ** 3, 1.0), 0.0)
    a = np.block([[gamma(d[np.ix_(pick, pick)]), np.ones((12, 1))], [np.ones((1, 12)), np.zeros((1, 1))]])
    rhs = np.vstack([gamma(d[pick]), np.ones((1, 100))])
    w = np.linalg.solve(a, rhs)
    assert np.allclose(out["pred"], (w[:12].T @ v[pick])[order]) and np.allclose(out["var"], np.maximum((w * rhs).sum(0), 0)[order])
    weights, _ = vg.kriging_weights(s, s[pick], model)
    assert np.allclose(weights.sum(1), 1.0)
    assert np.allclose(out["pred"].to_numpy()[np.isin(order, pick)], v[order][np.isin(order, pick)])


def test_spherical_fit_recovers_its_parameters(spark):
    h = np.linspace(0.4, 5, 9)
    true = vg.Spherical(3.3, 2.1, 0.4)
    lags = spark.createDataFrame([(k, 100 + k, float(x), float(g)) for k, (x, g) in enumerate(zip(h, true(h)))], "lag long, n long, distance double, gamma double")
    got, misfit = vg.fit_spherical(lags)
    assert misfit < 1e-6 and got.reach == pytest.approx(3.3, rel=1e-3) and got.sill == pytest.approx(2.1, rel=1e-3)


def test_every_start_has_a_task_of_its_own(spark):
    def where(theta):
        from pyspark import TaskContext

        return float(TaskContext.get().partitionId()), np.zeros(len(theta))

    found = lk.fit(spark, where, [(-1.0, 1.0)], 4)
    assert sorted(found.runs["nll"]) == [0.0, 1.0, 2.0, 3.0]


def test_rejected_steps_need_no_gradient():
    asked = []

    class Steep:
        def at(self, theta):
            value = float(np.cosh(3 * theta[0]) + (theta[1] - 0.5) ** 2)
            asked.append(False)

            def gradient():
                asked[-1] = True
                return np.array([3 * np.sinh(3 * theta[0]), 2 * (theta[1] - 0.5)])

            return value, gradient

    at, _, calls = lk.minimise(Steep(), np.array([1.5, -1.0]), np.array([-2.0, -2.0]), np.array([2.0, 2.0]))
    assert np.allclose(at, [0.0, 0.5], atol=1e-5) and calls == len(asked) and not all(asked)


@pytest.mark.parametrize("begin", [[2.3, 5.0, -10.5], [2.3, 0.0, -5.75], [6.0, -4.0, -13.0]])
def test_a_search_leaves_an_exploding_misfit_in_few_evaluations(begin):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, size=(150, 2)).astype(float)  # places repeat, their values do not
    fn = lk.Isotropic(x, rng.normal(size=150), 2.5)
    low, high = np.array([-2.3, -5.0, -13.8]), np.array([6.9, 5.0, 2.3])
    at, value, calls = lk.minimise(fn, np.array(begin), low, high)
    g = fn(at)[1]
    held = ((at <= low) & (g > 0)) | ((at >= high) & (g < 0))
    assert calls <= 100 and np.abs(np.where(held, 0.0, g)).max() < 1e-3 * abs(value)
