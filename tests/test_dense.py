"""Selection, fits and prediction against dense numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import kernels as kn
from fieldloom.operators import codecs as cd
from fieldloom.operators import decompose as dc
from fieldloom.operators import predict as pr
from fieldloom.operators import progressive as pg
from fieldloom.operators import selection as sl
from fieldloom.sources.profiles import collect_matrix

K = sl.RadialKernel(kn.matern, nu=2.5, ls=2.0)


@pytest.fixture(scope="module")
def field(spark):
    """Profiles of 120 locations x 6 levels of a smooth field."""
    rng = np.random.default_rng(3)
    loc = np.arange(120)
    y, x = loc // 10, loc % 10
    vec = np.stack([np.sin(x / 3 + l / 4) * np.cos(y / 4) + 0.05 * rng.normal(size=120) for l in range(6)], 1)
    vec -= vec.mean(1, keepdims=True)
    pdf = pd.DataFrame({"loc": loc, "y": y, "x": x, "n_obs_levels": 6, "mu": 1.0, "sd": vec.std(1), "vec": list(vec)})
    df = spark.createDataFrame(pdf, "loc long, y long, x long, n_obs_levels long, mu double, sd double, vec array<double>")
    return vec, np.column_stack([y, x]).astype(float), df.repartition(5).cache()


def points(df):
    return df.select(F.col("loc").alias("id"), F.array(F.col("y").cast("double"), F.col("x").cast("double")).alias("x"))


def dense_pivots(cov, k):
    d, f, out = np.diag(cov).copy(), np.zeros((len(cov), 0)), []
    for _ in range(k):
        j = int(np.argmax(np.round(d, 9)))
        col = (cov[:, j] - f @ f[j]) / np.sqrt(d[j])
        f, d = np.column_stack([f, col]), d - col**2
        out.append(j)
    return out


@pytest.mark.parametrize("pool", [4, 30, 500])
def test_greedy_pivots_any_pool(field, pool):
    _, xy, df = field
    got = sl.greedy_select(points(df), sl.CholeskyScore(K), 15, pool).ids.tolist()
    assert got == dense_pivots(K(xy, xy), 15)


def test_later_passes_score_what_may_still_win(spark, monkeypatch):
    """From the third pass on, points that were already below the best score left are not scored again."""
    x = np.random.default_rng(4).normal(size=(300, 12)) * np.exp(-np.arange(300) / 30)[:, None]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    sizes, scored = [], sl._scored
    monkeypatch.setattr(sl, "_scored", lambda p, scorer: (sizes.append(p.count()), scored(p, scorer))[1])
    got = sl.greedy_select(df, sl.CholeskyScore(sl.linear_kernel), 8, 4)
    assert got.ids.tolist() == dense_pivots(x @ x.T, 8)
    assert sizes[:2] == [300, 300] and len(sizes) > 2 and max(sizes[2:]) < 100


def test_grouped_greedy(field):
    _, xy, df = field
    g = (xy[:, 0] >= 6).astype(int)
    pts = points(df).withColumn("g", F.when(F.col("x")[0] >= 6, 1).otherwise(0).cast("bigint"))
    got = sl.greedy_select_by(pts, "g", {0: sl.CholeskyScore(K), 1: sl.CholeskyScore(K)}, 8, 8)
    for grp in (0, 1):
        own = np.flatnonzero(g == grp)
        assert got[grp].ids.tolist() == own[dense_pivots(K(xy[own], xy[own]), 8)].tolist()


def test_farthest_points(field):
    _, xy, df = field
    want, d = [0], sl.distance_matrix(xy, xy[:1])[:, 0]
    for _ in range(9):
        j = int(np.argmax(np.round(d, 9)))
        want.append(j)
        d = np.minimum(d, sl.distance_matrix(xy, xy[j : j + 1])[:, 0])
    assert sl.greedy_select(points(df), sl.DistanceScore(), 10, 7).ids.tolist() == want


def test_qdeim_is_pivoted_qr(field):
    vec, _, df = field
    basis = dc.svd_basis(df, 6, 4)
    modes = vec @ basis.v / basis.s
    assert np.allclose(basis.s, np.linalg.svd(vec, compute_uv=False)[:4])
    picks = sl.qdeim(dc.spatial_modes(df, basis, 4), 4)
    r, want = modes.copy(), []
    for _ in range(4):
        j = int(np.argmax(np.round((r * r).sum(1), 9)))
        want.append(j)
        q = r[j] / np.linalg.norm(r[j])
        r = r - np.outer(r @ q, q)
    assert picks.ids.tolist() == want
    out = pr.cells_of(pr.deim_reconstruct_basis(df, basis.v, basis.s, picks.rows, pr.readings_at(df, picks.ids))).toPandas()
    ref = modes @ np.linalg.solve(modes[want], vec[want])
    assert np.allclose(out.sort_values(["loc", "level"])["pred"], ref.ravel())
    at = out[out["loc"].isin(want)]
    assert np.abs(at["resid"] - at["pred"]).max() < 1e-9


def test_random_pivots_follow_the_variance(spark):
    """First pick uniform; second pick avoids the neighbourhood of the first."""
    xy = np.array([[0.0, 0.0], [0.0, 0.01], [50.0, 50.0]])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(xy)], "id long, x array<double>")
    for seed in range(6):
        ids = sl.random_select(df, sl.CholeskyScore(sl.RadialKernel(kn.rbf, ls=1.0)), 2, seed).ids
        assert 2 in ids and len(set(ids)) == 2
    small = sl.random_select(df, sl.CholeskyScore(sl.RadialKernel(kn.rbf, ls=1.0)), 2, 1, pool=1).ids
    assert len(set(small)) == 2


def test_gks_contains_no_repeats(field):
    _, _, df = field
    for mode in ("random", "greedy"):
        ids = sl.gks(points(df), K, 10, 8, mode, 5).ids
        assert len(set(ids.tolist())) == 10


def test_greedy_error_matches_refit(field):
    vec, xy, df = field
    cand = np.array([[i, *xy[i]] for i in range(0, 120, 7)], dtype=int)
    got = sl.greedy_error(df, 5, cand, K, 1e-2)
    ids = cand[:, 0].tolist()
    want = [ids[0], ids[-1]]
    while len(want) < 5:
        def sse(c):
            s = want + [c]
            w = np.linalg.solve(K(xy[s], xy[s]) + 1e-2 * np.eye(len(s)), vec[s])
            return ((vec - K(xy, xy[s]) @ w) ** 2).sum()
        want.append(min((c for c in ids if c not in want), key=sse))
    assert got == want


def test_randomised_basis(field):
    _, _, df = field
    exact, rough = dc.svd_basis(df, 6, 3), dc.randomised_basis(df, 6, 3, 3, 2)
    assert np.allclose(exact.s, rough.s)


def test_kriging_variants_match_dense(field):
    vec, xy, df = field
    ids = np.array([3, 40, 77, 110])
    s = xy[ids]
    out = pr.kriging(df, s, vec[ids], K, 1e-3, lambda x: np.ones((len(x), 1))).toPandas().sort_values("loc")
    inv = np.linalg.inv(K(s, s) + 1e-3 * np.eye(4))
    one = np.ones((4, 1))
    beta = (one.T @ inv @ vec[ids]) / (one.T @ inv @ one)
    assert np.allclose(np.stack(out["pred"]), beta + K(xy, s) @ inv @ (vec[ids] - beta))
    full = pr.local_kriging(
        df.select(F.lit(0).cast("bigint").alias("level"), "loc", "y", "x", F.col("vec")[0].alias("v")),
        ["y", "x"], "v", s, vec[ids][:, 0], K, 1e-3, 4,
    ).toPandas().sort_values("loc")
    inv2 = np.linalg.inv(K(s, s) + (1e-3 + 1e-6) * np.eye(4))
    assert np.allclose(full["pred"], K(xy, s) @ inv2 @ vec[ids][:, 0])


def test_kronecker_matches_dense(field):
    vec, xy, df = field
    ids, levels = np.array([5, 60, 100]), np.array([0, 3, 5])
    kz = sl.RadialKernel(kn.matern, nu=1.5, ls=3.0)
    got = pr.kronecker_kriging(df, 6, levels, xy[ids], vec[ids][:, levels].T, kz, K, 1.3, 1e-2).toPandas().sort_values("loc")
    z = np.arange(6.0)[:, None]
    cov = 1.3 * np.kron(kz(z[levels], z[levels]), K(xy[ids], xy[ids])) + 1e-2 * np.eye(9)
    alpha = np.linalg.solve(cov, vec[ids][:, levels].T.ravel())
    ref = (1.3 * np.kron(kz(z, z[levels]), K(xy, xy[ids])) @ alpha).reshape(6, 120).T
    assert np.allclose(np.stack(got["pred"]), ref)


def test_coregional_matches_dense(field):
    vec, xy, df = field
    b = np.array([[1.0, 0.4], [0.4, 1.0]])
    ids = np.array([5, 60, 100])
    y = np.stack([vec[ids], -vec[ids]])
    got = pr.coregional_kriging(df, ["a", "b"], xy[ids], y, b, K, 1e-2).toPandas().sort_values("loc")
    alpha = np.linalg.solve(np.kron(b, K(xy[ids], xy[ids])) + 1e-2 * np.eye(6), y.reshape(6, -1))
    ref = np.kron(b, K(xy, xy[ids])) @ alpha
    assert np.allclose(np.stack(got["pred_a"]), ref[:120]) and np.allclose(np.stack(got["pred_b"]), ref[120:])


def test_fit_improves_on_start(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 5, (60, 1))
    cov = kn.matern(sl.distance_matrix(x, x), 1.5, 1.0, 1.0, m=np)
    y = np.linalg.cholesky(cov + 1e-6 * np.eye(60)) @ rng.normal(size=(60, 20))

    def nll(t):
        return dc.gp_nll(kn.matern(sl.distance_matrix(x, x), 1.5, float(np.exp(t[0])), 1.0, m=np) + 1e-4 * np.eye(60), y)

    best, value, start = dc.fit_by_zoom(spark, nll, [(-3.0, 4.0)], 9, 4)
    assert value < start and 0.5 < np.exp(best[0]) < 2.0


def test_codec_round_trip_and_model_files(spark, field, tmp_path):
    vec, _, df = field
    model = cd.fit_deim(df, 6, 120, 3)
    cd.save_model(model, str(tmp_path / "m"))
    again = cd.load_model(spark, str(tmp_path / "m"))
    blobs = cd.encode(again, df)
    assert {len(r["blob"]) for r in blobs.collect()} == {8 + 4 * 3}
    out = pr.cells_of(cd.decode(again, blobs)).toPandas()
    assert np.sqrt(((out["resid"] - out["pred"]) ** 2).mean()) < 0.6 * vec.std()
    krige = cd.fit_kriging(df, 6, 120, 20)
    out = pr.cells_of(cd.decode(krige, cd.encode(krige, df))).toPandas()
    assert np.sqrt(((out["resid"] - out["pred"]) ** 2).mean()) < 0.6 * vec.std()


def cells(df):
    return df.select("loc", "y", "x", F.posexplode("vec").alias("level", "v")).withColumn("level", F.col("level").cast("bigint"))


@pytest.mark.parametrize("scope,strategy,storage", [
    ("level", "hybrid", "float16"), ("level", "rpgks", "eb_quant"), ("volume", "rpgks", "exact"), ("volume", "worst_fraction", "float32"),
])
def test_progressive_invariants(field, scope, strategy, storage):
    _, _, df = field
    cfg = pg.RoundConfig(accept=0.1, eb=0.01, k_per_round=6, max_rounds=2, scope=scope, strategy=strategy, storage=storage, n_local=8)
    res = pg.run_rounds(cells(df), "v", cfg)
    s = res.state.toPandas()
    assert len(s) == 720
    assert not (s["sensed"].notna() & s["settled"].notna()).any()
    assert (s["settled_err"].abs().dropna() < 0.1).all()
    per_round = 6 * (6 if scope == "level" else 1)
    assert [r["n_sensed"] for r in res.records] == [per_round] * len(res.records)
    assert res.records[-1]["n_left"] == (s["sensed"].isna() & s["settled"].isna()).sum()
    resumed = pg.run_rounds(None, "v", cfg, start=res.state, first_round=3).state.toPandas()
    assert resumed["settled"].notna().sum() >= s["settled"].notna().sum()


def test_progressive_stops_at_target(field):
    _, _, df = field
    cfg = pg.RoundConfig(accept=0.5, eb=0.2, k_per_round=2, max_rounds=5, target_psnr=5.0)
    assert pg.run_rounds(cells(df), "v", cfg).stopped == "quality reached"


@pytest.mark.parametrize("clustered", [False, True])
def test_nearest_is_exact(clustered, monkeypatch):
    rng = np.random.default_rng(1)
    sensors = rng.uniform(0, 100, (900, 3))
    if clustered:
        sensors[:850] = sensors[:850] * 1e-3
    x = rng.uniform(0, 100, (60, 3))
    monkeypatch.setattr(pr, "BRUTE_FORCE", 10)
    near, dist = pr.nearest(x, sensors, 7)
    full = np.sort(sl.distance_matrix(x, sensors), 1)[:, :7]
    assert np.allclose(np.sort(dist, 1), full)
    assert np.allclose(np.take_along_axis(sl.distance_matrix(x, sensors), near, 1), dist)


@pytest.mark.parametrize("count", [24, 70])
def test_rows_of_equal_neighbours_share_a_system(count, monkeypatch):
    """Few sensors have few sets of neighbours: a system is solved for a set, not for a row."""
    rng = np.random.default_rng(3)
    sensors, readings = rng.uniform(0, 1, (count, 3)), rng.normal(size=count)
    x = rng.uniform(0, 1, (4000, 3))
    kernel = sl.RadialKernel(kn.matern, nu=2.5, ls=0.3)
    want, _ = pr.local_solve(x, sensors, readings, kernel, 1e-3, count - 4)
    solved, solve = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: (solved.append(len(a)), solve(a, b))[1])
    got = pr.local_mean(x, sensors, readings, kernel, 1e-3, count - 4)
    assert np.allclose(got, want, rtol=0, atol=1e-9)
    assert sum(solved) < len(x) / 4


def strip(spark, n):
    xy = np.column_stack([np.arange(n) // 4, np.arange(n) % 4]).astype(float)
    rows = [(i, r.tolist()) for i, r in enumerate(xy)]
    return xy, spark.createDataFrame(rows, "id long, x array<double>").repartition(4).cache()


@pytest.mark.parametrize("wide", [0, 1000])
def test_subset_from_coordinates_equals_mode_rows(spark, monkeypatch, wide):
    """Pools of a column subset hold coordinates; the picks are those of QR over the mode rows."""
    monkeypatch.setattr(sl, "WIDE", wide)
    xy, df = strip(spark, 200)
    scorer = sl.CholeskyScore(K)
    pivots = sl.random_select(df, scorer, 16, 5)
    low = np.linalg.cholesky(K(pivots.rows, pivots.rows))
    f = np.linalg.solve(low, K(pivots.rows, xy)).T
    u, _, _ = np.linalg.svd(f, full_matrices=False)
    want = dense_pivots(u[:, :10] @ u[:, :10].T, 10)
    got = sl.greedy_select(df, sl.ModeScore(scorer, sl.low_rank_turn(df, scorer, 10)), 10, 64)
    assert got.ids.tolist() == want
    assert np.array_equal(got.rows, xy[want])


def test_factor_products_of_far_pivots_stay_in_the_tasks(spark, monkeypatch):
    """What the driver gets of the factor's Gram matrix grows with the pivots, not with their square."""
    sent = []

    def counted(ijv, shape):
        sent.append((ijv.count(), shape[0]))
        return collect_matrix(ijv, shape)

    monkeypatch.setattr(sl, "collect_matrix", counted)
    for n in (400, 800):
        _, df = strip(spark, n)
        scorer = sl.CholeskyScore(sl.RadialKernel(kn.matern, nu=1.5, ls=0.5))
        sl.random_select(df, scorer, n // 16, 1)
        sl.low_rank_turn(df, scorer, n // 20)
    (few, r), (more, r2) = sent
    assert r2 == 2 * r and more < 2.6 * few and more < r2 * r2 / 4
