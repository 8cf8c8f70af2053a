"""Operators against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import kernels as kn
from fieldloom.functions import quantisers as qz
from fieldloom.operators import fronts as fr
from fieldloom.operators.lorenzo import with_lorenzo
from fieldloom.operators.metrics import ssim_windowed
from fieldloom.operators.ordered import previous_in_order
from fieldloom.operators.quantiles import exact_quantiles
from fieldloom.operators.ratedist import Predictor, sweep
from fieldloom.operators.search import search_bound
from fieldloom.operators.spectra import autocorrelation
from fieldloom.sources.grid import with_location_mean


def cube(spark, nl=3, ny=9, seed=1, drop=0.1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(nl, ny, 10))
    keep = rng.random(v.shape) > drop
    rows = [(l, y * 10 + x, y, x, float(v[l, y, x])) for l, y, x in np.argwhere(keep).tolist()]
    return np.where(keep, v, 0.0), keep, spark.createDataFrame(rows, "level long, loc long, y long, x long, value double")


@pytest.mark.parametrize("dist", ["normal", "ties", "outlier"])
def test_exact_quantiles_large(spark, dist):
    rng = np.random.default_rng(0)
    v = {"normal": rng.normal(size=60_000), "ties": rng.integers(0, 7, 60_000).astype(float),
         "outlier": np.append(rng.normal(size=59_999), 1e12)}[dist]
    g = rng.integers(0, 2, v.size)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v}))
    probs = [0.0, 0.005, 0.25, 0.5, 0.995, 1.0]
    got = {(r["g"], r["p"]): r["q"] for r in exact_quantiles(df, "v", probs, ["g"]).collect()}
    for k in (0, 1):
        for p in probs:
            assert got[(k, p)] == pytest.approx(np.quantile(v[g == k], p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("tile", [20, 40, 4000])
def test_lorenzo_any_tile(spark, tile, monkeypatch):
    import fieldloom.operators.neighbours as nb

    v, keep, df = cube(spark)
    pad = np.pad(v, ((1, 0), (1, 0), (1, 0)))
    p3 = (pad[1:, 1:, :-1] + pad[1:, :-1, 1:] + pad[:-1, 1:, 1:] - pad[1:, :-1, :-1] - pad[:-1, 1:, :-1]
          - pad[:-1, :-1, 1:] + pad[:-1, :-1, :-1])
    monkeypatch.setattr(nb.with_stencil, "__defaults__", (tile,))
    for r in with_lorenzo(df).collect():
        assert r["lorenzo_3d"] == pytest.approx(p3[r["level"], r["y"], r["x"]])
    assert with_lorenzo(df).count() == keep.sum()


def test_ordered_operators_with_gaps(spark):
    rng = np.random.default_rng(2)
    keys = np.sort(rng.choice(5000, 300, replace=False))
    vals = rng.normal(size=300)
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(keys, vals)], "idx long, value double")
    got = previous_in_order(df, "idx", "value", "prev", 13).orderBy("idx").toPandas()["prev"].to_numpy()
    assert np.isnan(got[0]) and np.allclose(got[1:], vals[:-1])


def test_autocorrelation_matches_fft(spark):
    v, keep, df = cube(spark, nl=1, ny=12, drop=0.0)
    f = v[0] - v[0].mean()
    spec = np.fft.rfft2(f, s=(2 * 12, 20))
    full = np.fft.irfft2(spec * np.conj(spec), s=(24, 20))
    full = full / full[0, 0]
    for r in autocorrelation(df, "value", 3).collect():
        assert r["ac"] == pytest.approx(full[r["dy"], r["dx"]], abs=1e-9)


def test_ssim_windows(spark):
    v, keep, df = cube(spark, nl=1, ny=11, drop=0.0)
    pred = v[0] * 0.8 + 0.1
    df = df.withColumn("p", F.col("value") * 0.8 + 0.1)
    span = float(np.ptp(v[0]))
    out = []
    for y in range(3, 8):
        for x in range(3, 7):
            a, b = v[0][y - 3:y + 4, x - 3:x + 4].ravel(), pred[y - 3:y + 4, x - 3:x + 4].ravel()
            c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
            cov = np.cov(a, b)
            out.append((2 * a.mean() * b.mean() + c1) * (2 * cov[0, 1] + c2)
                       / ((a.mean() ** 2 + b.mean() ** 2 + c1) * (cov[0, 0] + cov[1, 1] + c2)))
    got = ssim_windowed(df, "value", "p", 11, F.lit(span)).first()
    assert got["n_windows"] == len(out) and got["ssim"] == pytest.approx(np.mean(out))


def test_quantisers(spark):
    vals = [0.0, -0.0, 0.49, 0.5, 1.5, 2.5, -2.5, 127.0, 128.0, 1e12, -1e12]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    rows = df.select(
        "v", qz.range_bin(F.col("v"), 128.0, 256, "zero").alias("z"), qz.range_bin(F.col("v"), 128.0, 256, "clip").alias("c"),
        qz.range_dequantise(F.col("v"), 128.0, 256).alias("d"), qz.error_bin(F.col("v"), F.lit(0.5)).alias("e"),
    ).collect()
    got = {r["v"]: r for r in rows}
    assert [got[v]["e"] for v in (0.5, 1.5, 2.5, -2.5)] == [0, 2, 2, -2]  # half to even
    assert got[1e12]["z"] == 0 and got[1e12]["c"] == 127 and got[-1e12]["c"] == -127
    assert got[1e12]["d"] == float(np.float32(1e12))
    assert got[1e12]["e"] == 10**12
    with pytest.raises(ValueError):
        qz.range_bin(F.col("v"), 1.0, 2, "other")


def test_error_bound_holds(spark):
    _, _, df = cube(spark)
    r = sweep(df, "value", [Predictor("zero", 0, F.lit(0.0))], [0.01, 0.1])
    assert all(x["rmse"] <= x["abs_bound"] for x in r.collect())


def test_kernels_agree_between_column_and_numpy(spark):
    d = np.linspace(0, 4, 9)
    df = spark.createDataFrame([(float(x),) for x in d], "r double")
    for name in kn.KERNELS:
        got = [x[0] for x in df.select(kn.kernel(name)(F.col("r"), ls=1.3)).collect()]
        assert np.allclose(got, kn.kernel(name)(d, ls=1.3, m=np))
    with pytest.raises(ValueError):
        kn.matern(d, 2.0, m=np)
    with pytest.raises(ValueError):
        kn.kernel("cubic")


RESULTS = [("m", 1, 1.0, 4.0, 50.0), ("m", 1, 2.0, 6.0, 45.0), ("m", 1, 4.0, 5.0, 40.0), ("m", 1, 8.0, 9.0, 40.0)]


def test_fronts(spark):
    r = spark.createDataFrame(RESULTS, "method string, k long, abs_bound double, cr double, psnr double")
    bounds = lambda df: sorted(x["abs_bound"] for x in df.collect())
    assert bounds(fr.running_max_by_cr(r)) == [1.0]
    assert bounds(fr.pareto_front(r)) == [1.0, 2.0, 8.0]
    # loose to tight: 9, 5, then 6 rises -> cut
    assert bounds(fr.trim_after_reversal(r)) == [4.0, 8.0]
    assert bounds(fr.keep_rising(r)) == [1.0, 2.0, 8.0]
    assert fr.nearest_ratio(r, 5.5).first()["abs_bound"] in (2.0, 4.0)
    assert fr.middle_row(r).first()["abs_bound"] == 4.0


def test_bound_search_reaches_ratio(spark):
    _, _, df = cube(spark, nl=4, ny=30)
    got = search_bound(df, "value", Predictor("zero", 0, F.lit(0.0)), 5.0, 1e-3, 10.0).first()
    assert got["cr"] == pytest.approx(5.0, rel=0.1)


def test_equal_locations_have_equal_residuals(spark):
    values = [0.1, 0.2, 0.3]
    rows = [(i, 0, v) for i, v in enumerate(values)] + [(i, 1, v) for i, v in reversed(list(enumerate(values)))]
    cells = spark.createDataFrame(rows, "level bigint, loc bigint, value double").coalesce(1)
    got = {(r["loc"], r["level"]): r["resid"] for r in with_location_mean(cells).collect()}
    assert [got[0, i] for i in range(3)] == [got[1, i] for i in range(3)]
