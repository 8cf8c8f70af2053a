"""The Lorenzo codec decoded from bins alone, and stencils on grids of any width."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators.lorenzo import decode_volume_bins, encode_volume, with_lorenzo
from fieldloom.operators.metrics import ssim_windowed
from fieldloom.operators.spectra import autocorrelation
from fieldloom.sources.rawf32 import read_volume


def volume(spark, tmp_path, shape):
    v = np.random.default_rng(4).normal(scale=50, size=shape).cumsum(-1).astype("<f4")
    v.tofile(tmp_path / "v.f32")
    df = read_volume(spark, str(tmp_path / "v.f32"), shape)
    return v.astype(float), df.withColumn("value", F.col("value").cast("double"))


def array_of(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.select("level", "y", "x", column).collect():
        out[r[0], r[1], r[2]] = r[3]
    return out


@pytest.mark.parametrize("nx", [10, 25, 500])
def test_lorenzo_and_ssim_from_file(spark, tmp_path, nx):
    shape = (2, 9, nx)
    v, df = volume(spark, tmp_path, shape)
    got = with_lorenzo(df, "value", nx)
    p = np.pad(v, ((1, 0), (1, 0), (1, 0)))
    plane = p[1:, 1:, :-1] + p[1:, :-1, 1:] - p[1:, :-1, :-1]
    below = p[:-1, 1:, 1:] - p[:-1, 1:, :-1] - p[:-1, :-1, 1:] + p[:-1, :-1, :-1]
    assert np.allclose(array_of(got, "lorenzo_2d", shape), plane)
    assert np.allclose(array_of(got, "lorenzo_3d", shape), plane + below)
    rows = ssim_windowed(df.withColumn("p", F.col("value") * 0.9), "value", "p", 9, F.lit(float(np.ptp(v))), nx).collect()
    assert {r["n_windows"] for r in rows} == {(nx - 6) * 3}


def test_autocorrelation_on_a_wide_grid(spark, tmp_path):
    v, df = volume(spark, tmp_path, (1, 8, 25))
    f = v[0] - v[0].mean()
    spec = np.fft.rfft2(f, s=(16, 50))
    full = np.fft.irfft2(spec * np.conj(spec), s=(16, 50))
    for r in autocorrelation(df, "value", 2, nx=25).collect():
        assert r["ac"] == pytest.approx(full[r["dy"], r["dx"]] / full[0, 0], abs=1e-9)


@pytest.mark.parametrize("dims", [1, 2, 3])
@pytest.mark.parametrize("eb", [0.5, 40.0])
def test_decode_from_bins_alone(spark, tmp_path, dims, eb):
    shape = (3, 7, 25)
    v, df = volume(spark, tmp_path, shape)
    gappy = df.where((F.col("x") * 7 + F.col("y") * 3 + F.col("level")) % 11 != 0)
    bins = encode_volume(gappy, 3, 7 * 25, 25, dims, eb)
    code = array_of(bins, "bin", shape)
    assert not np.isnan(code).any()
    # in numpy, from the bins alone
    for axis in {1: [0], 2: [2, 1], 3: [2, 1, 0]}[dims]:
        code = code.cumsum(axis)
    decoded = array_of(decode_volume_bins(bins, dims, eb), "decoded", shape)
    assert np.array_equal(decoded, code * 2 * eb)
    keep = array_of(gappy, "value", shape)
    here = ~np.isnan(keep)
    assert np.abs(decoded - v)[here].max() <= eb * (1 + 1e-9) and (decoded[~here] == 0).all()


def test_model_keeps_its_covariance(spark, tmp_path):
    from fieldloom.functions import kernels as kn
    from fieldloom.operators import codecs as cd
    from fieldloom.operators import selection as sl

    kernel = sl.RadialKernel(kn.matern, nu=2.5, ls=7.0)
    name, numbers = sl.described(kernel)
    a, b = np.random.default_rng(1).normal(size=(2, 5, 2))
    assert np.array_equal(sl.restored(name, numbers)(a, b), kernel(a, b))
    with pytest.raises(ValueError):
        sl.described(sl.linear_kernel)


def test_direct_qr_matches_dense(spark):
    from fieldloom.functions import kernels as kn
    from fieldloom.operators import kernelproduct as kp
    from fieldloom.operators import selection as sl

    x = np.random.default_rng(2).uniform(0, 10, size=(40, 2))
    kernel = sl.RadialKernel(kn.matern, nu=1.5, ls=2.0)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    left, want = kernel(x, x), []
    for _ in range(6):  # column-pivoted QR by Gram-Schmidt
        j = int(np.argmax(np.round((left**2).sum(0), 9)))
        want.append(j)
        q = left[:, j] / np.linalg.norm(left[:, j])
        left = left - np.outer(q, q @ left)
    assert kp.direct_qr(points, kernel, 6).ids.tolist() == want


def test_constant_location_keeps_its_mean(spark):
    from fieldloom.functions import kernels as kn
    from fieldloom.operators import predict as pr
    from fieldloom.operators import selection as sl

    rows = [(k, 0.0, float(k), [0.0, 0.0] if k == 2 else [1.0 + k, -1.0 - k]) for k in range(5)]
    prof = spark.createDataFrame(rows, "loc long, y double, x double, vec array<double>")
    kernel = sl.RadialKernel(kn.matern, nu=1.5, ls=3.0)
    out = pr.kriging(prof, np.array([[0.0, 0.0], [0.0, 4.0]]), np.array([[1.0, -1.0], [5.0, -5.0]]), kernel, 1e-6)
    got = {r["loc"]: r["pred"] for r in out.collect()}
    assert got[2] == [0.0, 0.0] and abs(got[3][0]) > 0.1


def test_sweep_store_that_cannot_be_read(spark, sf, tmp_path):
    from fieldloom.__main__ import sweep

    (tmp_path / "rows").mkdir()
    (tmp_path / "rows" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        sweep(spark, sf, str(tmp_path), ["no_such_runner"])


def test_absent_reading_keeps_the_others_in_place(spark):
    from fieldloom.operators import codecs as cd

    table = spark.createDataFrame([(i, 10.0 * i, 1.0) for i in range(6)], "loc long, mu double, sd double")
    model = cd.Model("deim", table, np.array([4, 1, 3]), np.zeros((3, 2)), np.eye(3), 2, 6)
    cells = spark.createDataFrame([(0, 4, 41.0), (0, 1, 12.0), (0, 3, 33.0), (1, 4, 45.0), (1, 3, 36.0)], "level long, loc long, value double")
    got = {r["level"]: np.frombuffer(r["blob"][8:], "<f4").tolist() for r in cd.encode_cells(model, cells).collect()}
    assert got == {0: [1.0, 2.0, 3.0], 1: [5.0, 0.0, 6.0]}


def test_training_mean_centres_the_basis(spark):
    from fieldloom.operators import codecs as cd

    v = np.random.default_rng(3).normal(size=(12, 5)) + 20
    mu = v.mean(1)
    rows = [(i, 0, i, float(mu[i]), 1.0, (v[i] - mu[i]).tolist()) for i in range(12)]
    prof = spark.createDataFrame(rows, "loc long, y long, x long, mu double, sd double, vec array<double>")
    model = cd.fit_deim(prof, 5, 12, 2, np.array([0, 2, 3]))
    got = {r["loc"]: r["mu"] for r in model.table.collect()}
    assert np.allclose([got[i] for i in range(12)], v[:, [0, 2, 3]].mean(1))


def test_round_trips_read_the_field_once(spark, monkeypatch):
    from fieldloom.plans import quantise

    plans = []

    def stop(cells, *rest):
        plans.append(cells._jdf.queryExecution().toString())
        raise StopIteration

    monkeypatch.setattr(quantise, "encode_volume", stop)
    with pytest.raises(StopIteration):
        quantise.q24_codec_round_trip(spark, "/root/testdata/sf0.001")
    assert "parquet" not in plans[0].lower()
