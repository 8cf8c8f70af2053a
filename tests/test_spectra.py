"""Autocorrelation at every lag against direct sums."""

import numpy as np
import pytest

from fieldloom.operators import spectra


def field(spark, v, keep):
    rows = [(lv, y * v.shape[2] + x, float(v[lv, y, x])) for lv, y, x in np.argwhere(keep)]
    return spark.createDataFrame([(int(a), int(b), c) for a, b, c in rows], "level long, loc long, value double")


def direct(f):
    """All lags of one level as {(dy, dx): sum}, by shifting the field over itself."""
    ny, nx = f.shape
    out = {}
    for dy in range(-ny + 1, ny):
        for dx in range(-nx + 1, nx):
            a = f[max(0, -dy):ny - max(0, dy), max(0, -dx):nx - max(0, dx)]
            b = f[max(0, dy):ny + min(0, dy), max(0, dx):nx + min(0, dx)]
            out[dy, dx] = float((a * b).sum())
    return out


@pytest.mark.parametrize("ny, nx", [(7, 10), (4, 25), (3, 500), (1, 12), (9, 1)])
@pytest.mark.parametrize("block", [1 << 20, 64])
def test_every_lag(spark, monkeypatch, ny, nx, block):
    monkeypatch.setattr(spectra, "BLOCK", block)
    rng = np.random.default_rng(ny)
    v = rng.normal(size=(2, ny, nx)).cumsum(axis=2)
    keep = rng.random(v.shape) < 0.8
    keep[:, -1, -1] = True
    got = {(r.level, r.dy, r.dx): r.ac for r in spectra.autocorrelation(field(spark, v, keep), "value", nx=nx).collect()}
    want = {}
    for lv in range(2):
        f = np.where(keep[lv], v[lv] - v[lv][keep[lv]].mean(), 0.0)
        sums = direct(f)
        want |= {(lv, *lag): s / sums[0, 0] for lag, s in sums.items()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_lags_beyond_the_grid_constant_levels_and_profile(spark):
    v = np.ones((2, 3, 4))
    v[1] = np.arange(12).reshape(3, 4)
    df = field(spark, v, np.ones(v.shape, bool))
    ac = spectra.autocorrelation(df, "value", 4, nx=4)
    rows = {(r.level, r.dy, r.dx): r.ac for r in ac.collect()}
    assert len(rows) == 2 * 81
    assert rows[1, 3, 0] == rows[1, 0, 4] == rows[1, -4, -4] == 0.0
    assert all(rows[0, dy, dx] is None for dy in (-1, 0, 1) for dx in (0, 1))
    fold = {r.level: r.efold for r in spectra.e_folding(spectra.radial_profile(ac)).collect()}
    profile = {}
    for (lv, dy, dx), a in rows.items():
        profile.setdefault((lv, int(np.hypot(dy, dx))), []).append(a)
    assert fold == {0: None, 1: min(r for (lv, r), a in profile.items() if lv == 1 and np.mean(a) < np.exp(-1))}


def test_empty(spark):
    none = spark.createDataFrame([], "level long, loc long, value double")
    assert spectra.autocorrelation(none, "value").collect() == []
