"""Fixed-rate coder: the rate is met exactly, and bits alone give the field back."""

import numpy as np
import pytest

from fieldloom.operators import fixedrate as fr


@pytest.mark.parametrize("rate", [1, 4, 8.5, 16, 40])
@pytest.mark.parametrize("kind", ["smooth", "noise", "zero", "spike", "tiny", "huge"])
def test_blocks(rate, kind):
    rng = np.random.default_rng(1)
    i = np.arange(16)
    v = {"smooth": np.sin(i / 5)[None] + np.arange(50)[:, None], "noise": rng.normal(size=(50, 16)), "zero": np.zeros((50, 16)),
         "spike": np.where(i == 3, 1e6, 1e-3)[None].repeat(50, 0), "tiny": rng.normal(size=(50, 16)) * 1e-200, "huge": rng.normal(size=(50, 16)) * 1e200}[kind]
    data = fr.encode_blocks(v, fr.block_bits(rate))
    assert data.shape == (50, fr.block_bits(rate) // 8)
    back = fr.decode_blocks(data)
    scale = np.abs(v).max(1, keepdims=True) + 1e-300
    err = np.abs(back - v) / scale
    if rate >= 40:
        assert err.max() < 1e-7
    if kind == "smooth" and rate >= 8:
        assert err.max() < 2e-3
    if kind == "zero":
        assert not back.any()
    assert err.max() < 4  # even one bit a value keeps the size


def test_errors_fall_with_the_rate():
    v = np.random.default_rng(2).normal(size=(200, 16)).cumsum(1)
    errors = [float(np.sqrt(((fr.decode_blocks(fr.encode_blocks(v, fr.block_bits(r))) - v) ** 2).mean())) for r in (4, 6, 8, 12, 16, 24)]
    assert all(b < a for a, b in zip(errors, errors[1:])) and errors[2] < 0.1 and errors[-1] < 1e-5


def test_field_round_trip(spark):
    rng = np.random.default_rng(3)
    nx, ny = 10, 7
    v = rng.normal(size=(3, ny * nx)).cumsum(1)
    keep = rng.random(v.shape) < 0.9
    rows = [(int(a), int(b), float(v[a, b])) for a, b in np.argwhere(keep)]
    df = spark.createDataFrame(rows, "level long, loc long, value double")
    coded = fr.encode(df, "value", 24, nx)
    assert {len(r["data"]) for r in coded.collect()} == {48} and coded.count() == 3 * 2 * 3
    got = {(r.level, r.loc): r.value for r in fr.decode(coded, nx, ny).collect()}
    assert len(got) == 3 * nx * ny
    assert all(abs(got[a, b] - v[a, b]) < 1e-4 for a, b in np.argwhere(keep))
