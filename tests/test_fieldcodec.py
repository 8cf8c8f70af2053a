"""Several-field and volume codecs and distributed decoding against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import kernels as kn
from fieldloom.operators import codecs as cd
from fieldloom.operators import fieldcodec as fc
from fieldloom.operators import selection as sl
from fieldloom.sources.profiles import profiles

NX, NY, NL = 10, 6, 14


def fields(d, seed=1):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:NY, :NX]
    t = np.arange(NL)[:, None, None]
    base = np.sin(0.5 * x + 0.2 * t) + np.cos(0.4 * y) * (1 + 0.1 * t)
    v = np.stack([base * (i + 1) + 0.05 * rng.normal(size=base.shape) + 3 * i for i in range(d)])
    return v.reshape(d, NL, NY * NX)


def cells(spark, v, names):
    rows = [(int(lv), int(loc), int(loc) // NX, int(loc) % NX, *[float(v[i, lv, loc]) for i in range(len(v))])
            for lv in range(NL) for loc in range(NY * NX)]
    return spark.createDataFrame(rows, "level long, loc long, y long, x long, " + ", ".join(f"{n} double" for n in names))


@pytest.mark.parametrize("d", [2, 3])
def test_fields_equal_dense(spark, tmp_path, d):
    names = ["a", "b", "c"][:d]
    v = fields(d)
    df = cells(spark, v, names)
    frames = {n: profiles(df, NL, n) for n in names}
    model, levels = fc.train_fields(frames, NL, NY * NX, 0.05, cap=6)
    fc.save_fields(model, str(tmp_path / "m"))
    model = fc.load_fields(spark, str(tmp_path / "m"))
    blobs = fc.compress_fields(model, df)
    back = fc.decompress_fields(model, blobs, tile=16).orderBy("level", "loc").toPandas()

    mu, sd = v[:, levels].mean(1), v[:, levels].std(1)
    z = (v[:, levels] - mu[:, None]) / sd[:, None]
    b = np.einsum("iln,jln->ij", z, z) / z[0].size + 1e-6 * np.eye(d)
    assert np.allclose(model.b_matrix, b)
    xy = np.stack([np.arange(NY * NX) // NX, np.arange(NY * NX) % NX], 1).astype(float)
    s = model.sensors
    kernel = model.kernel
    system = np.kron(b, kernel(xy[s], xy[s]) + 1e-6 * np.eye(len(s))) + 0.05**2 * np.eye(d * len(s))
    for lv in range(NL):
        y = ((v[:, lv] - mu) / sd)[:, s].astype("f4").astype(float)
        alpha = np.linalg.solve(system, y.ravel()).reshape(d, -1)
        want = (kernel(xy, xy[s]) @ (b @ alpha).T).T * sd + mu
        got = back[back.level == lv]
        for i, n in enumerate(names):
            assert np.allclose(got[n], want[i], atol=1e-6)
    raw = blobs.where("level = 3").first()["blob"]
    assert np.frombuffer(raw[:12], "<i4").tolist() == [len(s), d, NY * NX] and len(raw) == 12 + 4 * d * len(s)


def test_level_without_readings_and_foreign_blob(spark):
    v = fields(2)
    df = cells(spark, v, ["a", "b"])
    model, _ = fc.train_fields({n: profiles(df, NL, n) for n in ("a", "b")}, NL, NY * NX, cap=3)
    gone = df.where(~((F.col("level") == 5) & F.col("loc").isin(model.sensors.tolist())))
    blobs = fc.compress_fields(model, gone)
    assert blobs.count() == NL
    assert not np.frombuffer(blobs.where("level = 5").first()["blob"][12:], "<f4").any()
    back = {r.loc: r.a for r in fc.decompress_fields(model, blobs).where("level = 5").collect()}
    means = {r["loc"]: r["mu"][0] for r in model.table.collect()}
    assert all(abs(back[i] - means[i]) < 1e-9 for i in means)
    other = blobs.withColumn("blob", F.expr("concat(X'09000000', substring(blob, 5))"))
    with pytest.raises(Exception, match="blob of 9 sensors"):
        fc.decompress_fields(model, other).collect()


@pytest.mark.parametrize("n_out", [NL, NL - 4, NL + 3])
def test_volumes_of_any_height(spark, n_out):
    v = fields(1)[0]
    df = cells(spark, v[None], ["value"])
    model = fc.train_volume(profiles(df, NL), NL, NY * NX, 4, 2)
    rng = np.random.default_rng(0)
    many = {7: v * 1.0, 900: v * 0.5 + rng.normal(size=v.shape)}
    rows = [(k, lv, loc, float(m[lv % NL, loc])) for k, m in many.items() for lv in range(n_out) for loc in range(NY * NX)]
    blobs = fc.compress_volumes(model, spark.createDataFrame(rows, "volume long, level long, loc long, value double"), n_out)
    back = fc.decompress_volumes(model, blobs, tile=16).toPandas()
    table = model.table.orderBy("loc").toPandas()
    mu, mode = table["mu"].to_numpy(), np.stack(table["mode"])
    lvl, loc = model.sensors % sl.LEVEL_SPAN, model.sensors // sl.LEVEL_SPAN
    use = lvl < n_out
    for k, m in many.items():
        y = (m[lvl[use] % NL, loc[use]] - mu[loc[use]]).astype("f4").astype(float)
        c = np.linalg.lstsq(model.rows[use], y, rcond=None)[0]
        got = back[back.volume == k].pivot(index="level", columns="loc", values="value").to_numpy()
        want = np.tile(mu, (n_out, 1))
        top = min(n_out, NL)
        want[:top] += (model.levels[:top] * c) @ mode.T
        assert got.shape == want.shape and np.allclose(got, want)
    assert np.frombuffer(blobs.first()["blob"][:16], "<i4").tolist() == [4, 6, NY * NX * n_out, int(use.sum())]


@pytest.mark.parametrize("kind", ["deim", "kriging"])
def test_snapshots_beyond_one_block(spark, monkeypatch, kind):
    """Many snapshots in blocks of a few; nothing but counts comes back to the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    v = fields(1)[0]
    df = cells(spark, v[None], ["value"])
    prof = profiles(df, NL)
    model = cd.fit_deim(prof, NL, NY * NX, 3) if kind == "deim" else cd.fit_kriging(
        prof, NL, NY * NX, 5, sl.RadialKernel(kn.matern, nu=1.5, ls=3.0))
    encoded = cd.encode(model, prof)
    far = None
    for k in range(3):
        part = encoded.withColumn("level", F.col("level") + 10**6 * k)
        far = part if far is None else far.unionAll(part)
    want = np.stack([r["pred"] for r in cd.decode(model, encoded).orderBy("loc").collect()])
    mu = np.array([r["mu"] for r in model.table.orderBy("loc").collect()])
    for name in ("toPandas", "collect", "toArrow"):
        monkeypatch.setattr(DataFrame, name, lambda self: pytest.fail("rows were brought to the driver"))
    back = cd.decode_snapshots(model, far, cells=2048)
    monkeypatch.undo()
    got = back.toPandas().pivot(index="loc", columns="level", values="value").to_numpy()
    assert got.shape == (NY * NX, 3 * NL)
    assert np.allclose(got, np.tile(want + mu[:, None], 3))


def test_decoded_fields_come_as_columns_from_dealt_pairs(spark):
    """Pairs of tiles and blocks are dealt evenly to tasks, and what they yield is not grouped again."""
    v = fields(2)
    df = cells(spark, v, ["a", "b"])
    model, _ = fc.train_fields({n: profiles(df, NL, n) for n in ("a", "b")}, NL, NY * NX, cap=3)
    back = fc.decompress_fields(model, fc.compress_fields(model, df), tile=5)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("MapInArrow")]
    dealt = back.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(dealt) == 3 and {r["count"] for r in dealt} == {4 * 5 * NL}
