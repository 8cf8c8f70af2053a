import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import reshape as rs
from fieldloom.sources import results as rt
from fieldloom.sources.rawf32 import pack_f32, read_variables, read_volume, unpack_f32


@pytest.fixture()
def volume(tmp_path):
    v = np.random.default_rng(0).normal(size=(4, 7, 9)).astype("<f4")
    path = tmp_path / "U.bin.f32"
    v.tofile(path)
    return v, str(path)


@pytest.mark.parametrize("stride,skip,level", [(1, 0, None), (3, 1, None), (2, 0, 2)])
def test_raw_volume(spark, volume, stride, skip, level):
    v, path = volume
    got = read_volume(spark, path, v.shape, stride, skip, level).collect()
    want = v[level : level + 1] if level is not None else v[skip:]
    want = want[:, ::stride, ::stride]
    assert len(got) == want.size
    base = level if level is not None else skip
    assert all(np.float32(r["value"]) == want[r["level"] - base, r["y"], r["x"]] for r in got)


def test_raw_volume_checks_size(spark, volume):
    _, path = volume
    with pytest.raises(Exception, match="size"):
        read_volume(spark, path, (9, 9, 9)).count()


def test_several_variables(spark, volume):
    v, path = volume
    df = read_variables(spark, {"U": path, "V": path}, v.shape)
    assert {r["var"]: r["count"] for r in df.groupBy("var").count().collect()} == {"U": v.size, "V": v.size}


def test_packed_sensors(spark):
    df = spark.createDataFrame([([1.5, 2.5],)], "v array<double>")
    blob = df.select(pack_f32(F.col("v"), F.lit(2), F.lit(99)).alias("b"))
    assert blob.first()["b"] == np.array([2, 99], "<i4").tobytes() + np.array([1.5, 2.5], "<f4").tobytes()
    back = blob.select(unpack_f32(F.col("b"), 2).alias("u")).first()["u"]
    assert back["header"] == [2, 99] and back["payload"] == [1.5, 2.5]


def test_result_csv_round_trip(spark, tmp_path):
    p = str(tmp_path / "r")
    df = spark.createDataFrame([("A", 3, 1.5, None, "x"), ("B", 0, 2.5, 40.0, "y")], "method string, k long, cr double, psnr double, extra string")
    rt.write_results(df, p)
    back = rt.read_results(spark, p)
    assert back.columns == list(rt.RESULT_FIELDS)
    rows = {r["method"]: r for r in back.collect()}
    assert rows["A"]["k"] == 3 and rows["A"]["psnr"] is None and rows["B"]["psnr"] == 40.0
    (tmp_path / "raw.csv").write_text("method,k,cr,psnr\nA,None,1.0,\nB,2,abc,3.0\n")
    raw = {r["method"]: r for r in rt.read_results(spark, str(tmp_path / "raw.csv")).collect()}
    assert raw["A"]["k"] is None and raw["A"]["psnr"] is None and raw["B"]["cr"] is None


def test_append_and_resume(spark, tmp_path):
    p = str(tmp_path / "a")
    s = "method string, k long, cr double"
    rt.append_results(spark.createDataFrame([("A", 1, 2.0)], s), p)
    rt.append_results(spark.createDataFrame([("B", 1, 3.0)], s), p)
    wanted = spark.createDataFrame([("A", 1), ("B", 1), ("B", 2)], "method string, k long")
    left = rt.not_yet_done(wanted, spark.read.parquet(p), ["method", "k"]).collect()
    assert [(r["method"], r["k"]) for r in left] == [("B", 2)]


def test_checkpoints(spark, tmp_path):
    root = rt.checkpoint_path(str(tmp_path), "run", eb=0.1, k=3)
    assert root == rt.checkpoint_path(str(tmp_path), "run", k=3, eb=0.1) != rt.checkpoint_path(str(tmp_path), "run", k=4, eb=0.1)
    for n in (1, 3, 2):
        rt.save_rounds(spark.range(n), root, n)
    latest = rt.load_latest_rounds(spark, root)
    assert latest.count() == 3 and latest.first()["rounds"] == 3
    rt.save_hyperparameters(spark, {"ls": 2.0}, str(tmp_path / "h"))
    assert spark.read.text(str(tmp_path / "h")).first()[0] == "ls = 2.0"


def test_sampling(spark):
    df = spark.range(50).select(F.col("id").alias("loc"))
    a = {r["loc"] for r in rs.sample_without_replacement(df, "loc", 10, 1).collect()}
    b = {r["loc"] for r in rs.sample_without_replacement(df.repartition(7), "loc", 10, 1).collect()}
    assert a == b and len(a) == 10
    assert rs.sample_with_replacement(df, "loc", 50, 200, 3).count() == 200
    assert rs.even_indices(83, 20)[0] == 0 and rs.even_indices(83, 20)[-1] == 82 and len(rs.even_indices(83, 20)) == 20


def test_domain_partition_is_exact():
    for extent, parts in ((7, 2), (10, 3), (5, 5)):
        spans = [range(r * extent // parts, (r + 1) * extent // parts) for r in range(parts)]
        assert sorted(i for s in spans for i in s) == list(range(extent))


def test_streamed_snapshots_match_batch_encoding(spark, tmp_path):
    from fieldloom.operators import codecs as cd
    from fieldloom.sources.profiles import profiles
    from fieldloom.streaming.encode import encode_stream

    rng = np.random.default_rng(0)
    rows = [(l, i, float(rng.normal())) for l in range(5) for i in range(40)]
    cells = spark.createDataFrame(rows, "level long, loc long, value double")
    prof = profiles(cells, 5).cache()
    model = cd.fit_deim(prof, 5, 40, 3)
    for l in range(5):
        cells.where(F.col("level") == l).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = encode_stream(spark, str(tmp_path / "in"), model, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert q.awaitTermination(120)
    got = {r["level"]: bytes(r["blob"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["level"]: bytes(r["blob"]) for r in cd.encode(model, prof).collect()}
    assert got.keys() == want.keys()
    for l in want:
        assert np.allclose(np.frombuffer(got[l][8:], "<f4"), np.frombuffer(want[l][8:], "<f4"), atol=1e-5)


def test_gappy_profiles(spark):
    from fieldloom.sources.profiles import profiles

    cells = spark.createDataFrame([(0, 7, 1.0), (2, 7, 3.0), (0, 8, 5.0), (1, 8, 5.0), (2, 8, 5.0)], "level long, loc long, value double")
    got = {r["loc"]: r for r in profiles(cells, 3).collect()}
    assert got[7]["vec"] == [-1.0, 0.0, 1.0] and got[7]["n_obs_levels"] == 2
    assert got[8]["vec"] == [0.0, 0.0, 0.0] and got[8]["sd"] == 1.0
