import numpy as np
from pyspark.sql import functions as F

from fieldloom.__main__ import sweep, train
from fieldloom.operators import codecs as cd
from fieldloom.sources.results import read_results


def test_sweep_resumes(spark, sf, tmp_path):
    out = str(tmp_path / "s")
    names = ["e03_deim_sweep", "no_such_runner"]
    first = sweep(spark, sf, out, names)
    assert first["e03_deim_sweep"] == "ran" and first["no_such_runner"].startswith("failed")
    assert sweep(spark, sf, out, names)["e03_deim_sweep"] == "kept"
    rows = read_results(spark, f"{out}/csv").collect()
    assert rows and all(r["cr"] > 0 and r["ssim"] is not None for r in rows)


def test_trained_model_encodes_new_snapshots(spark, sf, tmp_path):
    for kind in ("deim", "kriging"):
        path = str(tmp_path / kind)
        train(spark, kind, sf, path, 4)
        model = cd.load_model(spark, path)
        cells = model.table.select("loc", "mu", F.explode(F.array(*[F.lit(n).cast("bigint") for n in (900, 7000)])).alias("level"))
        cells = cells.select("level", "loc", (F.col("mu") + F.col("loc") * 10.0 + F.col("level")).alias("value"))
        back = cd.decode_snapshots(model, cd.encode_cells(model, cells))
        got = back.where(F.col("loc").isin(model.sensors.tolist())).join(
            cells.withColumnRenamed("value", "truth"), ["level", "loc"]
        ).toPandas()
        assert len(got) == 2 * model.k and back.count() == 2 * model.n_locs
        # readings are reproduced at the sensors (Kriging up to its noise)
        assert np.allclose(got["value"], got["truth"], rtol=1e-2)
