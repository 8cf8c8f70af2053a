"""Command line.

python -m fieldloom sweep SF_DIR OUT [RUNNER ...]     resumable benchmark, then one CSV
python -m fieldloom train deim|kriging SF_DIR MODEL --k K
python -m fieldloom compress MODEL SNAPSHOTS OUT      snapshots: level, loc, value
python -m fieldloom decompress MODEL BLOBS OUT
"""

from __future__ import annotations

import argparse
import sys

from numpy.linalg import LinAlgError
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import codecs as cd
from fieldloom.session import build_session
from fieldloom.sources import results as rt

RUNNERS = [
    "e01_volume_basis_sweep", "e02_coregional_sweep", "e03_deim_sweep", "e04_kriging_sweep",
    "e05_deim_hybrid_masked", "e06_kriging_hybrid_masked", "e07_deim_hybrid", "e08_kriging_hybrid", "e09_kronecker_hybrid",
]


def sweep(spark: SparkSession, sf: str, out: str, names: list[str]) -> dict[str, str]:
    """Run what has no rows yet, appending after each runner; a runner that fails in Spark or in
    its algebra is reported and the sweep goes on.  A store that cannot be read ends it."""
    from fieldloom.plans import registry

    registry.load_all()
    store, outcome = f"{out}/rows", {}
    try:
        done = {r[0] for r in spark.read.parquet(store).select("runner").distinct().collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        done = set()  # nothing stored so far
    for name in names:
        if name in done:
            outcome[name] = "kept"
            continue
        try:
            rows = registry.QUERIES[name](spark, sf).withColumn("runner", F.lit(name))
            rt.append_results(rows, store)
            outcome[name] = "ran"
        except (PySparkException, Py4JJavaError, ArithmeticError, LookupError, ValueError, LinAlgError) as e:
            outcome[name] = f"failed: {type(e).__name__}"
    if not done and "ran" not in outcome.values():
        return outcome
    table = spark.read.parquet(store)
    renamed = table.select(
        "method", "k", "abs_bound", "cr", "psnr", "ssim", F.col("model_mb").alias("model_MB"),
        F.col("sv_mb").alias("sv_MB"), F.col("resid_mb").alias("resid_MB"),
        (F.col("model_mb") + F.col("sv_mb") + F.col("resid_mb")).alias("compressed_MB"), F.col("rmse").alias("rmse_mean"),
    )
    rt.write_results(renamed, f"{out}/csv")
    return outcome


def train(spark: SparkSession, kind: str, sf: str, path: str, k: int) -> None:
    from fieldloom.plans.fitting import stored_profiles
    from fieldloom.sources.grid import grid_shape

    fit = {"deim": cd.fit_deim, "kriging": cd.fit_kriging}[kind]
    cd.save_model(fit(stored_profiles(spark, sf), *grid_shape(spark, sf), k), path)


def main() -> None:
    ap = argparse.ArgumentParser(prog="fieldloom")
    sub = ap.add_subparsers(dest="what", required=True)
    p = sub.add_parser("sweep")
    p.add_argument("sf"), p.add_argument("out"), p.add_argument("runner", nargs="*")
    p = sub.add_parser("train")
    p.add_argument("kind", choices=["deim", "kriging"]), p.add_argument("sf"), p.add_argument("model")
    p.add_argument("--k", type=int, default=8)
    for name in ("compress", "decompress"):
        p = sub.add_parser(name)
        p.add_argument("model"), p.add_argument("source"), p.add_argument("out")
    a = ap.parse_args()
    spark = SparkSession.getActiveSession() or build_session()
    if a.what == "sweep":
        outcome = sweep(spark, a.sf, a.out, a.runner or RUNNERS)
        for name, how in outcome.items():
            print(name, how)
        if any(how.startswith("failed") for how in outcome.values()):
            sys.exit(1)
    elif a.what == "train":
        train(spark, a.kind, a.sf, a.model, a.k)
    else:
        model = cd.load_model(spark, a.model)
        source = spark.read.parquet(a.source)
        step = cd.encode_cells if a.what == "compress" else cd.decode_snapshots
        step(model, source).write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
