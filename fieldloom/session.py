"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def build_session(app: str = "fieldloom", cpus: int | None = None) -> SparkSession:
    """Local session for tests and benchmarks; a cluster supplies its own."""
    n = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FIELDLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fieldloom-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and return it."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized_broadcast(df: DataFrame, rows: int | None, row_bytes: int = 256) -> DataFrame:
    """Hint a broadcast only where a known row bound keeps the table small; without a
    bound, or beyond it, the join stays a shuffle join that adaptive execution may tune."""
    if rows is not None and rows * row_bytes <= BROADCAST_BYTES:
        return F.broadcast(df)
    return df
