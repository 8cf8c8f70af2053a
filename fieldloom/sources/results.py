"""Result tables and checkpoints: CSV with coercion, resumable appends, parquet models."""

from __future__ import annotations

import hashlib
import json
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a result file, in file order.
RESULT_FIELDS = (
    "method", "k", "abs_bound", "cr", "psnr", "ssim", "comp_sec", "decomp_sec",
    "train_sec", "compressed_MB", "model_MB", "sv_MB", "resid_MB", "n_outliers",
    "rmse_mean", "rmse_med", "rel_rmse_mean",
)
INTEGER_FIELDS = ("k", "n_outliers")


def coerce(cell: Column, type_: str) -> Column:
    """Parse a cell; empty, ``None`` and malformed text become NULL."""
    return F.trim(cell).try_cast(type_)


def read_results(spark: SparkSession, path: str, fields: Sequence[str] = RESULT_FIELDS) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[
        F.col(f) if f == "method"
        else coerce(F.col(f), "bigint" if f in INTEGER_FIELDS else "double").alias(f)
        for f in fields if f in raw.columns
    ])


def write_results(df: DataFrame, path: str, fields: Sequence[str] = RESULT_FIELDS, mode: str = "overwrite") -> None:
    """CSV with the fixed header; columns outside it are ignored, absent ones are empty."""
    out = df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields])
    out.write.mode(mode).option("header", True).csv(path)


def append_results(df: DataFrame, path: str) -> None:
    """Resumable sink: one directory per method, so a finished method is found again."""
    df.write.mode("append").partitionBy("method").parquet(path)


def not_yet_done(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Configurations without a result row."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def checkpoint_path(root: str, name: str, **params) -> str:
    """Folder keyed by a digest of the parameters that shaped the content."""
    digest = hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()[:16]
    return f"{root.rstrip('/')}/{name}/{digest}"


def save_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_rounds(df: DataFrame, path: str, rounds: int) -> None:
    """Progressive state after ``rounds`` rounds, beside the earlier ones."""
    df.write.mode("overwrite").parquet(f"{path}/rounds={rounds}")


def load_latest_rounds(spark: SparkSession, path: str) -> DataFrame:
    """State with the most rounds; partition pruning leaves the others unread."""
    state = spark.read.parquet(path)
    latest = state.agg(F.max("rounds")).first()[0]
    return state.where(F.col("rounds") == latest)


def save_hyperparameters(spark: SparkSession, params: dict[str, float], path: str) -> None:
    """Human-readable ``name = value`` lines."""
    rows = [(f"{k} = {v!r}",) for k, v in params.items()]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(path)
