"""Stored-size models: sensors, models, plug-in payloads, amortised ratios."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.entropy import bin_counts, entropy_of
from fieldloom.operators.ordered import previous_in_order

FLAT_SENSOR_BITS = 64


def compress_bytes(payload: bytes) -> int:
    try:
        import zstandard

        return len(zstandard.ZstdCompressor(level=3).compress(payload))
    except ImportError:
        import zlib

        return len(zlib.compress(payload, 6))


def lossless_bytes(df: DataFrame, key: str, value: str, dtype: str, chunk: int = 65_536) -> DataFrame:
    """Total losslessly compressed size of a long vector, chunk by chunk.

    ``dtype`` is a numpy name (float16, float32, int32).  The vector is cut on its key,
    so no task holds more than a chunk.
    """

    @F.pandas_udf("bigint")
    def size(chunks: pd.Series) -> pd.Series:
        return pd.Series([compress_bytes(np.asarray(c).astype(dtype).tobytes()) for c in chunks])

    chunks = df.groupBy(F.floor(F.col(key) / chunk).alias("_c")).agg(
        F.array_sort(F.collect_list(F.struct(key, value)))[value].alias("_v")
    )
    return chunks.select(size("_v").alias("_b")).agg(F.sum("_b").alias("n_bytes"))


def half_precision(v: Column) -> Column:
    """Value after a float16 store."""

    @F.pandas_udf("double")
    def narrow(s: pd.Series) -> pd.Series:
        return s.astype("float16").astype("float64")

    return narrow(v)


def eb_quantised(v: Column, eb: float) -> Column:
    return F.rint(v / eb).cast("bigint") * F.lit(eb)


def observation_noise(noise: Column, eb) -> Column:
    """Noise variance the predictor must assume for readings stored to within eb/2."""
    half = eb / 2 if isinstance(eb, Column) else F.lit(eb / 2)
    return F.greatest(noise, half * half)


def sensor_bits(sensors: DataFrame, index: str, value: str, eb: float, storage: str = "eb_quant") -> DataFrame:
    """k, index_bits, value_bits: entropy of sorted-index gaps plus stored values."""
    gaps = previous_in_order(sensors.select(index, value), index, index, "_p").withColumn(
        "_gap", F.col(index) - F.coalesce(F.col("_p"), F.lit(-1))
    )
    idx = bin_counts(gaps, [], "_gap").agg(F.sum("n").alias("k"), entropy_of(F.col("n")).alias("_hi"))
    if storage == "eb_quant":
        q = sensors.select(F.rint(F.col(value) / eb).cast("bigint").alias("_q"))
        per_value = bin_counts(q, [], "_q").agg(entropy_of(F.col("n")).alias("_hv"))
        bits = per_value.select("_hv").scalar()
    else:
        bits = F.lit({"float32": 32.0, "float16": 16.0}[storage])
    return idx.select("k", (F.col("_hi") * F.col("k")).alias("index_bits"), (bits * F.col("k")).alias("value_bits"))


def plugin_ratio(n: int, k: Column, header: int = 8, fields: int = 1) -> Column:
    """Raw float32 bytes over header plus readings."""
    return F.lit(4.0 * n * fields) / (k * (4 * fields) + header)


def shared_basis_ratio(n_levels: int, n: int, k: Column) -> Column:
    """Planar basis shared by all levels: modes, mean, sensor ids, readings per level."""
    return F.lit(float(n_levels * n)) / (k * n + n + k + k * n_levels)


def volume_basis_ratio(n_levels: int, n: int, k: Column, sensors: Column, amortised: bool = False) -> Column:
    """Rank-1 volume modes: both factors, mean and deviation, sensor ids and readings;
    amortised over many volumes only the sensors remain."""
    per_volume = sensors * 2
    shared = F.lit(0) if amortised else k * (n_levels + n) + 2 * n
    return F.lit(float(n_levels * n)) / (shared + per_volume)
