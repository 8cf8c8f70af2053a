"""Rate-distortion sweep: predictors x bounds in one pass over the field."""

from __future__ import annotations

from typing import NamedTuple, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.quantisers import error_bin
from fieldloom.operators.entropy import entropy_of, huffman_bytes_flat

BYTES_PER_VALUE = 4


class Predictor(NamedTuple):
    """A prediction column and what the decoder must be given to rebuild it."""

    method: str
    k: int
    prediction: Column
    model_bytes: Column | int = 0
    sensor_bytes: Column | int = 0
    # signs and neighbours' residuals of an integer Lorenzo code on top of the prediction
    near: Sequence[tuple[int, Column]] = ()


def residual_bins(
    cells: DataFrame, value: str, predictors: Sequence[Predictor], bounds: Sequence[float]
) -> DataFrame:
    """One row per (method, k, abs_bound, bin) with the sums every metric needs.

    The residual is quantised against the prediction; a Lorenzo code then subtracts the quantised
    residuals of neighbours, so the bins decode losslessly to the quantised residuals.
    Prediction happens once per cell, never per bound; the explode feeds map-side
    partial aggregation, so the shuffle carries distinct bins rather than cells.
    """
    width = max(len(p.near) for p in predictors)

    def near(p: Predictor) -> list[Column]:
        pairs = [*p.near, *[(0, F.lit(0.0))] * (width - len(p.near))]
        return [c for i, (sign, v) in enumerate(pairs) for c in (F.lit(sign).alias(f"sign_{i}"), v.alias(f"near_{i}"))]

    tagged = cells.select(
        F.col(value).alias("v"),
        F.explode(F.array(*[
            F.struct(
                F.lit(p.method).alias("method"),
                F.lit(p.k).cast("bigint").alias("k"),
                p.prediction.alias("pred"),
                F.lit(p.model_bytes).cast("double").alias("model_bytes")
                if not isinstance(p.model_bytes, Column) else p.model_bytes.cast("double").alias("model_bytes"),
                F.lit(p.sensor_bytes).cast("double").alias("sensor_bytes")
                if not isinstance(p.sensor_bytes, Column) else p.sensor_bytes.cast("double").alias("sensor_bytes"),
                *near(p),
            )
            for p in predictors
        ])).alias("p"),
    ).select("v", "p.*")
    quantised = (
        tagged.withColumn("abs_bound", F.explode(F.array(*[F.lit(float(b)) for b in bounds])))
        .withColumn("q", error_bin(F.col("v") - F.col("pred"), F.col("abs_bound")))
        .withColumn("recon", F.col("pred") + F.col("q") * (F.col("abs_bound") * 2.0))
        .withColumn("err", F.col("v") - F.col("recon"))
    )
    coded = F.col("q")
    for i in range(width):
        sign = F.col(f"sign_{i}")  # 0 beyond a predictor's own neighbours, which then cost nothing
        coded = coded - F.when(sign != 0, error_bin(F.col(f"near_{i}"), F.col("abs_bound")) * sign).otherwise(F.lit(0).cast("bigint"))
    quantised = quantised.withColumn("bin", coded)
    v, r = F.col("v"), F.col("recon")
    return quantised.groupBy("method", "k", "abs_bound", "bin").agg(
        F.count(F.lit(1)).alias("c"),
        F.sum(F.col("err") * F.col("err")).alias("se"),
        F.min("v").alias("vmin"),
        F.max("v").alias("vmax"),
        F.sum(v).alias("sv"),
        F.sum(v * v).alias("svv"),
        F.sum(r).alias("sr"),
        F.sum(r * r).alias("srr"),
        F.sum(v * r).alias("svr"),
        F.max("model_bytes").alias("model_bytes"),
        F.max("sensor_bytes").alias("sensor_bytes"),
    )


def score_bins(bins: DataFrame, by: Sequence[str] = ("method", "k", "abs_bound")) -> DataFrame:
    """Result rows (size, ratio, quality) from :func:`residual_bins`."""
    agg = bins.groupBy(*by).agg(
        F.sum("c").alias("n"),
        F.count(F.lit(1)).alias("n_unique"),
        entropy_of(F.col("c")).alias("entropy"),
        F.sqrt(F.sum("se") / F.sum("c")).alias("rmse"),
        (F.max("vmax") - F.min("vmin")).alias("range"),
        *[F.sum(c).alias(c) for c in ("sv", "svv", "sr", "srr", "svr")],
        F.max("model_bytes").alias("model_bytes"),
        F.max("sensor_bytes").alias("sensor_bytes"),
    )
    n = F.col("n")
    mv, mr = F.col("sv") / n, F.col("sr") / n
    var_v, var_r = F.col("svv") / n - mv * mv, F.col("srr") / n - mr * mr
    cov = F.col("svr") / n - mv * mr
    c1 = F.pow(F.col("range") * 0.01, F.lit(2.0))
    c2 = F.pow(F.col("range") * 0.03, F.lit(2.0))
    ssim = ((mv * mr * 2 + c1) * (cov * 2 + c2)) / ((mv * mv + mr * mr + c1) * (var_v + var_r + c2))
    resid = huffman_bytes_flat(n, F.col("entropy")).cast("double")
    total = resid + F.col("model_bytes") + F.col("sensor_bytes")
    return agg.select(
        *by, "n", "n_unique", "entropy", "rmse",
        psnr(F.col("range"), F.col("rmse")).alias("psnr"),
        ssim.alias("ssim"),
        (n * BYTES_PER_VALUE / total).alias("cr"),
        (n * BYTES_PER_VALUE / (total - F.col("model_bytes"))).alias("cr_no_model"),
        (total * 8 / n).alias("bpv"),
        (resid / 1e6).alias("resid_mb"),
        (F.col("model_bytes") / 1e6).alias("model_mb"),
        (F.col("sensor_bytes") / 1e6).alias("sv_mb"),
    )


def psnr(value_range: Column, rmse: Column, zero_error: str = "inf") -> Column:
    """Peak signal-to-noise ratio; an exact match gives infinity or the 999.9 sentinel."""
    ratio = F.log10(value_range / rmse) * 20.0
    if zero_error == "sentinel":
        return F.when((rmse * rmse < 1e-15) | (value_range < 1e-10), 999.9).otherwise(ratio)
    return F.when(rmse > 0, ratio).otherwise(F.lit(float("inf")))


def sweep(
    cells: DataFrame, value: str, predictors: Sequence[Predictor], bounds: Sequence[float]
) -> DataFrame:
    return score_bins(residual_bins(cells, value, predictors, bounds))
