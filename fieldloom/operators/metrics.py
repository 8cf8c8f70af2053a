"""Quality metrics as aggregates."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.neighbours import row_run, with_stencil
from fieldloom.operators.ratedist import psnr
from fieldloom.sources.grid import NX

WINDOW = 7


def quality(df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), zero_error: str = "inf") -> DataFrame:
    """n, rmse, mae, max_err, range, rel_l2, nrmse, psnr per group."""
    e = F.col(truth) - F.col(pred)
    rmse = F.sqrt(F.avg(e * e))
    spread = F.max(truth) - F.min(truth)
    energy = F.sum(F.col(truth) * F.col(truth))
    agg = df.groupBy(*by).agg(
        F.count(e).alias("n"), rmse.alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.max(F.abs(e)).alias("max_err"), spread.alias("range"),
        F.when(energy > 1e-30, F.sqrt(F.sum(e * e) / energy)).alias("rel_l2"),
    )
    return agg.withColumn("nrmse", F.col("rmse") / F.col("range")).withColumn(
        "psnr", psnr(F.col("range"), F.col("rmse"), zero_error)
    )


def ssim_of(mx: Column, my: Column, vx: Column, vy: Column, cov: Column, value_range: Column) -> Column:
    """Structural similarity from window moments (K1 = 0.01, K2 = 0.03)."""
    c1 = (value_range * 0.01) * (value_range * 0.01)
    c2 = (value_range * 0.03) * (value_range * 0.03)
    return ((mx * my * 2 + c1) * (cov * 2 + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))


def ssim_single_window(df: DataFrame, truth: str, pred: str, by: Sequence[str]) -> DataFrame:
    """The whole group as one window, population moments."""
    m = df.groupBy(*by).agg(
        F.avg(truth).alias("mx"), F.avg(pred).alias("my"), F.var_pop(truth).alias("vx"),
        F.var_pop(pred).alias("vy"), F.covar_pop(truth, pred).alias("c"),
        (F.max(truth) - F.min(truth)).alias("r"),
    )
    s = ssim_of(*[F.col(c) for c in ("mx", "my", "vx", "vy", "c", "r")])
    return m.select(*by, s.alias("ssim"))


def ssim_windowed(
    df: DataFrame, truth: str, pred: str, ny: int, value_range: Column, nx: int = NX
) -> DataFrame:
    """Mean SSIM per level over 7x7 uniform windows with sample covariance; windows that
    would cross the border are cropped, absent cells count as 0."""
    h = WINDOW // 2
    x, y = F.col(truth), F.col(pred)
    sums = {"sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}
    entries = {
        f"{name}_{dy + h}": row_run(expr, dy, -h, h, nx=nx)
        for name, expr in sums.items() for dy in range(-h, h + 1)
    }
    w = with_stencil(df, entries).where(
        F.col("x").between(h, nx - 1 - h) & F.col("y").between(h, ny - 1 - h)
    )
    n = WINDOW * WINDOW

    def total(name: str) -> Column:
        out = F.lit(0.0)
        for i in range(WINDOW):
            out = out + F.coalesce(F.col(f"{name}_{i}"), F.lit(0.0))
        return out / n

    m = w.select("level", *[total(s).alias(s) for s in sums], value_range.alias("r"))
    unbias = n / (n - 1)
    mx, my = F.col("sx"), F.col("sy")
    s = ssim_of(
        mx, my, (F.col("sxx") - mx * mx) * unbias, (F.col("syy") - my * my) * unbias,
        (F.col("sxy") - mx * my) * unbias, F.col("r"),
    )
    return m.groupBy("level").agg(F.avg(s).alias("ssim"), F.count(F.lit(1)).alias("n_windows"))


def residual_summary(df: DataFrame, value: str, by: Sequence[str], sigma_ref: Column) -> DataFrame:
    """RMSE, deviation, population excess kurtosis and counts beyond 2, 3 and 5 sigma."""
    v = F.col(value)
    d = df.withColumn("_s", sigma_ref)
    return d.groupBy(*by).agg(
        F.count(v).alias("n"), F.sqrt(F.avg(v * v)).alias("rmse"), F.stddev_pop(v).alias("sd"),
        F.kurtosis(v).alias("kurtosis"),
        *[F.count_if(F.abs(v) > F.col("_s") * m).alias(f"n_{m}s") for m in (2, 3, 5)],
    )
