"""Analytics over a rate-distortion result table.

Every window is partitioned by method (or method and k): a result table has one row per
configuration, never per cell, so partitions stay small.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CURVE = ("method", "k")


def _before(part: Sequence[str], *order: Column | str):
    return Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def running_max_by_cr(rows: DataFrame, metric: str = "psnr", keep_ties: bool = False, by: Sequence[str] = ("method",)) -> DataFrame:
    """Rows that set a new maximum of ``metric`` in ascending ratio order."""
    best = F.coalesce(F.max(metric).over(_before(by, "cr", "k", "abs_bound")), F.lit(float("-inf")))
    return rows.withColumn("_b", best).where(
        F.col(metric) >= F.col("_b") if keep_ties else F.col(metric) > F.col("_b")
    ).drop("_b")


def pareto_front(rows: DataFrame, metric: str = "psnr", keep_ties: bool = False, by: Sequence[str] = ("method",)) -> DataFrame:
    """Non-dominated rows: new maxima of ``metric`` in descending ratio order."""
    best = F.coalesce(F.max(metric).over(_before(by, F.desc("cr"), "k", "abs_bound")), F.lit(float("-inf")))
    return rows.withColumn("_b", best).where(
        F.col(metric) >= F.col("_b") if keep_ties else F.col(metric) > F.col("_b")
    ).drop("_b")


def trim_after_reversal(rows: DataFrame, by: Sequence[str] = CURVE) -> DataFrame:
    """From loose to tight bounds, cut everything after the ratio first rises."""
    order = Window.partitionBy(*by).orderBy(F.desc("abs_bound"))
    rise = F.coalesce((F.col("cr") > F.lag("cr").over(order)).cast("int"), F.lit(0))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_r", rise).withColumn("_any", F.max("_r").over(so_far)).where(
        F.col("_any") == 0
    ).drop("_r", "_any")


def keep_rising(rows: DataFrame, by: Sequence[str] = CURVE) -> DataFrame:
    """From tight to loose bounds, keep rows whose ratio reaches the running maximum."""
    best = F.coalesce(F.max("cr").over(_before(by, "abs_bound")), F.lit(float("-inf")))
    return rows.withColumn("_b", best).where(F.col("cr") >= F.col("_b")).drop("_b")


def first_by(rows: DataFrame, by: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of every group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def nearest_ratio(rows: DataFrame, target: Column | float, by: Sequence[str] = ("method",)) -> DataFrame:
    return first_by(rows, by, F.round(F.abs(F.col("cr") - target), 9), "k", "abs_bound")


def common_ratio(rows: DataFrame) -> DataFrame:
    """Largest ratio every method reaches, and the method that limits it."""
    per = rows.groupBy("method").agg(F.max("cr").alias("top"))
    return per.agg(F.min("top").alias("target_cr"), F.min_by("method", "top").alias("bottleneck"))


def middle_row(rows: DataFrame, by: Sequence[str] = CURVE) -> DataFrame:
    """The row at position ``count div 2`` by bound."""
    w = Window.partitionBy(*by)
    ranked = rows.withColumn("_rn", F.row_number().over(w.orderBy("abs_bound"))).withColumn(
        "_n", F.count(F.lit(1)).over(w)
    )
    return ranked.where(F.col("_rn") == F.floor(F.col("_n") / 2) + 1).drop("_rn", "_n")


def interpolate_on_grid(
    curves: DataFrame, by: Sequence[str], start: Column, step: Column, points: int, metric: str = "psnr"
) -> DataFrame:
    """Curves interpolated linearly in log10 ratio at grid points ``start + i*step``.

    Each segment generates the grid points it covers, so no range join is needed.
    """
    order = Window.partitionBy(*by).orderBy("cr")
    seg = (
        curves.withColumn("_x0", F.log10("cr")).withColumn("_y0", F.col(metric))
        .withColumn("_x1", F.lead("_x0").over(order)).withColumn("_y1", F.lead("_y0").over(order))
        .where(F.col("_x1").isNotNull())
        .withColumn("_s", start).withColumn("_d", step)
    )
    lo = F.greatest(F.floor((F.col("_x0") - F.col("_s")) / F.col("_d")) - 1, F.lit(0))
    hi = F.least(F.ceil((F.col("_x1") - F.col("_s")) / F.col("_d")) + 1, F.lit(points - 1))
    x = F.col("_s") + F.col("i") * F.col("_d")
    t = (F.col("_x") - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    return (
        seg.where(lo <= hi).withColumn("i", F.explode(F.sequence(lo, hi)))
        .withColumn("_x", x)
        .where(F.col("_x").between(F.col("_x0"), F.col("_x1")))
        .groupBy(*by, "i")
        .agg(F.max(F.col("_y0") + (F.col("_y1") - F.col("_y0")) * t).alias("v"))
    )


def win_regions(
    rows: DataFrame, ours: Sequence[str], baseline: str, points: int = 800, metric: str = "psnr"
) -> DataFrame:
    """Ratio intervals where the envelope of our curves beats the trimmed baseline."""
    base = trim_after_reversal(rows.where(F.col("method") == baseline))
    mine = rows.where(F.col("method").isin(list(ours)))
    lb = base.agg(F.min(F.log10("cr")).alias("a"), F.max(F.log10("cr")).alias("z"))
    lm = mine.agg(F.min(F.log10("cr")).alias("a"), F.max(F.log10("cr")).alias("z"))
    a = F.greatest(lb.select("a").scalar(), lm.select("a").scalar())
    z = F.least(lb.select("z").scalar(), lm.select("z").scalar())
    step = (z - a) / (points - 1)
    env = interpolate_on_grid(mine, CURVE, a, step, points, metric).groupBy("i").agg(F.max("v").alias("ours"))
    ref = interpolate_on_grid(base, ("method",), a, step, points, metric).select("i", F.col("v").alias("theirs"))
    wins = env.join(ref, "i").where(F.round(F.col("ours") - F.col("theirs"), 9) > 0)
    # at most ``points`` rows
    island = wins.withColumn("_g", F.col("i") - F.row_number().over(Window.orderBy("i")))
    return island.groupBy("_g").agg(
        F.min("i").alias("i_from"), F.max("i").alias("i_to"), F.count(F.lit(1)).alias("n_points"),
        F.max(F.col("ours") - F.col("theirs")).alias("max_gain"),
    ).drop("_g")
