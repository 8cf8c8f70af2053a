"""Lorenzo predictors: previous-value extrapolation in one, two and three dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.quantisers import error_bin, error_dequantise
from fieldloom.operators.neighbours import inside, point, with_stencil
from fieldloom.operators.ordered import previous_in_order
from fieldloom.sources.grid import NX


def lorenzo_series(series: DataFrame, order: str = "idx", value: str = "value") -> DataFrame:
    """1-D residual against the previous value; the first sample has residual 0."""
    prev = previous_in_order(series, order, value, "prev")
    return prev.withColumn("resid", F.coalesce(F.col(value) - F.col("prev"), F.lit(0.0)))


# Neighbours as (level, y, x) offsets, and their signs in the predictors of one to three dimensions.
CORNERS = {
    "w": (0, 0, -1), "n": (0, -1, 0), "nw": (0, -1, -1),
    "u": (-1, 0, 0), "uw": (-1, 0, -1), "un": (-1, -1, 0), "unw": (-1, -1, -1),
}
SIGNS = {
    1: {"u": 1},
    2: {"w": 1, "n": 1, "nw": -1},
    3: {"w": 1, "n": 1, "nw": -1, "u": 1, "uw": -1, "un": -1, "unw": 1},
}


def with_neighbours(cells: DataFrame, value: str = "value", nx: int = NX) -> DataFrame:
    """Add ``at_w`` ... ``at_unw``, the neighbours' values; absent neighbours count as 0, which is
    also the edge and corner rule.  ``nx`` is the width of the grid behind ``loc``."""
    v = F.col(value)
    df = with_stencil(cells, {f"_{name}": point(v, *off, nx) for name, off in CORNERS.items()})
    for name, off in CORNERS.items():
        got = F.coalesce(F.col(f"_{name}"), F.lit(0.0))
        df = df.withColumn(f"at_{name}", F.when(inside(-1, nx), got).otherwise(0.0) if off[2] else got)
    return df.drop(*(f"_{name}" for name in CORNERS))


def with_lorenzo(cells: DataFrame, value: str = "value", nx: int = NX) -> DataFrame:
    """Neighbours and ``lorenzo_1d`` (along levels), ``lorenzo_2d`` (within a level) and
    ``lorenzo_3d`` predictions from original values."""
    at = {name: F.col(f"at_{name}") for name in CORNERS}
    plane = at["w"] + at["n"] - at["nw"]
    cube = (plane + at["u"]) - (at["uw"] + at["un"]) + at["unw"]
    return (
        with_neighbours(cells, value, nx)
        .withColumn("lorenzo_1d", at["u"])
        .withColumn("lorenzo_2d", plane)
        .withColumn("lorenzo_3d", cube)
    )


def code_near(dims: int) -> list[tuple[int, Column]]:
    """Signs and neighbours of the integer Lorenzo code in ``dims`` dimensions."""
    return [(sign, F.col(f"at_{name}")) for name, sign in SIGNS[dims].items()]


def lorenzo_bin(value: Column, near: list[tuple[int, Column]], eb) -> Column:
    """Integer Lorenzo code of a value: values are quantised first, then the neighbours'
    quantised values are subtracted, which loses nothing; the error stays within ``eb``."""
    out = error_bin(value, eb)
    for sign, v in near:
        out = out - error_bin(v, eb) * sign
    return out


def encode_volume(cells: DataFrame, n_levels: int, n_locs: int, nx: int, dims: int, eb: float,
                  value: str = "value") -> DataFrame:
    """level, loc, y, x, bin of every place of the box; absent cells are coded as 0, so the
    bins alone can be decoded."""
    box = cells.sparkSession.range(n_locs).select(
        F.col("id").alias("loc"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_levels - 1).cast("bigint"))).alias("level"),
        F.expr(f"id div {nx}").alias("y"), (F.col("id") % nx).alias("x"),
    )
    full = box.join(cells.select("level", "loc", F.col(value).alias("v")), ["level", "loc"], "left")
    near = with_neighbours(full.withColumn("v", F.coalesce("v", F.lit(0.0))), "v", nx)
    return near.select("level", "loc", "y", "x", lorenzo_bin(F.col("v"), code_near(dims), eb).alias("bin"))


def decode_volume_bins(bins: DataFrame, dims: int, eb: float) -> DataFrame:
    """level, loc, y, x, decoded from bins alone: running sums along x, y and level undo the
    integer Lorenzo code.  A window partition is one line of the box."""
    lines = {"x": ("level", "y"), "y": ("level", "x"), "level": ("loc",)}
    out = bins
    for along in {1: ["level"], 2: ["x", "y"], 3: ["x", "y", "level"]}[dims]:
        line = Window.partitionBy(*lines[along]).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("bin", F.sum("bin").over(line))
    return out.select("level", "loc", "y", "x", error_dequantise(F.col("bin"), F.lit(float(eb))).alias("decoded"))


def plane_residual(cells: DataFrame, value: str = "value", nx: int = NX) -> DataFrame:
    """2-D residual with the first row and column of every level set to 0."""
    df = with_lorenzo(cells, value, nx)
    border = (F.col("x") == 0) | (F.col("y") == 0)
    return df.withColumn(
        "resid", F.when(border, 0.0).otherwise(F.col(value) - F.col("lorenzo_2d"))
    )
