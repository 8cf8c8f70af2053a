"""Stencils over the grid by tiling with halos.

``loc`` is cut into fixed-width tiles and border rows are copied into the adjoining
tile, so every stencil is one shuffle and one sort however large a level is, and a
window partition never exceeds a tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.sources.grid import NX

TILE = 256


def _tiled(df: DataFrame, before: int, after: int, tile: int) -> DataFrame:
    home = F.expr(f"loc div {tile}")
    start = home * tile
    # Conditional membership of the neighbouring tiles; array_compact drops the absent ones.
    tiles = F.array_compact(F.array(
        home,
        F.when(F.col("loc") >= start + (tile - before), home + 1) if before else F.lit(None).cast("bigint"),
        F.when((F.col("loc") < start + after) & (home > 0), home - 1) if after else F.lit(None).cast("bigint"),
    ))
    return (
        df.withColumn("_home", home)
        .withColumn("_tile", F.explode(tiles))
        .withColumn("_local", F.col("loc") - F.col("_tile") * tile + before)
    )


def with_stencil(
    df: DataFrame,
    columns: dict[str, tuple[Column, str, int, int, int]],
    tile: int = TILE,
) -> DataFrame:
    """Add stencil aggregates.

    ``columns[name] = (expr, how, dlevel, lo, hi)`` aggregates ``expr`` with ``how``
    (``sum``, ``max`` or ``count``) over the cells of level ``level + dlevel`` whose
    ``loc`` lies in ``[loc + lo, loc + hi]``; NULL when there is none.
    """
    before = max(0, -min(c[3] for c in columns.values()))
    after = max(0, max(c[4] for c in columns.values()))
    tile = max(tile, 2 * before, 2 * after)  # wider than the stencil on a grid of any width
    t = _tiled(df, before, after, tile)
    span = tile + before + after
    if any(c[2] for c in columns.values()):
        stride = 2 * span
        base = Window.partitionBy("_tile").orderBy(F.col("level") * stride + F.col("_local"))
    else:
        stride = 0
        base = Window.partitionBy("_tile", "level").orderBy("_local")
    agg = {"sum": F.sum, "max": F.max, "count": F.count}
    out = t.select(
        "*",
        *[
            agg[how](expr).over(base.rangeBetween(dl * stride + lo, dl * stride + hi)).alias(name)
            for name, (expr, how, dl, lo, hi) in columns.items()
        ],
    )
    return out.where(F.col("_home") == F.col("_tile")).drop("_home", "_tile", "_local")


def point(expr: Column, dlevel: int = 0, dy: int = 0, dx: int = 0, nx: int = NX):
    """Stencil entry reading exactly one neighbour (mask x-borders yourself)."""
    off = dy * nx + dx
    return (expr, "max", dlevel, off, off)


def row_run(expr: Column, dy: int, x_lo: int, x_hi: int, how: str = "sum", nx: int = NX):
    """Stencil entry aggregating a run of x positions on row ``y + dy``."""
    return (expr, how, 0, dy * nx + x_lo, dy * nx + x_hi)


def inside(dx: Column | int, nx: int = NX) -> Column:
    """True where ``x + dx`` stays on the row of ``nx`` cells."""
    target = F.col("x") + dx
    return (target >= 0) & (target < nx)
