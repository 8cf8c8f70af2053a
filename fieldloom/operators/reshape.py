"""Projection, normalisation, masking, sampling and partitioning of fields."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.sources.grid import NX, GridShape

GUARD = 1e-10


def stride(cells: DataFrame, ds: int, column: str = "x") -> DataFrame:
    """Keep every ``ds``-th position of an axis and renumber it."""
    return cells.where(F.col(column) % ds == 0).withColumn(column, F.expr(f"{column} div {ds}"))


def flat_index(shape: GridShape) -> Column:
    """C-order index of a cell in the full volume."""
    return F.col("level") * (shape.ny * NX) + F.col("y") * NX + F.col("x")


def unit_coordinate(axis: Column | str, extent: int) -> Column:
    """``linspace(0, 1, extent)[axis]``."""
    axis = F.col(axis) if isinstance(axis, str) else axis
    return axis / float(max(extent - 1, 1))


def min_max(df: DataFrame, column: str) -> Column:
    """Min-max scaled column; the extremes come from one scalar subquery each."""
    lo = df.select(F.min(column)).scalar()
    hi = df.select(F.max(column)).scalar()
    return (F.col(column) - lo) / (hi - lo)


def active_mask(cells: DataFrame, n_levels: int, value: str = "value") -> DataFrame:
    """``loc, is_active``: present on every level and not identically zero."""
    return cells.groupBy("loc").agg(
        ((F.count(value) == n_levels) & F.bool_or(F.col(value) != 0)).alias("is_active")
    )


def gather_active(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells at active locations only."""
    return cells.join(mask.where("is_active").select("loc"), "loc", "left_semi")


def full_grid(cells: DataFrame, shape: GridShape) -> DataFrame:
    """Every (level, loc) of the observed locations, without a join between axes."""
    return cells.select("loc").distinct().withColumn(
        "level", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shape.n_levels - 1).cast("bigint")))
    )


def scatter(grid: DataFrame, cells: DataFrame, shape: GridShape, fill: float | None) -> DataFrame:
    """Place the values of ``cells`` on the full grid of ``grid``'s locations; absent
    cells get ``fill``."""
    out = full_grid(grid, shape).join(cells.select("level", "loc", "value"), ["level", "loc"], "left")
    return out if fill is None else out.fillna({"value": fill})


def zscore_by_location(cells: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Add ``z_<field>`` per location, deviation guard 1e-10 -> 1."""
    here = Window.partitionBy("loc")
    for f in fields:
        sd = F.stddev_pop(f).over(here)
        cells = cells.withColumn(
            f"z_{f}",
            (F.col(f) - F.avg(f).over(here)) / F.when(sd < GUARD, 1.0).otherwise(sd),
        )
    return cells


def zscore_global(cells: DataFrame, value: str = "value", guard: float = 1e-8) -> DataFrame:
    """Whole-field standardisation; mean and deviation are scalar subqueries."""
    mean = cells.select(F.avg(value)).scalar()
    sd = cells.select(F.stddev_pop(value)).scalar()
    return cells.withColumn("z", (F.col(value) - mean) / F.when(sd < guard, 1.0).otherwise(sd))


def even_indices(n: int, count: int) -> list[int]:
    """``count`` evenly spread positions of ``0..n-1`` (half-to-even), without repeats."""
    if count <= 1:
        return [0]
    return sorted({round(i * (n - 1) / (count - 1)) for i in range(count)})


def digest(*parts: Column | str | int) -> Column:
    """Stable pseudo-random key of an id under a seed."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("-", *[c.cast("string") for c in cols]))


def uniform(*parts: Column | str | int) -> Column:
    """Uniform draw in [0, 1) fixed by id and seed, equal on every retry."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("double") / float(2**32)


def sample_without_replacement(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in digest order (a top-n, so only n rows per task travel)."""
    return df.withColumn("_d", digest(seed, F.col(key))).orderBy("_d", key).limit(n).drop("_d")


def sample_with_replacement(df: DataFrame, key: str, extent: int, n: int, seed: int) -> DataFrame:
    """``n`` draws of an integer key in ``0..extent-1``; repeated keys repeat rows."""
    draws = df.sparkSession.range(n).select(
        F.col("id").alias("draw"),
        F.floor(uniform(seed, F.col("id")) * extent).cast("bigint").alias(key),
    )
    return draws.join(df, key)


def sample_pairs(df: DataFrame, axes: dict[str, int], n: int, seed: int, tries: int = 32) -> DataFrame:
    """``n`` cells drawn with replacement, uniformly over the existing cells of the box.

    A draw takes its first place that exists among ``tries`` uniform places; only the draws
    travel to the cells' side of the join.  A draw without any, which means a nearly empty box,
    raises when the rows are read: there are never fewer than ``n``.
    """
    places = df.sparkSession.range(n).select(
        F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("_try")
    )
    for a, extent in axes.items():
        places = places.withColumn(a, F.floor(uniform(seed, a, F.col("draw"), F.col("_try")) * extent).cast("bigint"))
    found = places.join(df.withColumn("_there", F.lit(True)), list(axes), "left")
    cell = F.struct(F.col("_try"), F.struct(*df.columns).alias("cell"))
    first = found.groupBy("draw").agg(F.min_by(cell, F.when(F.col("_there"), F.col("_try"))).alias("_first"), F.max("_there").alias("_hit"))
    short = F.raise_error(F.lit(f"a draw met no cell in {tries} places: the box is nearly empty"))
    return first.select("draw", F.when(F.col("_hit"), F.col("_first.cell")).otherwise(short).alias("_cell")).select("draw", "_cell.*")


def latin_hypercube(df: DataFrame, axes: dict[str, int], n: int, seed: int) -> DataFrame:
    """``n`` stratified draws per axis, shuffled against each other, deduplicated and
    matched to existing cells."""
    spark = df.sparkSession
    draws = spark.range(n).select(F.col("id").alias("_i"))
    for a, extent in axes.items():
        # the shuffle of strata is a ranking of n draws, n being the sample size
        draws = draws.withColumn(
            f"_s_{a}", F.row_number().over(Window.orderBy(digest(seed, a, F.col("_i")))) - 1
        ).withColumn(
            a,
            F.floor((F.col(f"_s_{a}") + uniform(seed + 1, a, F.col("_i"))) / n * extent).cast("bigint"),
        )
    return df.join(draws.select(*axes).distinct(), list(axes), "left_semi")


def domain_of(axis: Column, extent: int, parts: int) -> Column:
    """Index of the part of ``[r*extent//parts, (r+1)*extent//parts)`` holding ``axis``."""
    out = F.lit(0).cast("bigint")
    for r in range(1, parts):
        out = F.when(axis >= r * extent // parts, F.lit(r).cast("bigint")).otherwise(out)
    return out


def domain_boxes(ny: int, nx: int, rows: int, cols: int) -> list[tuple[int, int, int, int, int]]:
    """(domain, y_lo, y_hi, x_lo, x_hi), upper ends inclusive."""
    return [
        (r * cols + c, r * ny // rows, (r + 1) * ny // rows - 1, c * nx // cols, (c + 1) * nx // cols - 1)
        for r in range(rows) for c in range(cols)
    ]


def expand_domains(locs: DataFrame, boxes: Sequence[tuple], buffer: float) -> DataFrame:
    """``domain_id`` of every domain whose cells lie nearer than ``buffer``.

    A rectangle of cells is at the distance of its box, so each location tests a few
    boxes instead of being paired with every cell of the domain.
    """
    y, x = F.col("y"), F.col("x")
    hits = []
    for d, y0, y1, x0, x1 in boxes:
        if y1 < y0 or x1 < x0:
            continue
        dy = F.greatest(F.lit(y0) - y, y - y1, F.lit(0))
        dx = F.greatest(F.lit(x0) - x, x - x1, F.lit(0))
        hits.append(F.when(F.sqrt((dy * dy + dx * dx).cast("double")) < buffer, F.lit(d).cast("bigint")))
    return locs.withColumn("domain_id", F.explode(F.array_compact(F.array(*hits))))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def guarded_ratio(num: Column, den: Column) -> Column:
    """NULL where the denominator vanishes."""
    return F.when(den > GUARD, num / den)


def long_form(cells: DataFrame, fields: Sequence[str]) -> DataFrame:
    """level, loc, var, value."""
    return cells.unpivot(["level", "loc"], list(fields), "var", "value")
