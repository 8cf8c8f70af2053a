"""Covariance and distance expressions between every location (or cell) and a few sensors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import kernels as kn
from fieldloom.operators.kernelproduct import kernel_product
from fieldloom.operators.selection import RadialKernel
from fieldloom.plans.common import energetic_locations
from fieldloom.plans.registry import more, query
from fieldloom.session import cut_lineage
from fieldloom.sources.grid import grid_field, grid_shape, residual_field, with_location_mean
from fieldloom.sources.profiles import block, list_column, map_blocks, profiles

LS, VAR = 3.0, 1.5
LSZ, LSXY = 8.0, 3.0


def _literals(rows, names) -> Column:
    """A few collected sensors as a constant array column."""
    return F.array(*[
        F.struct(*[F.lit(int(r[n])).cast("bigint").alias(f"s_{n}") for n in names]) for r in rows
    ])


def planar(spark: SparkSession, sf: str) -> DataFrame:
    """loc, rank, r: every location against the five energetic locations."""
    sensors = energetic_locations(spark, sf).select("rank", "y", "x").collect()
    locs = grid_field(spark, sf).select("loc", "y", "x").distinct()
    pairs = locs.withColumn("s", F.explode(_literals(sensors, ["rank", "y", "x"]))).select("*", "s.*")
    dy, dx = (F.col("y") - F.col("s_y")).cast("double"), (F.col("x") - F.col("s_x")).cast("double")
    return pairs.select("loc", F.col("s_rank").alias("rank"), kn.planar_distance(dy, dx).alias("r"), dy.alias("dy"), dx.alias("dx"))


def volumetric(spark: SparkSession, sf: str) -> DataFrame:
    """level, loc, rank, dz, dy, dx: every cell against the five largest residual cells."""
    f = residual_field(spark, sf).select("level", "loc", "y", "x", "resid")
    top = f.orderBy(F.desc(F.round(F.abs("resid"), 6)), "level", "loc").limit(5).collect()
    rows = [{"rank": i, "level": r["level"], "y": r["y"], "x": r["x"]} for i, r in enumerate(top)]
    pairs = f.withColumn("s", F.explode(_literals(rows, ["rank", "level", "y", "x"]))).select("*", "s.*")
    gap = lambda a: (F.col(a) - F.col(f"s_{a}")).cast("double")
    return pairs.select(
        "level", "loc", F.col("s_rank").alias("rank"), gap("level").alias("dz"), gap("y").alias("dy"), gap("x").alias("dx")
    )


_PL = more("g", "p", "sens") + """pl AS (SELECT l.loc, s.rank, sqrt(((l.y-s.y)**2 + (l.x-s.x)**2)::DOUBLE) AS r
FROM (SELECT DISTINCT loc, y, x FROM g) l, sens s)"""
_VO = more("g", "p") + """s3 AS (SELECT level, y, x, row_number() OVER (ORDER BY round(abs(resid), 6) DESC, level, loc) - 1 AS rank FROM p QUALIFY rank < 5),
vo AS (SELECT c.level, c.loc, s.rank, (c.level-s.level)::DOUBLE AS dz, (c.y-s.y)::DOUBLE AS dy, (c.x-s.x)::DOUBLE AS dx FROM p c, s3 s)"""
_D3 = "sqrt((dz/8.0)**2 + (dy/3.0)**2 + (dx/3.0)**2)"


def _m(nu: float, r: str, ls: str = "1") -> str:
    if nu == 0.5:
        return f"exp(-({r})/{ls})"
    if nu == 1.5:
        return f"((1 + sqrt(3.0::DOUBLE)*({r})/{ls})*exp(-sqrt(3.0::DOUBLE)*({r})/{ls}))"
    s = f"(sqrt(5.0::DOUBLE)*({r})/{ls})"
    return f"((1 + {s} + {s}*{s}/3)*exp(-{s}))"


def _planar_query(name: str, sql: str, build):
    @query(name, _PL + f"SELECT loc, rank, round({sql}, 9) AS k FROM pl")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return planar(spark, sf).select("loc", "rank", F.round(build(F.col("r")), 9).alias("k"))

    return run


c01_rbf = _planar_query("c01_rbf", "1.5*exp(-0.5*r*r/9.0)", lambda r: kn.rbf(r, LS, VAR))
c02_matern12 = _planar_query("c02_matern12", f"1.5*{_m(.5, 'r', '3.0')}", lambda r: kn.matern(r, 0.5, LS, VAR))
c02_matern32 = _planar_query("c02_matern32", f"1.5*{_m(1.5, 'r', '3.0')}", lambda r: kn.matern(r, 1.5, LS, VAR))
c02_matern52 = _planar_query("c02_matern52", f"1.5*{_m(2.5, 'r', '3.0')}", lambda r: kn.matern(r, 2.5, LS, VAR))
c03_matern32_unit = _planar_query("c03_matern32_unit", _m(1.5, "r", "3.0"), lambda r: kn.kernel("matern32")(r, ls=LS))


def _volume_query(name: str, sql: str, build):
    @query(name, _VO + f"SELECT level, loc, rank, round({sql}, 9) AS k FROM vo")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        dz, dy, dx = F.col("dz"), F.col("dy"), F.col("dx")
        return volumetric(spark, sf).select("level", "loc", "rank", F.round(build(dz, dy, dx), 9).alias("k"))

    return run


def _scaled(dz, dy, dx):
    return kn.scaled_distance(dz, dy, dx, LSZ, LSXY)


c04_vertical = _volume_query("c04_vertical", _m(1.5, "abs(dz)", "8.0"), lambda z, y, x: kn.matern(F.abs(z), 1.5, LSZ))
c05_anisotropic = _volume_query("c05_anisotropic", _D3, _scaled)
c06_scaled_matern52 = _volume_query("c06_scaled_matern52", _m(2.5, _D3), lambda z, y, x: kn.matern(_scaled(z, y, x), 2.5))
c06_scaled_matern32 = _volume_query("c06_scaled_matern32", _m(1.5, _D3), lambda z, y, x: kn.matern(_scaled(z, y, x), 1.5))
c06_scaled_matern12 = _volume_query("c06_scaled_matern12", _m(0.5, _D3), lambda z, y, x: kn.matern(_scaled(z, y, x), 0.5))
c07_multiscale = _volume_query("c07_multiscale", f"{_m(2.5, _D3)} + 0.5*{_m(2.5, _D3, '0.2')}",
                               lambda z, y, x: kn.multiscale(_scaled(z, y, x), 1.0, 0.2, 1.0, 0.5))
c08_separable = _volume_query("c08_separable", f"1.5*{_m(2.5, 'abs(dz)', '8.0')}*{_m(2.5, 'sqrt(dy*dy+dx*dx)', '3.0')}",
                              lambda z, y, x: kn.separable(z, y, x, LSZ, LSXY, VAR))


@query("c10_matvec_sensors", _PL + f"SELECT loc, round(sum({_m(1.5, 'r', '3.0')}*mu), 4) AS kv FROM pl JOIN (SELECT rank, mu FROM sens) USING (rank) GROUP BY loc")
def c10_matvec_sensors(spark: SparkSession, sf: str) -> DataFrame:
    """K(points, sensors) times a vector: a narrow row-block product."""
    s = energetic_locations(spark, sf).orderBy("rank").collect()
    xy, v = np.array([[r["y"], r["x"]] for r in s], float), np.array([r["mu"] for r in s])
    locs = grid_field(spark, sf).select("loc", "y", "x").distinct()

    def product(b):
        gap = [np.subtract.outer(b.column(c).to_numpy().astype(float), xy[:, i]) for i, c in enumerate(("y", "x"))]
        return [b.column("loc"), kn.matern(np.sqrt(gap[0] ** 2 + gap[1] ** 2), 1.5, LS, m=np) @ v]

    out = map_blocks(locs, ["loc", "y", "x"], "loc bigint, kv double", product)
    return out.select("loc", F.round("kv", 4).alias("kv"))


@query("c10_matvec_locations", more("g", "p") + f"""l AS (SELECT DISTINCT loc, y, x, mu FROM p)
SELECT a.loc, round(sum({_m(1.5, 'sqrt(((a.y-b.y)**2+(a.x-b.x)**2)::DOUBLE)', '3.0')}*b.mu), 3) + 0.0 AS kv FROM l a, l b GROUP BY a.loc""")
def c10_matvec_locations(spark: SparkSession, sf: str) -> DataFrame:
    """The whole covariance of locations times any vector, by pairs of tiles."""
    at = with_location_mean(grid_field(spark, sf)).select("loc", "y", "x", "mu").distinct()
    points = cut_lineage(at.select(F.col("loc").alias("id"), F.array(F.col("y").cast("double"), F.col("x").cast("double")).alias("x"),
                                   F.array("mu").alias("v")))
    out = kernel_product(points.select("id", "x"), points, RadialKernel(kn.matern, nu=1.5, ls=LS), points.count())
    return out.select(F.col("id").alias("loc"), (F.round(F.col("y")[0], 3) + 0.0).alias("kv"))


@query("c10_matvec_levels", more("g", "p") + f"""SELECT a.level, l.loc, round(sum({_m(2.5, 'abs(a.level - b.level)::DOUBLE', '4.0')}*b.resid), 4) + 0.0 AS kv
FROM (SELECT range AS level FROM range(0, (SELECT max(level)+1 FROM g))) a, (SELECT DISTINCT loc FROM g) l JOIN p b ON b.loc = l.loc GROUP BY a.level, l.loc""")
def c10_matvec_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The vertical factor of a separable covariance applied to every profile: the full
    n x n product along one axis without forming the matrix of the field."""
    nl = grid_shape(spark, sf).n_levels
    z = np.arange(nl, dtype=float)
    k = kn.matern(np.abs(np.subtract.outer(z, z)), 2.5, 4.0, m=np)
    prof = profiles(grid_field(spark, sf), nl)
    out = map_blocks(prof, ["loc", "vec"], "loc bigint, kv array<double>", lambda b: [b.column("loc"), list_column(block(b, "vec") @ k)])
    return out.select("loc", F.posexplode("kv").alias("level", "v")).select(
        F.col("level").cast("bigint").alias("level"), "loc", (F.round("v", 4) + 0.0).alias("kv")
    )


@query("c11_median_distance", more("g", "p", "sens").replace("rank < 5", "rank < 10") + """d AS (SELECT sqrt(((a.y-b.y)**2+(a.x-b.x)**2)::DOUBLE) AS d FROM sens a, sens b)
SELECT round(median(d), 9) AS median_dist, round(median(d)/3, 9) AS ls0 FROM d WHERE d > 0""")
def c11_median_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Start value of a length scale: median positive distance among ten sensors."""
    s = energetic_locations(spark, sf, 10).select("y", "x")
    each = F.explode("all")
    packed = s.agg(F.collect_list(F.struct("y", "x")).alias("all"))
    pairs = packed.select(each.alias("a"), "all").select("a", each.alias("b"))
    d = kn.planar_distance(F.col("a.y") - F.col("b.y"), F.col("a.x") - F.col("b.x"))
    med = F.percentile("d", 0.5)
    return pairs.select(d.alias("d")).where("d > 0").agg(
        F.round(med, 9).alias("median_dist"), F.round(med / 3, 9).alias("ls0")
    )
