"""Sensor placement."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions import kernels as kn
from fieldloom.operators import checkpoint as cp
from fieldloom.operators import decompose as dc
from fieldloom.operators import kernelproduct as kp
from fieldloom.operators import reshape as rs
from fieldloom.operators import selection as sl
from fieldloom.operators.metrics import quality
from fieldloom.operators.quantiles import exact_quantiles
from fieldloom.plans.common import energetic_locations
from fieldloom.plans.fitting import location_points, stored_profiles
from fieldloom.plans.kernels import _m
from fieldloom.plans.quantise import _TOPK, level_sensors
from fieldloom.plans.registry import ctes, more, query
from fieldloom.session import _ensure_checkpoint_dir, cut_lineage, sized_broadcast
from fieldloom.sources.grid import FIELDS, grid_field, grid_shape, residual_field

MATERN = sl.RadialKernel(kn.matern, nu=2.5, ls=3.0)
CANDIDATES = 500  # of the oracle placement, as many as the grid has at most


def _points(spark: SparkSession, sf: str) -> DataFrame:
    locs = grid_field(spark, sf).select("loc", "y", "x").distinct()
    return cut_lineage(location_points(locs))


def _rank_id(picks: sl.Picks, spark: SparkSession, key: str = "loc") -> DataFrame:
    return picks.to_frame(spark).select("rank", F.col("id").alias(key), F.round("score", 6).alias("score"))


def _pivot_sql(points: str, kern, prior: str, k: int) -> str:
    """Pivoted Cholesky unrolled: ``kern(a, b)`` is the covariance of two aliases."""
    out = [points, f"d0 AS (SELECT *, {prior} AS d FROM l a)"]
    for j in range(k):

        out.append(f"p{j} AS (SELECT * FROM d{j} ORDER BY round(d, 9) DESC, loc LIMIT 1)")
        dot = "".join(f" - a.f{i}*b.f{i}" for i in range(j))
        out.append(f"e{j} AS (SELECT a.*, ({kern('a', 'b')}{dot})/sqrt(b.d) AS f{j} FROM d{j} a, p{j} b)")
        out.append(f"d{j + 1} AS (SELECT * REPLACE (greatest(d - f{j}*f{j}, 0) AS d) FROM e{j})")

    rows = " UNION ALL ".join(f"SELECT {j}::BIGINT AS rank, loc, round(d, 6) AS score FROM p{j}" for j in range(k))
    return ",\n".join(out) + "\n" + rows


_DIST = "sqrt(((a.y-b.y)**2 + (a.x-b.x)**2)::DOUBLE)"
_LOCS = "l AS (SELECT DISTINCT loc, y, x FROM g)"
_FEAT = """m AS (SELECT loc, avg(value) AS a, avg(f_quantity) AS b, avg(f_discount) AS c FROM g GROUP BY loc),
l AS (SELECT loc, (a-(SELECT avg(a) FROM m))/(SELECT stddev_pop(a) FROM m) AS a, (b-(SELECT avg(b) FROM m))/(SELECT stddev_pop(b) FROM m) AS b, (c-(SELECT avg(c) FROM m))/(SELECT stddev_pop(c) FROM m) AS c FROM m)"""


@query("n01_pivoted_qr", more("g") + _pivot_sql(_FEAT, lambda a, b: f"{a}.a*{b}.a + {a}.b*{b}.b + {a}.c*{b}.c", "a.a*a.a + a.b*a.b + a.c*a.c", 3))
def n01_pivoted_qr(spark: SparkSession, sf: str) -> DataFrame:
    """Pivoted QR over three mode columns (standardised location means)."""
    m = grid_field(spark, sf).groupBy("loc").agg(*[F.avg(f).alias(f) for f in FIELDS])
    z = [(F.col(f) - m.select(F.avg(f)).scalar()) / m.select(F.stddev_pop(f)).scalar() for f in FIELDS]
    modes = cut_lineage(m.select(F.col("loc").alias("id"), F.array(*z).alias("x")))
    return _rank_id(sl.qdeim(modes, 3), spark)


@query("n01_qdeim_basis")
def n01_qdeim_basis(spark: SparkSession, sf: str) -> DataFrame:
    """Q-DEIM sensors of the SVD basis with both conditioning constants."""
    shape = grid_shape(spark, sf)
    prof = stored_profiles(spark, sf)
    k = min(10, max(1, shape.n_locs // 3))
    basis = dc.svd_basis(prof, shape.n_levels, k)
    picks = sl.qdeim(dc.spatial_modes(prof, basis, k), k)
    return _rank_id(picks, spark).withColumns({
        "lambda_2": F.lit(sl.deim_constant(picks.rows)), "lambda_f": F.lit(sl.deim_constant(picks.rows, "frobenius")),
    })


@query("n02_gks_random")
def n02_gks_random(spark: SparkSession, sf: str) -> DataFrame:
    """Column subset through a randomly pivoted factor."""
    return _rank_id(sl.gks(_points(spark, sf), MATERN, 8, 8, "random", 42), spark)


@query("n03_gks_greedy")
def n03_gks_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """Column subset through a greedily pivoted factor (deterministic)."""
    return _rank_id(sl.gks(_points(spark, sf), MATERN, 8, 8, "greedy"), spark)


_SQUARE = f"""kk AS (SELECT a.loc AS i, b.loc AS j, {_m(2.5, _DIST, "3.0")} AS k FROM l a, l b),
gr AS (SELECT a.i, b.j, sum(a.k*b.k) AS g FROM kk a JOIN kk b ON a.j = b.i GROUP BY a.i, b.j)"""


@query("n03_direct_qr", more("g") + _pivot_sql(f"{_LOCS},\n{_SQUARE}", lambda a, b: f"(SELECT g FROM gr WHERE i = {a}.loc AND j = {b}.loc)",
                                               "(SELECT g FROM gr WHERE i = a.loc AND j = a.loc)", 8))
def n03_direct_qr(spark: SparkSession, sf: str) -> DataFrame:
    """Pivoted QR of the covariance matrix itself."""
    return _rank_id(kp.direct_qr(_points(spark, sf), MATERN, 8), spark)


@query("n06_random_pivots")
def n06_random_pivots(spark: SparkSession, sf: str) -> DataFrame:
    """Randomly pivoted Cholesky pivots without a QR stage."""
    picks = sl.random_select(_points(spark, sf), sl.CholeskyScore(MATERN), 16, 42)
    return _rank_id(picks, spark)


@query("e06_extended_factor", more("g") + _pivot_sql(_LOCS, lambda a, b: _m(2.5, _DIST, "3.0"), "1.0::DOUBLE", 6))
def e06_extended_factor(spark: SparkSession, sf: str) -> DataFrame:
    """Sensors of a stored factor of three that was extended to six, read back from the store."""
    _ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/factors/{uuid.uuid4().hex}"
    points = _points(spark, sf)
    for k in (3, 6):
        cp.factor_at(spark, path, points, MATERN, 1e-3, k)
    factor = cp.load(spark, path)
    return _rank_id(sl.Picks(factor.ids, factor.coords, factor.scores), spark)


@query("n08_greedy_pivots", more("g") + _pivot_sql(_LOCS, lambda a, b: _m(2.5, _DIST, "3.0"), "1.0::DOUBLE", 4))
def n08_greedy_pivots(spark: SparkSession, sf: str) -> DataFrame:
    return _rank_id(sl.greedy_select(_points(spark, sf), sl.CholeskyScore(MATERN), 4), spark)


def _maxmin_sql(k: int) -> str:
    out = [_LOCS, "p0 AS (SELECT * FROM l ORDER BY loc LIMIT 1)", f"d0 AS (SELECT a.*, {_DIST} AS d FROM l a, p0 b)"]
    for j in range(1, k):
        out.append(f"p{j} AS (SELECT * FROM d{j - 1} ORDER BY round(d, 9) DESC, loc LIMIT 1)")
        out.append(f"d{j} AS (SELECT a.* REPLACE (least(a.d, {_DIST}) AS d) FROM d{j - 1} a, p{j} b)")
    rows = ["SELECT 0::BIGINT AS rank, loc, -1.0::DOUBLE AS score FROM p0"]
    rows += [f"SELECT {j}, loc, round(d, 6) FROM p{j}" for j in range(1, k)]
    return ",\n".join(out) + "\n" + " UNION ALL ".join(rows)


@query("n09_farthest_points", more("g") + _maxmin_sql(6))
def n09_farthest_points(spark: SparkSession, sf: str) -> DataFrame:
    r = _rank_id(sl.maxmin(_points(spark, sf), 6), spark)
    return r.withColumn("score", F.when(F.col("rank") == 0, -1.0).otherwise(F.col("score")))


@query("n10_greedy_error")
def n10_greedy_error(spark: SparkSession, sf: str) -> DataFrame:
    """Oracle placement over a bounded candidate sample."""
    prof = stored_profiles(spark, sf)
    cand = rs.sample_without_replacement(prof.select("loc", "y", "x"), "loc", CANDIDATES, 1).toPandas().to_numpy()
    ids = sl.greedy_error(prof, 6, cand, sl.RadialKernel(kn.matern, nu=1.5, ls=2.0), 1e-2)
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(ids)], "rank bigint, loc bigint")


@query("n11_greedy_coregional")
def n11_greedy_coregional(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy placement for several correlated fields."""
    z = rs.zscore_by_location(grid_field(spark, sf), FIELDS)
    b = np.zeros((3, 3))
    for r in dc.cross_field(z, FIELDS).collect():
        b[r["i"], r["j"]] = r["b_ij"]
    score = sl.CoregionalScore(np.linalg.eigvalsh(b), MATERN, 1e-2)
    return _rank_id(sl.greedy_select(_points(spark, sf), score, 8), spark)


@query("n12_top_residual", _TOPK + """SELECT level, loc, row_number() OVER (PARTITION BY level ORDER BY round(abs(resid), 6) DESC, loc) AS rank FROM t""")
def n12_top_residual(spark: SparkSession, sf: str) -> DataFrame:
    return level_sensors(spark, sf).select("level", "loc", "rank")


@query("n13_worst_quartile", more("g", "p") + """q AS (SELECT level, quantile_cont(abs(resid), 0.75) AS q FROM p GROUP BY level)
SELECT level, loc, round(resid, 6) AS resid FROM p JOIN q USING (level) WHERE abs(resid) >= q""")
def n13_worst_quartile(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates at or above the 75th percentile of |error| on their level."""
    f = residual_field(spark, sf)
    nl = grid_shape(spark, sf).n_levels
    q = exact_quantiles(f, F.abs("resid"), [0.75], ["level"], nl).select("level", "q")
    return f.join(sized_broadcast(q, nl), "level").where(F.abs("resid") >= F.col("q")).select(
        "level", "loc", F.round("resid", 6).alias("resid")
    )


@query("n15_level_selection", more("g", "p", "sh") + """u AS (SELECT DISTINCT round_even(range*(sh.nl-1)/3.0::DOUBLE, 0)::BIGINT AS level FROM range(0, 4), sh),
r AS (SELECT level, round(sqrt(avg(resid**2)), 6) AS rmse FROM p GROUP BY level)
SELECT level, rmse, row_number() OVER (ORDER BY rmse DESC, level) AS rank FROM r WHERE level NOT IN (SELECT level FROM u) QUALIFY rank <= 4""")
def n15_level_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Four evenly spread levels are used; the worst four of the rest follow."""
    used = rs.even_indices(grid_shape(spark, sf).n_levels, 4)
    rmse = quality(residual_field(spark, sf), "value", "mu", ["level"]).select("level", F.round("rmse", 6).alias("rmse"))
    worst = sl.worst_unused_levels(rmse, spark.createDataFrame([(u,) for u in used], "level bigint"), 4)
    rank = F.row_number().over(Window.orderBy(F.desc("rmse"), "level")).cast("bigint")
    return worst.select("level", "rmse", rank.alias("rank"))


@query("n16_uniform_placement", more("g", "p", "sh") + """u AS (SELECT DISTINCT round_even(range*(sh.n-1)/7.0::DOUBLE, 0)::BIGINT AS loc FROM range(0, 8), sh)
SELECT level, loc, round(resid, 6) AS reading FROM p JOIN u USING (loc)""")
def n16_uniform_placement(spark: SparkSession, sf: str) -> DataFrame:
    """Eight evenly spread sensors and their readings."""
    ids = rs.even_indices(grid_shape(spark, sf).n_locs, 8)
    return residual_field(spark, sf).where(F.col("loc").isin(ids)).select("level", "loc", F.round("resid", 6).alias("reading"))


@query("n17_prefix", ctes("g", "p", "sens") + "SELECT rank, loc FROM sens WHERE rank < 3")
def n17_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """First three of an ordered sensor list."""
    return energetic_locations(spark, sf).where(F.col("rank") < 3).select("rank", "loc")
