"""Bases, spectra, cross-field covariance and hyper-parameter fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import kernels as kn
from fieldloom.operators import decompose as dc
from fieldloom.operators import kernelproduct as kp
from fieldloom.operators import likelihood as lk
from fieldloom.operators import reshape as rs
from fieldloom.operators import selection as sl
from fieldloom.plans.common import energetic_locations
from fieldloom.plans.kernels import _m
from fieldloom.plans.registry import more, query
from fieldloom.plans.reshape import Z_SQL
from fieldloom.session import cut_lineage, sized_broadcast
from fieldloom.sources.grid import FIELDS, NX, grid_field, grid_shape, residual_field
from fieldloom.sources.profiles import block, collect_matrix, profiles, sum_blocks

# Points behind a fit, as many as the grid has at most: planar, pooled pairs, cells, fields, profiles.
SAMPLE, PAIRS, CELLS, COREGIONAL, PROFILES = 2000, 2000, 1500, 500, 200
STARTS = 3


def field_profiles(spark: SparkSession, sf: str, value: str = "value") -> DataFrame:
    return profiles(grid_field(spark, sf), grid_shape(spark, sf).n_levels, value)


def stored_profiles(spark: SparkSession, sf: str, value: str = "value") -> DataFrame:
    """Profile rows written once, for operators that pass over them several times."""
    return cut_lineage(field_profiles(spark, sf, value))


def location_points(prof: DataFrame) -> DataFrame:
    """id, x = (y, x) of every location."""
    return prof.select(F.col("loc").alias("id"), F.array(F.col("y").cast("double"), F.col("x").cast("double")).alias("x"))


@query("f01_gram", more("g", "p") + """SELECT a.level AS i, b.level AS j, round(sum(a.resid*b.resid)/1e6, 3) + 0.0 AS g FROM p a JOIN p b USING (loc) GROUP BY 1, 2""")
def f01_gram(spark: SparkSession, sf: str) -> DataFrame:
    g = dc.gram(field_profiles(spark, sf), grid_shape(spark, sf).n_levels)
    return g.select("i", "j", (F.round(F.col("v") / 1e6, 3) + 0.0).alias("g"))


@query("f01_singular_values")
def f01_singular_values(spark: SparkSession, sf: str) -> DataFrame:
    """Spectrum, with the largest departure of the spatial modes from orthonormality."""
    nl = grid_shape(spark, sf).n_levels
    prof = stored_profiles(spark, sf)
    k = min(20, grid_shape(spark, sf).n_locs - 1)
    basis = dc.svd_basis(prof, nl, k)
    modes = dc.spatial_modes(prof, basis, k)
    gap = collect_matrix(sum_blocks(modes, ["x"], (k, k), lambda b: (lambda m: m.T @ m)(block(b, "x"))), (k, k)) - np.eye(k)
    rows = [(i, float(s), float(np.abs(gap).max())) for i, s in enumerate(basis.s)]
    return spark.createDataFrame(rows, "rank bigint, s double, orthonormality_gap double")


_SP = more("g", "p") + """e AS (SELECT level, sqrt(sum(resid**2)) AS s FROM p GROUP BY level),
sp AS (SELECT row_number() OVER (ORDER BY round(s, 6) DESC, level) AS rank, s FROM e)"""


def axis_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """Energy per level in descending order: the spectrum of axis-aligned modes."""
    from pyspark.sql import Window

    e = residual_field(spark, sf).groupBy("level").agg(F.sqrt(F.sum(F.col("resid") * F.col("resid"))).alias("s"))
    order = Window.orderBy(F.desc(F.round("s", 6)), "level")
    return e.select(F.row_number().over(order).cast("bigint").alias("rank"), "s")


@query("f02_energy_rank", _SP + """, c AS (SELECT rank, s, sqrt(greatest(1 - sum(s*s) OVER (ORDER BY rank)/sum(s*s) OVER (), 0)) AS e FROM sp)
SELECT rank, round(s, 6) AS s, round(e, 6) AS proj_err, least(coalesce((SELECT min(rank) FROM c WHERE round(e, 9) <= 0.5), (SELECT max(rank) FROM c)), 70) AS chosen FROM c""")
def f02_energy_rank(spark: SparkSession, sf: str) -> DataFrame:
    r = dc.energy_rank(axis_spectrum(spark, sf), 0.5, 70)
    return r.select("rank", F.round("s", 6).alias("s"), F.round("proj_err", 6).alias("proj_err"), F.col("chosen").cast("bigint").alias("chosen"))


@query("f03_variance_explained", _SP + "SELECT rank, round(sum(s*s) OVER (ORDER BY rank)/sum(s*s) OVER (), 9) AS explained FROM sp")
def f03_variance_explained(spark: SparkSession, sf: str) -> DataFrame:
    r = dc.energy_rank(axis_spectrum(spark, sf), 0.5, 70)
    return r.select("rank", F.round(F.lit(1.0) - F.col("proj_err") * F.col("proj_err"), 9).alias("explained"))


@query("f04_randomised_basis")
def f04_randomised_basis(spark: SparkSession, sf: str) -> DataFrame:
    """Sketched spectrum beside the exact one."""
    nl = grid_shape(spark, sf).n_levels
    prof = stored_profiles(spark, sf)
    exact, rough = dc.svd_basis(prof, nl, 5), dc.randomised_basis(prof, nl, 5, 20, 3)
    rows = [(i, float(a), float(b), float(b / a)) for i, (a, b) in enumerate(zip(exact.s, rough.s))]
    return spark.createDataFrame(rows, "rank bigint, s double, s_sketch double, ratio double")


@query("f05_operator_spectrum")
def f05_operator_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """Leading eigenvalues of the location covariance, which is never formed."""
    lam, _ = kp.randomised_eigen(location_points(field_profiles(spark, sf)), sl.RadialKernel(kn.rbf, ls=4.0), 10, power=2)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(lam)], "rank bigint, eigenvalue double")


@query("f06_volume_modes", more("g", "p") + """u AS (SELECT level, avg(resid) AS u1, avg(f_quantity) AS u2 FROM p GROUP BY level), v AS (SELECT loc, avg(value) AS v1, avg(f_discount) AS v2 FROM g GROUP BY loc)
SELECT level, loc, round(u1*v1/1e6, 4) + 0.0 AS m1, round(u2*v2, 6) AS m2 FROM u, v""")
def f06_volume_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Rank-1 volume modes: level factor times location factor, on the full grid."""
    f = residual_field(spark, sf)
    u = f.groupBy("level").agg(F.avg("resid").alias("u1"), F.avg("f_quantity").alias("u2"))
    v = f.groupBy("loc").agg(F.avg("value").alias("v1"), F.avg("f_discount").alias("v2"))
    shape = grid_shape(spark, sf)
    m = rs.full_grid(f, shape).join(v, "loc").join(sized_broadcast(u, shape.n_levels), "level")
    return m.select(
        "level", "loc", (F.round(F.col("u1") * F.col("v1") / 1e6, 4) + 0.0).alias("m1"),
        F.round(F.col("u2") * F.col("v2"), 6).alias("m2"),
    )


@query("f07_absolute_tolerance", more("g", "p", "sh") + """z AS (SELECT loc, CASE WHEN stddev_pop(value) < 1e-10 THEN 1 ELSE stddev_pop(value) END AS sd, sum(resid**2) AS e FROM p GROUP BY loc),
a AS (SELECT sqrt(sum(e/(sd*sd))) AS fro, sqrt(avg(sd*sd)) AS rms FROM z)
SELECT t AS abs_tol, round(greatest(1e-14, least(1.0, t*sqrt((sh.nl*sh.n)::DOUBLE)/(fro*rms))), 9) AS tol_rel FROM a, sh, (VALUES (500.0::DOUBLE), (5000.0), (50000.0)) v(t)""")
def f07_absolute_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    nl, n = grid_shape(spark, sf)
    per = field_profiles(spark, sf).select("sd", F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v).alias("e"))
    row = per.agg(
        F.sqrt(F.sum(F.col("e") / (F.col("sd") * F.col("sd")))).alias("fro"),
        F.sqrt(F.avg(F.col("sd") * F.col("sd"))).alias("rms"),
    ).withColumn("abs_tol", F.explode(F.array(*[F.lit(t) for t in (500.0, 5000.0, 50000.0)])))
    tol = F.col("abs_tol") * float(np.sqrt(nl * n)) / (F.col("fro") * F.col("rms"))
    return row.select("abs_tol", F.round(F.greatest(F.lit(1e-14), F.least(F.lit(1.0), tol)), 9).alias("tol_rel"))


def _sample(spark: SparkSession, sf: str, n: int = SAMPLE):
    """Coordinates and standardised profiles of a bounded random sample of locations."""
    rows = rs.sample_without_replacement(
        field_profiles(spark, sf).select("loc", "y", "x", "sd", "vec"), "loc", n, 42
    ).toPandas()
    xy = rows[["y", "x"]].to_numpy(float)
    return xy, np.stack(rows["vec"].to_numpy()) / rows["sd"].to_numpy()[:, None]


# Search boxes of log length scale, log variance and log noise.
BOX_LS, BOX_VAR, BOX_NOISE = (-2.3, 6.9), (-4.6, 9.2), (-13.8, 2.3)
BOX_VAR_SLICES, BOX_LS_LMC_LOW = (-5.0, 5.0), -1.0


@query("f08_fit_planar")
def f08_fit_planar(spark: SparkSession, sf: str) -> DataFrame:
    """Length scale, variance and noise of a planar process, averaged over the levels."""
    xy, y = _sample(spark, sf)
    found = lk.fit(spark, lk.Isotropic(xy, y, 1.5), [BOX_LS, BOX_VAR, BOX_NOISE], STARTS)
    return lk.fit_frame(spark, ["ls", "var", "noise"], found, len(xy))


@query("f09_fit_fixed_noise")
def f09_fit_fixed_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Length scale and variance at fixed noise, averaged over all slices."""
    xy, y = _sample(spark, sf)
    found = lk.fit(spark, lk.Isotropic(xy, y, 1.5, 1e-3), [BOX_LS, BOX_VAR_SLICES], STARTS)
    return lk.fit_frame(spark, ["ls", "var"], found, len(xy))


def _cell_sample(spark: SparkSession, sf: str, n: int):
    shape = grid_shape(spark, sf)
    axes = {"level": shape.n_levels, "y": shape.ny, "x": NX}
    pdf = rs.latin_hypercube(residual_field(spark, sf), axes, n, 0).select("level", "y", "x", "resid").toPandas()
    x = pdf[["level", "y", "x"]].to_numpy(float) / np.maximum([shape.n_levels - 1, shape.ny - 1, NX - 1], 1)
    y = pdf["resid"].to_numpy()
    return x, (y - y.mean()) / (y.std() or 1.0)


@query("f10_fit_anisotropic")
def f10_fit_anisotropic(spark: SparkSession, sf: str) -> DataFrame:
    """Vertical and horizontal scale, variance and noise on a Latin-hypercube sample."""
    x, y = _cell_sample(spark, sf, CELLS)
    found = lk.fit(spark, lk.Anisotropic(x, y), [(-4.6, 2.3), (-4.6, 2.3), (-4.6, 2.3), BOX_NOISE], STARTS + 1)
    return lk.fit_frame(spark, ["ls_z", "ls_xy", "var", "noise"], found, len(x))


@query("f11_fit_pooled_pairs")
def f11_fit_pooled_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Scale, variance and noise on pooled (snapshot, pixel) pairs; the fitted noise is kept."""
    g = rs.zscore_by_location(grid_field(spark, sf), ["value"]).select("loc", "level", "y", "x", "z_value")
    shape = grid_shape(spark, sf)
    pdf = rs.sample_pairs(g, {"level": shape.n_levels, "loc": shape.n_locs}, PAIRS, 4).toPandas()
    xy, y = pdf[["y", "x"]].to_numpy(float), pdf["z_value"].to_numpy()
    found = lk.fit(spark, lk.Isotropic(xy, y, 2.5), [BOX_LS, BOX_VAR_SLICES, BOX_NOISE], STARTS + 1)
    return lk.fit_frame(spark, ["ls", "var", "noise"], found, len(xy))


@query("f13_fit_coregional")
def f13_fit_coregional(spark: SparkSession, sf: str) -> DataFrame:
    """Length scale of the shared spatial factor of a three-field model over all levels."""
    z = rs.zscore_by_location(grid_field(spark, sf), FIELDS)
    b = np.zeros((3, 3))
    for r in dc.cross_field(z, FIELDS).collect():
        b[r["i"], r["j"]] = r["b_ij"]
    locs = rs.sample_without_replacement(z.select("loc").distinct(), "loc", COREGIONAL, 42)
    # a bounded sample of locations, on every level
    pdf = z.join(sized_broadcast(locs, COREGIONAL), "loc").toPandas()
    where = pdf[["loc", "y", "x"]].drop_duplicates("loc").sort_values("loc")
    xy = where[["y", "x"]].to_numpy(float)
    y = np.zeros((int(pdf["level"].max()) + 1, len(xy), len(FIELDS)))
    y[pdf["level"], np.searchsorted(where["loc"], pdf["loc"])] = pdf[[f"z_{f}" for f in FIELDS]].to_numpy()
    top = float(np.log(3 * max(np.ptp(xy[:, 0]), np.ptp(xy[:, 1]), 1.0)))
    middle = float(np.log(np.median(sl.distance_matrix(xy, xy)[np.triu_indices(len(xy), 1)]) / 3)) if len(xy) > 1 else 0.0
    found = lk.fit(spark, lk.Coregional(xy, y, b, 1.5, 1e-2), [(BOX_LS_LMC_LOW, top)], STARTS, [middle])
    return lk.fit_frame(spark, ["ls"], found, len(xy))


_B = more("g") + Z_SQL + """, l AS (SELECT level, loc, unnest([0, 1, 2]) AS i, unnest([z_value, z_f_quantity, z_f_discount]) AS v FROM z),
b AS (SELECT a.i, c.i AS j, avg(a.v*c.v) + CASE WHEN a.i = c.i THEN 1e-6 ELSE 0 END AS b FROM l a JOIN l c USING (level, loc) GROUP BY a.i, c.i)"""


@query("f14_cross_field", _B + "SELECT i::BIGINT AS i, j::BIGINT AS j, round(b, 9) AS b_ij, round(b/2, 9) AS b_half FROM b")
def f14_cross_field(spark: SparkSession, sf: str) -> DataFrame:
    z = rs.zscore_by_location(grid_field(spark, sf), FIELDS)
    return dc.cross_field(z, FIELDS).select("i", "j", F.round("b_ij", 9).alias("b_ij"), F.round(F.col("b_ij") / 2, 9).alias("b_half"))


@query("f15_field_correlation", _B + """SELECT a.i::BIGINT AS i, a.j::BIGINT AS j, round(a.b/sqrt(x.b*y.b), 9) AS corr FROM b a JOIN b x ON x.i = a.i AND x.j = a.i JOIN b y ON y.i = a.j AND y.j = a.j""")
def f15_field_correlation(spark: SparkSession, sf: str) -> DataFrame:
    z = rs.zscore_by_location(grid_field(spark, sf), FIELDS)
    return dc.cross_field(z, FIELDS).select("i", "j", F.round("corr", 9).alias("corr"))


@query("f16_fit_vertical")
def f16_fit_vertical(spark: SparkSession, sf: str) -> DataFrame:
    """Vertical length scale on 200 profiles sharing one factorisation."""
    _, y = _sample(spark, sf, PROFILES)
    z = np.arange(y.shape[1], dtype=float)[:, None]
    found = lk.fit(spark, lk.LengthScale(z, y.T, 1.5, 1e-2), [(-2.3, 4.6)], STARTS)
    return lk.fit_frame(spark, ["ls_z"], found, len(y))


# Two energetic locations with fixed parameters: the likelihood in closed form.
_TWO_SENSORS = more("g", "p", "sens") + """nl AS (SELECT max(level) + 1 AS nl FROM g),
c AS (SELECT 2.0 * {matern} AS c, 2.0 + 0.25 AS a FROM sens s1, sens s2 WHERE s1.rank = 0 AND s2.rank = 1),
r AS (SELECT level, coalesce(max(resid) FILTER (rank = 0), 0) / 1e4 AS y1, coalesce(max(resid) FILTER (rank = 1), 0) / 1e4 AS y2
  FROM p JOIN (SELECT loc, rank FROM sens WHERE rank < 2) USING (loc) GROUP BY level)"""


@query("f08_likelihood", _TWO_SENSORS.format(matern=_m(1.5, "sqrt(((s1.y-s2.y)**2+(s1.x-s2.x)**2)::DOUBLE)", "3.0")) + """
SELECT round(0.5 * (sum((a*y1*y1 - 2*c*y1*y2 + a*y2*y2)/(a*a - c*c)) / max(nl) + ln(max(a)*max(a) - max(c)*max(c)) + 2*ln(2*pi())), 9) AS nll FROM r, c, nl""")
def f08_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    """Planar likelihood at fixed parameters (scale 3, variance 2, noise 1/4) on two locations."""
    xy, y = _two_readings(spark, sf)
    value, _ = lk.Isotropic(xy, y, 1.5)(np.log([3.0, 2.0, 0.25]))
    return spark.createDataFrame([(round(value, 9),)], "nll double")


@query("f12_likelihood", _TWO_SENSORS.format(matern=_m(1.5, "sqrt(((s1.y-s2.y)**2+(s1.x-s2.x)**2)::DOUBLE)", "3.0")).replace("2.0 *", "1.0 *") + """,
e AS (SELECT 1 + c AS l1, 1 - c AS l2 FROM c),
w AS (SELECT (y1 + y2)/sqrt(2) AS w1, (y1 - y2)/sqrt(2) AS w2 FROM r),
q AS (SELECT (w1 + 2*w1)/sqrt(5) AS a1, (2*w1 - w1)/sqrt(5) AS b1, (w2 + 2*w2)/sqrt(5) AS a2, (2*w2 - w2)/sqrt(5) AS b2 FROM w)
SELECT round(0.5 * (sum(a1*a1/(5*l1 + 0.01) + b1*b1/(0.01) + a2*a2/(5*l2 + 0.01) + b2*b2/(0.01)) / max(nl)
  + ln(max(5*l1 + 0.01)) + ln(max(5*l2 + 0.01)) + 2*ln(0.01) + 4*ln(2*pi())), 7) AS nll FROM q, e, nl""")
def f12_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    """Coregionalised likelihood of two equal fields on two locations, B = (1, 2)(1, 2)', in its eigenbases."""
    xy, y = _two_readings(spark, sf)
    both = np.repeat(y.T[:, :, None], 2, axis=2)
    value, _ = lk.Coregional(xy, both, np.array([[1.0, 2.0], [2.0, 4.0]]), 1.5, 0.01)(np.log([3.0]))
    return spark.createDataFrame([(round(value, 7),)], "nll double")


def _two_readings(spark: SparkSession, sf: str) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and residuals (in 10,000) of the two most energetic locations."""
    at = energetic_locations(spark, sf, 2).orderBy("rank").collect()
    rows = {r["loc"]: r["vec"] for r in field_profiles(spark, sf).where(F.col("loc").isin([r["loc"] for r in at])).collect()}
    return np.array([[r["y"], r["x"]] for r in at], float), np.array([rows[r["loc"]] for r in at]) / 1e4
