"""Reconstruction from sensors and the train / encode / decode codecs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import kernels as kn
from fieldloom.operators import codecs as cd
from fieldloom.operators import decompose as dc
from fieldloom.operators import predict as pr
from fieldloom.operators import reshape as rs
from fieldloom.operators import selection as sl
from fieldloom.operators import variogram as vg
from fieldloom.operators.metrics import quality
from fieldloom.plans.common import energetic_locations
from fieldloom.plans.fitting import field_profiles, location_points, stored_profiles
from fieldloom.plans.kernels import _m
from fieldloom.plans.registry import ctes, more, query
from fieldloom.session import cut_lineage
from fieldloom.sources.grid import FIELDS, NX, grid_field, grid_shape, residual_field

MATERN = sl.RadialKernel(kn.matern, nu=1.5, ls=3.0)
NOISE = 1e-3


def _two_sensors(spark: SparkSession, sf: str):
    s = energetic_locations(spark, sf, 2).orderBy("rank").collect()
    return np.array([r["loc"] for r in s]), np.array([[r["y"], r["x"]] for r in s], float)


def _krige_two(spark: SparkSession, sf: str, trend=None) -> DataFrame:
    prof = stored_profiles(spark, sf)
    ids, xy = _two_sensors(spark, sf)
    out = pr.kriging(prof, xy, pr.readings_at(prof, ids), MATERN, NOISE, trend, 1e-8)
    cells = F.posexplode(F.arrays_zip("vec", "pred")).alias("level", "c")
    return out.select("loc", "var", cells).select(
        F.col("level").cast("bigint").alias("level"), "loc", (F.round("c.pred", 5) + 0.0).alias("pred"), F.round("var", 8).alias("var")
    )


_TWO = more("g", "p", "sens") + f"""s AS (SELECT max(loc) FILTER (rank=0) AS l1, max(y) FILTER (rank=0) AS y1, max(x) FILTER (rank=0) AS x1,
 max(loc) FILTER (rank=1) AS l2, max(y) FILTER (rank=1) AS y2, max(x) FILTER (rank=1) AS x2 FROM sens),
lv AS (SELECT range AS level FROM range(0, (SELECT max(level)+1 FROM g))),
rd AS (SELECT lv.level, coalesce(max(p.resid) FILTER (p.loc = s.l1), 0) AS e1, coalesce(max(p.resid) FILTER (p.loc = s.l2), 0) AS e2
  FROM lv CROSS JOIN s LEFT JOIN p ON p.level = lv.level AND p.loc IN (s.l1, s.l2) GROUP BY lv.level),
kk AS (SELECT l.loc, {_m(1.5, 'sqrt(((l.y-y1)**2+(l.x-x1)**2)::DOUBLE)', '3.0')} AS k1, {_m(1.5, 'sqrt(((l.y-y2)**2+(l.x-x2)**2)::DOUBLE)', '3.0')} AS k2,
  {_m(1.5, 'sqrt(((y1-y2)**2+(x1-x2)**2)::DOUBLE)', '3.0')} AS c, 1.001::DOUBLE AS a FROM (SELECT DISTINCT loc, y, x FROM g) l, s)"""


@query("r01_simple_kriging", _TWO + """ SELECT level, loc, round(k1*(a*e1-c*e2)/(a*a-c*c) + k2*(a*e2-c*e1)/(a*a-c*c), 5) + 0.0 AS pred,
 round(greatest(1 - (a*k1*k1 - 2*c*k1*k2 + a*k2*k2)/(a*a-c*c), 1e-8), 8) AS var FROM kk, rd""")
def r01_simple_kriging(spark: SparkSession, sf: str) -> DataFrame:
    """Posterior mean and variance of every cell from two sensors per level."""
    return _krige_two(spark, sf)


@query("r02_universal_kriging", _TWO + """ SELECT level, loc, round(k1*(a*(e1-b)-c*(e2-b))/(a*a-c*c) + k2*(a*(e2-b)-c*(e1-b))/(a*a-c*c) + b, 5) + 0.0 AS pred,
 round(greatest(1 - (a*k1*k1 - 2*c*k1*k2 + a*k2*k2)/(a*a-c*c) + (1-(k1+k2)/(a+c))**2*(a+c)/2, 1e-8), 8) AS var FROM kk, (SELECT *, (e1+e2)/2 AS b FROM rd) rd""")
def r02_universal_kriging(spark: SparkSession, sf: str) -> DataFrame:
    """Constant trend by generalised least squares, variance with the trend correction."""
    return _krige_two(spark, sf, constant_trend)


def constant_trend(x: np.ndarray) -> np.ndarray:
    return np.ones((len(x), 1))


def linear_trend(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


@query("r03_trend_design", ctes("g") + "SELECT DISTINCT loc, 1.0::DOUBLE AS g0, y::DOUBLE AS g1, x::DOUBLE AS g2 FROM g")
def r03_trend_design(spark: SparkSession, sf: str) -> DataFrame:
    return grid_field(spark, sf).select(
        "loc", F.lit(1.0).alias("g0"), F.col("y").cast("double").alias("g1"), F.col("x").cast("double").alias("g2")
    ).distinct()


def _level_quality(cells: DataFrame) -> DataFrame:
    return quality(cells, "resid", "pred", ["level"]).select("level", "n", "rmse", "rel_l2", "max_err")


@query("r02_linear_trend")
def r02_linear_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Universal Kriging with a linear trend and 16 column-subset sensors."""
    prof = stored_profiles(spark, sf)
    picks = sl.gks(location_points(prof), MATERN, 16, 8, "greedy")
    out = pr.kriging(prof, picks.rows, pr.readings_at(prof, picks.ids), MATERN, NOISE, linear_trend, 1e-8)
    return _level_quality(pr.cells_of(out))


MAX_LAG, N_LAGS = 3.0, 6
SCALES = (2.0, 1.0, 1.0)  # levels, y, x
FIXED = vg.Spherical(6.0, 2.0, 0.5)

_PAIRS = more("g", "p") + f"""d AS (SELECT sqrt(((a.level-b.level)/2.0)**2 + (a.y-b.y)**2 + (a.x-b.x)**2) AS h, (a.resid - b.resid)**2 / 2 AS s
  FROM p a JOIN p b ON (a.level, a.loc) < (b.level, b.loc) AND abs(a.level - b.level) <= 6 AND abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3)"""


@query("r05_semivariogram", _PAIRS + f"""SELECT greatest(ceil(h / {MAX_LAG / N_LAGS}) - 1, 0)::BIGINT AS lag, count(*) AS n, round(avg(h), 6) AS distance, round(avg(s) / 1e6, 4) AS gamma
FROM d WHERE h <= {MAX_LAG} GROUP BY 1""")
def r05_semivariogram(spark: SparkSession, sf: str) -> DataFrame:
    """Semivariance of the residual field over all pairs of cells within three units; two levels are one."""
    lags = vg.semivariogram(residual_field(spark, sf), "resid", MAX_LAG, N_LAGS, SCALES)
    return lags.select("lag", "n", F.round("distance", 6).alias("distance"), F.round(F.col("gamma") / 1e6, 4).alias("gamma"))


def _gamma_sql(a: str, b: str) -> str:
    h = f"sqrt((({a}.level-{b}.level)/2.0)**2 + ({a}.y-{b}.y)**2 + ({a}.x-{b}.x)**2)"
    t = f"least({h}/{FIXED.reach}, 1.0)"
    return f"CASE WHEN {h} > 0 THEN {FIXED.nugget} + {FIXED.sill}*(1.5*{t} - 0.5*{t}**3) ELSE 0 END"


@query("r05_two_sensors", more("g", "p", "sens") + f"""s AS (SELECT rank, sens.loc, sens.y, sens.x, rank * 3 AS level, coalesce(p.resid, 0) AS v
  FROM sens LEFT JOIN p ON p.loc = sens.loc AND p.level = rank * 3 WHERE rank < 2),
w AS (SELECT c.level, c.loc, {_gamma_sql("c", "s1")} AS g1, {_gamma_sql("c", "s2")} AS g2, {_gamma_sql("s1", "s2")} AS g12, s1.v AS v1, s2.v AS v2
  FROM p c, s s1, s s2 WHERE s1.rank = 0 AND s2.rank = 1),
u AS (SELECT *, 0.5 + (g2 - g1)/(2*g12) AS w1 FROM w)
SELECT level, loc, round(w1*v1 + (1 - w1)*v2, 4) + 0.0 AS pred, round(greatest(w1*g1 + (1 - w1)*g2 + (g1 - (1 - w1)*g12), 0), 8) AS var FROM u""")
def r05_two_sensors(spark: SparkSession, sf: str) -> DataFrame:
    """Ordinary Kriging in three dimensions from two cells, with a fixed spherical variogram."""
    at = energetic_locations(spark, sf, 2).orderBy("rank").collect()
    field = residual_field(spark, sf)
    read = {(r["level"], r["loc"]): r["resid"] for r in field.where(F.col("loc").isin([r["loc"] for r in at])).select("level", "loc", "resid").collect()}
    sensors = np.array([[3.0 * r["rank"], r["y"], r["x"]] for r in at])
    readings = np.array([read.get((3 * r["rank"], r["loc"]), 0.0) for r in at])
    out = vg.ordinary_kriging(field, "resid", sensors, readings, FIXED, SCALES)
    return out.select("level", "loc", (F.round("pred", 4) + 0.0).alias("pred"), F.round("var", 8).alias("var"))


@query("r05_spherical_kriging")
def r05_spherical_kriging(spark: SparkSession, sf: str) -> DataFrame:
    """Ordinary Kriging in three dimensions with a spherical variogram fitted to all pairs of
    neighbouring cells, from sensors spread over the volume."""
    field = cut_lineage(residual_field(spark, sf))
    model, misfit = vg.fit_spherical(vg.semivariogram(field, "resid", MAX_LAG, N_LAGS, SCALES))
    points = field.select((F.col("loc") * sl.LEVEL_SPAN + F.col("level")).alias("id"), F.array(*[
        F.col(a).cast("double") / s for a, s in zip(vg.AXES, SCALES)]).alias("x"))
    picks = sl.maxmin(points, 24)
    at = [(int(i % sl.LEVEL_SPAN), int(i // sl.LEVEL_SPAN)) for i in picks.ids]
    known = {(r["level"], r["loc"]): r["resid"] for r in field.where(F.struct("level", "loc").isin(
        [F.struct(F.lit(a).cast("bigint").alias("level"), F.lit(b).cast("bigint").alias("loc")) for a, b in at])).collect()}
    out = vg.ordinary_kriging(field, "resid", picks.rows * np.array(SCALES), np.array([known[a] for a in at]), model, SCALES)
    return quality(out, "resid", "pred").select("n", "rmse").withColumns({
        "reach": F.lit(model.reach), "sill": F.lit(model.sill), "nugget": F.lit(model.nugget), "misfit": F.lit(misfit)})


@query("r06_deim_two_modes", _TWO + """, ph AS (SELECT loc, 1.0::DOUBLE AS f1, y/10.0::DOUBLE + x/7.0::DOUBLE AS f2 FROM (SELECT DISTINCT loc, y, x FROM g)),
ss AS (SELECT (SELECT f2 FROM ph, s WHERE loc = l1) AS b1, (SELECT f2 FROM ph, s WHERE loc = l2) AS b2),
co AS (SELECT level, (b2*e1 - b1*e2)/(b2-b1) AS c1, (e2-e1)/(b2-b1) AS c2, e1 FROM rd, ss)
SELECT level, loc, round(e1, 5) + 0.0 AS pred_k1, round(c1*f1 + c2*f2, 5) + 0.0 AS pred_k2 FROM ph, co""")
def r06_deim_two_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Interpolation with one and two prescribed modes at two sensors."""
    prof = stored_profiles(spark, sf)
    ids, xy = _two_sensors(spark, sf)
    y = pr.readings_at(prof, ids)
    mode2 = F.col("y") / 10.0 + F.col("x") / 7.0
    rows = np.column_stack([np.ones(2), xy[:, 0] / 10.0 + xy[:, 1] / 7.0])
    modes = prof.select(F.col("loc").alias("id"), F.array(F.lit(1.0), mode2).alias("x"))
    one = pr.deim_reconstruct(prof, modes.withColumn("x", F.slice("x", 1, 1)), rows[:1, :1], y[:1])
    two = pr.deim_reconstruct(prof, modes, rows, y)
    both = one.select("loc", F.col("pred").alias("a")).join(two.select("loc", F.col("pred").alias("b")), "loc")
    z = both.select("loc", F.posexplode(F.arrays_zip("a", "b")).alias("level", "c"))
    return z.select(
        F.col("level").cast("bigint").alias("level"), "loc",
        (F.round("c.a", 5) + 0.0).alias("pred_k1"), (F.round("c.b", 5) + 0.0).alias("pred_k2"),
    )


@query("r07_deim_operator")
def r07_deim_operator(spark: SparkSession, sf: str) -> DataFrame:
    """SVD basis, Q-DEIM sensors, all levels in one pass; residual at the sensors is 0."""
    shape = grid_shape(spark, sf)
    prof = stored_profiles(spark, sf)
    k = min(10, max(1, shape.n_locs // 3))
    basis = dc.svd_basis(prof, shape.n_levels, k)
    picks = sl.qdeim(dc.spatial_modes(prof, basis, k), k)
    out = cut_lineage(pr.cells_of(pr.deim_reconstruct_basis(prof, basis.v, basis.s, picks.rows, pr.readings_at(prof, picks.ids))))
    at = out.where(F.col("loc").isin(picks.ids.tolist())).groupBy("level").agg(
        F.max(F.abs(F.col("resid") - F.col("pred"))).alias("max_sensor_err")
    )
    return _level_quality(out).join(at, "level")


@query("r08_volume_basis")
def r08_volume_basis(spark: SparkSession, sf: str) -> DataFrame:
    """Volume modes with square and oversampled sensors anywhere in the volume."""
    shape = grid_shape(spark, sf)
    prof = stored_profiles(spark, sf)
    k = min(6, max(1, shape.n_locs // 3))
    out = None
    for extra in (0, 6):
        modes, picks, coef = cd.fit_volume(prof, shape.n_levels, k, extra)
        row = quality(cd.decode_volume(modes, coef), "resid", "pred").select(
            F.lit(len(picks.ids)).cast("bigint").alias("n_sensors"), "n", "rmse", "rel_l2"
        )
        out = row if out is None else out.unionAll(row)
    return out


@query("r09_batched_kriging")
def r09_batched_kriging(spark: SparkSession, sf: str) -> DataFrame:
    """All levels from shared weights, 24 sensors; variance at the sensors is near the noise."""
    prof = stored_profiles(spark, sf)
    picks = sl.gks(location_points(prof), MATERN, min(24, grid_shape(spark, sf).n_locs // 2), 8, "random", 42)
    out = cut_lineage(pr.kriging(prof, picks.rows, pr.readings_at(prof, picks.ids), MATERN, NOISE))
    lo, hi = (out.select(f("var")).scalar() for f in (F.min, F.max))
    return _level_quality(pr.cells_of(out)).withColumns({"var_min": lo, "var_max": hi})


@query("r11_nearest_sensors", more("g", "p", "sens").replace("rank < 5", "rank < 10") + """d AS (SELECT l.loc, s.loc AS sensor, sqrt(((l.y-s.y)**2+(l.x-s.x)**2)::DOUBLE) AS d FROM (SELECT DISTINCT loc, y, x FROM g) l, sens s)
SELECT loc, sensor, row_number() OVER (PARTITION BY loc ORDER BY d, sensor) AS rank FROM d QUALIFY rank <= 5""")
def r11_nearest_sensors(spark: SparkSession, sf: str) -> DataFrame:
    """Five nearest of ten sensors for every location, without a join or shuffle."""
    s = energetic_locations(spark, sf, 10).select("loc", "y", "x").collect()
    table = F.array(*[F.struct(*[F.lit(int(r[c])).alias(c) for c in ("loc", "y", "x")]) for r in s])
    locs = grid_field(spark, sf).select("loc", "y", "x").distinct()
    ranked = F.array_sort(F.transform(table, lambda t: F.struct(
        kn.planar_distance((F.col("y") - t["y"]).cast("double"), (F.col("x") - t["x"]).cast("double")).alias("d"),
        t["loc"].cast("bigint").alias("sensor"),
    )))
    near = locs.select("loc", F.posexplode(F.slice(ranked, 1, 5)).alias("i", "s"))
    return near.select("loc", F.col("s.sensor").alias("sensor"), (F.col("i") + 1).cast("bigint").alias("rank"))


@query("r11_local_kriging")
def r11_local_kriging(spark: SparkSession, sf: str) -> DataFrame:
    """3-D local prediction: every cell from its 8 nearest of the 200 largest residuals."""
    f = cut_lineage(residual_field(spark, sf).select("level", "loc", "y", "x", "resid"))
    s = f.orderBy(F.desc(F.round(F.abs("resid"), 6)), "level", "loc").limit(200).toPandas()
    out = pr.local_kriging(
        f, ["level", "y", "x"], "resid", s[["level", "y", "x"]].to_numpy(float), s["resid"].to_numpy(),
        sl.RadialKernel(kn.matern, nu=2.5, ls=2.0), NOISE, 8,
    )
    return quality(out, "resid", "pred", ["level"]).select("level", "n", "rmse").join(
        out.groupBy("level").agg(F.max("var").alias("var_max")), "level"
    )


def _kronecker(spark: SparkSession, sf: str, k_z: int, k_xy: int):
    nl = grid_shape(spark, sf).n_levels
    prof = stored_profiles(spark, sf)
    levels = np.array(rs.even_indices(nl, k_z))
    picks = sl.random_select(location_points(prof), sl.CholeskyScore(MATERN), k_xy, 42)
    readings = pr.readings_at(prof, picks.ids)[:, levels].T
    vertical = sl.RadialKernel(kn.matern, nu=1.5, ls=6.0)
    return pr.kronecker_kriging(prof, nl, levels, picks.rows, readings, vertical, MATERN, 1.0, NOISE), levels, picks


@query("r12_kronecker_kriging")
def r12_kronecker_kriging(spark: SparkSession, sf: str) -> DataFrame:
    """Separable process from sensors on 12 levels x 16 locations."""
    out, _, _ = _kronecker(spark, sf, 12, min(16, grid_shape(spark, sf).n_locs // 2))
    return _level_quality(pr.cells_of(out))


@query("r12_space_time", more("g", "p", "sens") + f"""o AS (SELECT loc, y, x FROM sens WHERE rank = 0),
a AS (SELECT coalesce(max(p.resid), 0) / (1.0 + {NOISE}) AS a FROM o LEFT JOIN p ON p.loc = o.loc AND p.level = 10),
lv AS (SELECT unnest(range(0, max(level) + 1))::BIGINT AS level FROM g)
SELECT lv.level, l.loc, round({_m(1.5, 'abs(lv.level - 10)::DOUBLE', '6.0')} * {_m(1.5, 'sqrt(((l.y-o.y)**2+(l.x-o.x)**2)::DOUBLE)', '3.0')} * a, 4) + 0.0 AS pred
FROM lv, (SELECT DISTINCT loc, y, x FROM g) l, o, a""")
def r12_space_time(spark: SparkSession, sf: str) -> DataFrame:
    """The product of a temporal and a spatial process, levels being times, from one reading at time 10."""
    nl = grid_shape(spark, sf).n_levels
    prof = stored_profiles(spark, sf)
    at = energetic_locations(spark, sf, 1).first()
    readings = pr.readings_at(prof, np.array([at["loc"]]))[:, [10]].T
    temporal = sl.RadialKernel(kn.matern, nu=1.5, ls=6.0)
    out = pr.kronecker_kriging(prof, nl, np.array([10]), np.array([[at["y"], at["x"]]], float), readings, temporal, MATERN, 1.0, NOISE)
    return pr.cells_of(out).select("level", "loc", (F.round("pred", 4) + 0.0).alias("pred"))


def field_stack(spark: SparkSession, sf: str) -> DataFrame:
    nl = grid_shape(spark, sf).n_levels
    g = grid_field(spark, sf)
    from fieldloom.sources.profiles import profiles

    return cut_lineage(cd.standardised_stack({f: profiles(g, nl, f) for f in FIELDS}))


def coregional(spark: SparkSession, sf: str, k: int, fields: list[str]):
    """Stack, sensors, predictions of a coregionalised model."""
    z = rs.zscore_by_location(grid_field(spark, sf), fields)
    b = np.zeros((len(fields), len(fields)))
    for r in dc.cross_field(z, fields).collect():
        b[r["i"], r["j"]] = r["b_ij"]
    stack = field_stack(spark, sf)
    picks = sl.gks(location_points(stack), MATERN, k, min(k, 20), "random", 42)
    readings = cd.stacked_readings(stack, fields, picks.ids)
    return stack, picks, pr.coregional_kriging(stack, fields, picks.rows, readings, b, MATERN, 1e-2)


@query("r14_coregional_kriging")
def r14_coregional_kriging(spark: SparkSession, sf: str) -> DataFrame:
    """Three fields predicted jointly; error of each in its standardised unit."""
    stack, _, out = coregional(spark, sf, min(12, grid_shape(spark, sf).n_locs // 2), list(FIELDS))
    joined = cut_lineage(stack.join(out, "loc"))
    rows = None
    for f in FIELDS:
        c = joined.select("loc", F.posexplode(F.arrays_zip(f"vec_{f}", f"pred_{f}")).alias("level", "c"))
        q = quality(c.select(F.col(f"c.vec_{f}").alias("t"), F.col(f"c.pred_{f}").alias("p")), "t", "p")
        q = q.select(F.lit(f).alias("field"), "n", "rmse", "mae", "max_err", "range")
        rows = q if rows is None else rows.unionAll(q)
    return rows


@query("r16_zero_variance", more("g") + """c AS (SELECT *, least(f_quantity, 20) AS v FROM g), s AS (SELECT loc, avg(v) AS mu, stddev_pop(v) AS sd FROM c GROUP BY loc)
SELECT level, loc, round(CASE WHEN sd < 1.0 THEN mu ELSE mu + 0.5*(v-mu) END, 6) AS pred FROM c JOIN s USING (loc)""")
def r16_zero_variance(spark: SparkSession, sf: str) -> DataFrame:
    """Locations that hardly vary (deviation under 1) keep their mean."""
    from pyspark.sql import Window

    here = Window.partitionBy("loc")
    g = grid_field(spark, sf).withColumn("v", F.least("f_quantity", F.lit(20.0)))
    mu, sd = F.avg("v").over(here), F.stddev_pop("v").over(here)
    c = g.select("level", "loc", "v", mu.alias("mu"), sd.alias("sd"))
    pred = F.when(F.col("sd") < 1.0, F.col("mu")).otherwise(F.col("mu") + (F.col("v") - F.col("mu")) * 0.5)
    return c.select("level", "loc", F.round(pred, 6).alias("pred"))


class DomainMean:
    """Prediction of a location by the process of its own domain."""

    def __init__(self, models: dict):
        self.models = models

    def __call__(self, domain: np.ndarray, x: np.ndarray, n_levels: int) -> np.ndarray:
        out = np.zeros((len(x), n_levels))
        for d, (s, alpha, kernel) in self.models.items():
            hit = domain == d
            if hit.any():
                out[hit] = kernel(x[hit], s) @ alpha
        return out


@query("r17_domain_split")
def r17_domain_split(spark: SparkSession, sf: str) -> DataFrame:
    """Four rectangles with their own sensors and scale: per-domain placement, and shared
    sensors within a buffer of 2."""
    from fieldloom.operators import likelihood as lk
    from fieldloom.plans.fitting import BOX_LS, BOX_VAR_SLICES, COREGIONAL
    from fieldloom.sources.profiles import list_column, map_blocks, scalar

    shape = grid_shape(spark, sf)
    total = min(24, shape.n_locs // 2)
    dom = rs.domain_of(F.col("y"), shape.ny, 2) * 2 + rs.domain_of(F.col("x"), NX, 2)
    prof = cut_lineage(field_profiles(spark, sf).withColumn("domain_id", dom))
    sizes = {r["domain_id"]: r["n"] for r in prof.groupBy("domain_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    points = prof.select("domain_id", F.col("loc").alias("id"), F.array(F.col("y").cast("double"), F.col("x").cast("double")).alias("x"))
    kernels = {}
    for d in sizes:
        s = rs.sample_without_replacement(prof.where(F.col("domain_id") == d), "loc", COREGIONAL, 42).toPandas()
        xy, y = s[["y", "x"]].to_numpy(float), np.stack(s["vec"].to_numpy()) / s["sd"].to_numpy()[:, None]
        theta = lk.fit(spark, lk.Isotropic(xy, y, 1.5, NOISE), [BOX_LS, BOX_VAR_SLICES], 2).theta
        kernels[d] = sl.RadialKernel(kn.matern, nu=1.5, ls=float(np.exp(theta[0])), var=float(np.exp(theta[1])))
    shared = sl.gks(points.drop("domain_id"), MATERN, total, 8, "greedy")
    boxes = {b[0]: b[1:] for b in rs.domain_boxes(shape.ny, NX, 2, 2)}
    own = sl.greedy_select_by(
        points, "domain_id", {d: sl.CholeskyScore(kernels[d]) for d in sizes}, max(3, total // max(len(sizes), 1))
    )
    rows = None
    for mode in ("own", "buffer"):
        models = {}
        for d in sizes:
            if mode == "own":
                ids, xy = own[d].ids, own[d].rows
            else:
                y0, y1, x0, x1 = boxes[d]
                gap = np.maximum(np.maximum([y0, x0] - shared.rows, shared.rows - [y1, x1]), 0)
                dist = np.sqrt((gap**2).sum(1))
                inside = np.flatnonzero(dist < 2.0)
                if len(inside) < 2:
                    inside = np.argsort(dist, kind="stable")[:2]
                ids, xy = shared.ids[inside], shared.rows[inside]
            y = pr.readings_at(prof, ids)
            alpha = pr.solve_spd(kernels[d](xy, xy) + NOISE * np.eye(len(xy)), y)
            models[d] = (xy, alpha, kernels[d])
        predict, nl = DomainMean(models), shape.n_levels

        def run(b, predict=predict):
            x = np.column_stack([scalar(b, "y"), scalar(b, "x")]).astype(float)
            return [b.column("loc"), b.column("vec"), list_column(predict(scalar(b, "domain_id"), x, nl))]

        out = map_blocks(prof, ["loc", "y", "x", "vec", "domain_id"], "loc bigint, vec array<double>, pred array<double>", run)
        q = quality(pr.cells_of(out), "resid", "pred").select(F.lit(mode).alias("placement"), "n", "rmse", "rel_l2")
        rows = q if rows is None else rows.unionAll(q)
    return rows


@query("r18_encode_gather", ctes("g", "p", "sens") + """SELECT l.level, sens.rank, sens.loc, coalesce(p.resid, 0)::FLOAT::DOUBLE AS reading
FROM (SELECT DISTINCT level FROM g) l CROSS JOIN sens LEFT JOIN p ON p.level = l.level AND p.loc = sens.loc""")
def r18_encode_gather(spark: SparkSession, sf: str) -> DataFrame:
    """The encoder's gather: centred float32 readings in sensor order."""
    from fieldloom.sources.rawf32 import unpack_f32

    shape = grid_shape(spark, sf)
    sensors = energetic_locations(spark, sf).orderBy("rank").collect()
    ids = np.array([r["loc"] for r in sensors])
    prof = field_profiles(spark, sf)
    model = cd.Model("deim", prof, ids, np.zeros((len(ids), 2)), np.eye(len(ids)), *shape)
    back = cd.encode(model, prof).select("level", F.posexplode(unpack_f32(F.col("blob"), 2)["payload"]).alias("rank", "v"))
    loc = F.array(*[F.lit(int(i)).cast("bigint") for i in ids])
    return back.select("level", F.col("rank").cast("bigint").alias("rank"), loc[F.col("rank")].alias("loc"), F.col("v").cast("double").alias("reading"))


def _codec_report(model: cd.Model, prof: DataFrame) -> DataFrame:
    """Encode, decode and score; the ratio is raw float32 over header and readings."""
    encoded = cut_lineage(cd.encode(model, prof))
    cells = pr.cells_of(cd.decode(model, encoded))
    size = encoded.agg(F.sum(F.length("blob")).alias("b"))
    return _level_quality(cells).withColumn("k", F.lit(model.k)).withColumn(
        "ratio", F.lit(4.0 * model.n_locs * model.n_levels) / size.select("b").scalar()
    )


@query("r18_deim_codec")
def r18_deim_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Basis codec trained on a seeded subset of the levels, scored on all of them."""
    nl, n = grid_shape(spark, sf)
    prof = stored_profiles(spark, sf)
    cap = max(2, cd.sensor_cap(n))
    pilot = dc.choose_rank(dc.svd_basis(prof, nl).s, 0.1, cap)
    count = cd.training_levels(pilot, nl)
    train = np.sort(np.random.default_rng(0).choice(nl, min(count, nl), replace=False))
    return _codec_report(cd.fit_deim(prof, nl, n, pilot, train), prof).withColumn(
        "is_train", F.col("level").isin(train.tolist())
    )


@query("r18_kriging_codec")
def r18_kriging_codec(spark: SparkSession, sf: str) -> DataFrame:
    nl, n = grid_shape(spark, sf)
    prof = stored_profiles(spark, sf)
    return _codec_report(cd.fit_kriging(prof, nl, n, max(2, cd.sensor_cap(n))), prof)


@query("r18_volume_codec")
def r18_volume_codec(spark: SparkSession, sf: str) -> DataFrame:
    """A-priori guarantee loop for the volume basis, then decoding of the volume."""
    nl, n = grid_shape(spark, sf)
    prof = stored_profiles(spark, sf)
    k, amp, bound = cd.train_until_bound(prof, nl, 2, 0.9, min(20, n - 1))
    modes, picks, coef = cd.fit_volume(prof, nl, k)
    return quality(cd.decode_volume(modes, coef), "resid", "pred").select(
        F.lit(k).cast("bigint").alias("k"), F.lit(amp).alias("amplification"), F.lit(bound).alias("bound"),
        "n", "rmse", "rel_l2", (F.lit(4.0 * nl * n) / (16 + 4 * len(picks.ids))).alias("ratio"),
    )
