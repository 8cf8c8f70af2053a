"""Projections, filters, reshapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import reshape as rs
from fieldloom.plans.common import r6
from fieldloom.plans.ratedist import RESULTS_SQL, results
from fieldloom.plans.registry import ctes, more, query
from fieldloom.sources.grid import FIELDS, NX, grid_field, grid_shape, residual_field
from fieldloom.plans.sources import _MASK


@query("p01_stride", ctes("g") + "SELECT level, y, x // 3 AS x, value FROM g WHERE x % 3 = 0")
def p01_stride(spark: SparkSession, sf: str) -> DataFrame:
    """x axis down-sampled by three: the stride is the operator."""
    return rs.stride(grid_field(spark, sf), 3).select("level", "y", "x", "value")


@query("p02_level_slices", ctes("g") + """SELECT level, count(*) AS n, round(sum(value), 4) AS total,
  level >= 10 AS kept FROM g GROUP BY level""")
def p02_level_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Slices and whether the bottom skip keeps them."""
    return grid_field(spark, sf).groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    ).withColumn("kept", F.col("level") >= 10)


@query("p03_flat_index", ctes("g", "sh") + """SELECT flat, flat // (sh.ny*10) AS level, (flat % (sh.ny*10)) // 10 AS y, flat % 10 AS x
FROM (SELECT level*(SELECT ny FROM sh)*10 + y*10 + x AS flat FROM g), sh""")
def p03_flat_index(spark: SparkSession, sf: str) -> DataFrame:
    shape = grid_shape(spark, sf)
    n = shape.ny * NX
    flat = grid_field(spark, sf).select(rs.flat_index(shape).alias("flat"))
    return flat.select(
        "flat", F.expr(f"flat div {n}").alias("level"),
        F.expr(f"(flat % {n}) div {NX}").alias("y"), (F.col("flat") % NX).alias("x"),
    )


@query("p04_grid_coordinates", ctes("g") + "SELECT loc, loc // 10 AS y, loc % 10 AS x, count(*) AS n_levels FROM g GROUP BY loc")
def p04_grid_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    return grid_field(spark, sf).groupBy("loc", "y", "x").agg(F.count(F.lit(1)).alias("n_levels"))


@query("p05_unit_cube", ctes("g", "sh") + """SELECT level, loc, round(level/(sh.nl-1), 9) AS zn,
  round(y/greatest(sh.ny-1, 1), 9) AS yn, round(x/9.0::DOUBLE, 9) AS xn,
  round((value - (SELECT min(value) FROM g))/((SELECT max(value) FROM g)-(SELECT min(value) FROM g)), 9) AS vn FROM g, sh""")
def p05_unit_cube(spark: SparkSession, sf: str) -> DataFrame:
    shape = grid_shape(spark, sf)
    g = grid_field(spark, sf)
    return g.select(
        "level", "loc",
        F.round(rs.unit_coordinate("level", shape.n_levels), 9).alias("zn"),
        F.round(rs.unit_coordinate("y", shape.ny), 9).alias("yn"),
        F.round(rs.unit_coordinate("x", NX), 9).alias("xn"),
        F.round(rs.min_max(g, "value"), 9).alias("vn"),
    )


@query("p06_mask_scatter", more("g", "sh") + _MASK + """,
grid AS (SELECT l.level, m.loc FROM (SELECT range AS level FROM range(0, (SELECT nl FROM sh))) l, mask m)
SELECT level, loc, v.value AS value FROM grid
LEFT JOIN (SELECT g.* FROM g JOIN mask USING (loc) WHERE is_active) v USING (level, loc)""")
def p06_mask_scatter(spark: SparkSession, sf: str) -> DataFrame:
    """Active cells gathered, then scattered on the full grid with NULL elsewhere."""
    shape = grid_shape(spark, sf)
    g = grid_field(spark, sf)
    active = rs.gather_active(g, rs.active_mask(g, shape.n_levels))
    return rs.scatter(g, active, shape, None).select("level", "loc", "value")


@query("p07_zero_fill", more("g", "sh") + _MASK + """
SELECT level, loc, CASE WHEN is_active THEN value ELSE 0 END AS value FROM g JOIN mask USING (loc)""")
def p07_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    g = grid_field(spark, sf)
    mask = rs.active_mask(g, grid_shape(spark, sf).n_levels)
    return g.join(mask, "loc").select(
        "level", "loc", F.when(F.col("is_active"), F.col("value")).otherwise(0.0).alias("value")
    )


@query("p08_centre", ctes("g", "p") + "SELECT level, loc, round(mu, 6) AS mu, round(resid, 6) AS resid FROM p")
def p08_centre(spark: SparkSession, sf: str) -> DataFrame:
    return residual_field(spark, sf).select("level", "loc", *r6("mu", "resid"))


def _z(f: str) -> str:
    w = "OVER (PARTITION BY loc)"
    return f"({f} - avg({f}) {w}) / CASE WHEN stddev_pop({f}) {w} < 1e-10 THEN 1 ELSE stddev_pop({f}) {w} END"


Z_SQL = "z AS (SELECT level, loc, " + ", ".join(f"{_z(f)} AS z_{f}" for f in FIELDS) + " FROM g)"


@query("p09_zscore_location", more("g") + Z_SQL + """
SELECT level, loc, round(z_value, 6) AS z_value, round(z_f_quantity, 6) AS z_f_quantity,
  round(z_f_discount, 6) AS z_f_discount FROM z""")
def p09_zscore_location(spark: SparkSession, sf: str) -> DataFrame:
    z = rs.zscore_by_location(grid_field(spark, sf), FIELDS)
    return z.select("level", "loc", *r6(*[f"z_{f}" for f in FIELDS]))


@query("p10_zscore_global", ctes("g") + """SELECT level, loc,
  round((value - (SELECT avg(value) FROM g)) / (SELECT CASE WHEN stddev_pop(value) < 1e-8 THEN 1 ELSE stddev_pop(value) END FROM g), 6) AS z FROM g""")
def p10_zscore_global(spark: SparkSession, sf: str) -> DataFrame:
    return rs.zscore_global(grid_field(spark, sf)).select("level", "loc", F.round("z", 6).alias("z"))


@query("p11_even_index", more("g", "sh") + """i AS (SELECT DISTINCT round_even(range*(sh.nl-1)/19.0::DOUBLE, 0)::BIGINT AS level FROM range(0, 20), sh)
SELECT level, count(*) AS n, round(avg(value), 6) AS mean FROM g JOIN i USING (level) GROUP BY level""")
def p11_even_index(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty evenly spread training levels and what they hold."""
    levels = rs.even_indices(grid_shape(spark, sf).n_levels, 20)
    return grid_field(spark, sf).where(F.col("level").isin(levels)).groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")
    )


@query("p12_random_split", more("g") + """l AS (SELECT level, row_number() OVER (ORDER BY md5('42-' || level), level) AS rn, count(*) OVER () AS n
  FROM (SELECT DISTINCT level FROM g))
SELECT g.level, any_value(rn <= (7*n)//10) AS is_train, count(*) AS n FROM g JOIN l USING (level) GROUP BY g.level""")
def p12_random_split(spark: SparkSession, sf: str) -> DataFrame:
    """Seeded 70 % of the levels, without replacement."""
    g = grid_field(spark, sf).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    n_train = 7 * grid_shape(spark, sf).n_levels // 10
    train = rs.sample_without_replacement(g, "level", n_train, 42).select("level", F.lit(True).alias("_t"))
    return g.join(train, "level", "left").select("level", F.coalesce("_t", F.lit(False)).alias("is_train"), "n")


@query("p13_uniform_stride_sample", more("g", "sh") + """c AS (SELECT *, level*sh.ny*10 + y*10 + x AS flat FROM g, sh)
SELECT flat, value FROM c WHERE flat % 10 = 0""")
def p13_uniform_stride_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth point of the volume (the fitting sub-sample operator)."""
    flat = rs.flat_index(grid_shape(spark, sf))
    return grid_field(spark, sf).select(flat.alias("flat"), "value").where(F.col("flat") % 10 == 0)


@query("p14_random_subsample", more("g", "sh") + """c AS (SELECT *, level*sh.ny*10 + y*10 + x AS flat FROM g, sh)
SELECT flat, value FROM c ORDER BY md5('7-' || flat), flat LIMIT 500""")
def p14_random_subsample(spark: SparkSession, sf: str) -> DataFrame:
    flat = rs.flat_index(grid_shape(spark, sf))
    cells = grid_field(spark, sf).select(flat.alias("flat"), "value")
    return rs.sample_without_replacement(cells, "flat", 500, 7)


def _u(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _lhs_axis(a: str, extent: str) -> str:
    stratum = f"row_number() OVER (ORDER BY md5('3-{a}-' || range)) - 1"
    offset = _u(f"'4-{a}-' || range")
    return f"floor(({stratum} + {offset}) / 200 * {extent})::BIGINT AS {a}"


@query("p15_latin_hypercube", more("g", "sh") + "d AS (SELECT DISTINCT level, y, x FROM (SELECT "
       + _lhs_axis("level", "sh.nl") + ", " + _lhs_axis("y", "sh.ny") + ", " + _lhs_axis("x", "10")
       + " FROM range(0, 200), sh)) SELECT level, y, x, value FROM g JOIN d USING (level, y, x)")
def p15_latin_hypercube(spark: SparkSession, sf: str) -> DataFrame:
    shape = grid_shape(spark, sf)
    axes = {"level": shape.n_levels, "y": shape.ny, "x": NX}
    return rs.latin_hypercube(grid_field(spark, sf), axes, 200, 3).select("level", "y", "x", "value")


@query("p16_pair_sampling", more("g", "sh") + "d AS (SELECT r.range AS draw, t.range AS try, floor(" + _u("'11-level-' || r.range || '-' || t.range")
       + "*sh.nl)::BIGINT AS level, floor(" + _u("'11-loc-' || r.range || '-' || t.range") + """*sh.n)::BIGINT AS loc
  FROM range(0, 300) r, range(0, 32) t, sh)
SELECT draw, loc, level, value FROM g JOIN d USING (level, loc) QUALIFY row_number() OVER (PARTITION BY draw ORDER BY try) = 1""")
def p16_pair_sampling(spark: SparkSession, sf: str) -> DataFrame:
    """(snapshot, location) pairs drawn with replacement from the existing cells."""
    shape = grid_shape(spark, sf)
    g = grid_field(spark, sf).select("loc", "level", "value")
    return rs.sample_pairs(g, {"level": shape.n_levels, "loc": shape.n_locs}, 300, 11).select("draw", "loc", "level", "value")


@query("p17_float32", ctes("g", "p") + "SELECT level, loc, f_quantity::FLOAT::DOUBLE AS q32, round(value::FLOAT::DOUBLE - value, 6) AS err FROM p")
def p17_float32(spark: SparkSession, sf: str) -> DataFrame:
    f32 = lambda c: F.col(c).cast("float").cast("double")
    return grid_field(spark, sf).select(
        "level", "loc", f32("f_quantity").alias("q32"), F.round(f32("value") - F.col("value"), 6).alias("err")
    )


@query("p18_rect_domains", ctes("g", "sh") + """SELECT loc, (CASE WHEN y >= sh.ny//2 THEN 2 ELSE 0 END + CASE WHEN x >= 5 THEN 1 ELSE 0 END)::BIGINT AS domain_id,
  count(*) AS n, round(avg(value), 6) AS mean FROM g, sh GROUP BY 1, 2""")
def p18_rect_domains(spark: SparkSession, sf: str) -> DataFrame:
    ny = grid_shape(spark, sf).ny
    dom = rs.domain_of(F.col("y"), ny, 2) * 2 + rs.domain_of(F.col("x"), NX, 2)
    return grid_field(spark, sf).groupBy("loc", dom.alias("domain_id")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")
    )


@query("p19_domain_buffer", more("g", "sh") + """l AS (SELECT DISTINCT loc, y, x,
  (CASE WHEN y >= sh.ny//2 THEN 2 ELSE 0 END + CASE WHEN x >= 5 THEN 1 ELSE 0 END)::BIGINT AS d FROM g, sh)
SELECT DISTINCT a.loc, b.d AS domain_id FROM l a JOIN l b
  ON abs(a.y-b.y) <= 2 AND abs(a.x-b.x) <= 2 AND sqrt(((a.y-b.y)**2 + (a.x-b.x)**2)::DOUBLE) < 2.0""")
def p19_domain_buffer(spark: SparkSession, sf: str) -> DataFrame:
    ny = grid_shape(spark, sf).ny
    locs = grid_field(spark, sf).select("loc", "y", "x").distinct()
    return rs.expand_domains(locs, rs.domain_boxes(ny, NX, 2, 2), 2.0).select("loc", "domain_id")


@query("p20_stack_fields", ctes("g") + """SELECT level, loc, round(value, 6) AS value, round(f_quantity, 6) AS f_quantity, round(f_discount, 6) AS f_discount FROM g""")
def p20_stack_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Long multi-field rows stacked back into one column per field."""
    long = rs.long_form(grid_field(spark, sf), FIELDS)
    wide = long.groupBy("level", "loc").pivot("var", list(FIELDS)).agg(F.max("value"))
    return wide.select("level", "loc", *r6(*FIELDS))


@query("p21_tile_mean", ctes("g", "sh") + """SELECT level, loc, round(mu, 6) AS mean FROM
(SELECT loc, avg(value) AS mu FROM g GROUP BY loc), (SELECT range AS level FROM range(0, (SELECT nl FROM sh)))""")
def p21_tile_mean(spark: SparkSession, sf: str) -> DataFrame:
    """The location mean repeated over every level."""
    shape = grid_shape(spark, sf)
    mean = grid_field(spark, sf).groupBy("loc").agg(F.round(F.avg("value"), 6).alias("mean"))
    levels = F.sequence(F.lit(0).cast("bigint"), F.lit(shape.n_levels - 1).cast("bigint"))
    return mean.select(F.explode(levels).alias("level"), "loc", "mean")


@query("p22_finite_rows", RESULTS_SQL + """,
t AS (SELECT method, k, abs_bound, CASE WHEN n_unique % 3 = 0 THEN NULL WHEN n_unique % 3 = 1 THEN cr END AS a, CASE WHEN n_unique % 5 = 0 THEN NULL ELSE psnr END AS b FROM r)
SELECT method, k, abs_bound, round(a, 6) AS cr, round(b, 6) AS psnr FROM t WHERE a IS NOT NULL AND b IS NOT NULL""")
def p22_finite_rows(spark: SparkSession, sf: str) -> DataFrame:
    """NULL, NaN and infinite entries planted by rule, then filtered."""
    m3 = F.col("n_unique") % 3
    t = results(spark, sf).select(
        "method", "k", "abs_bound",
        F.when(m3 == 1, F.col("cr")).when(m3 == 2, float("nan")).alias("cr"),
        F.when(F.col("n_unique") % 5 == 0, float("inf")).otherwise(F.col("psnr")).alias("psnr"),
    )
    ok = t.where(rs.is_finite(F.col("cr")) & rs.is_finite(F.col("psnr")))
    return ok.select("method", "k", "abs_bound", *r6("cr", "psnr"))


@query("p23_guarded_ratio", ctes("g", "p") + """SELECT level, loc, round(CASE WHEN n_obs > 1 THEN resid/(n_obs-1) END, 6) AS ratio FROM p""")
def p23_guarded_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return residual_field(spark, sf).select(
        "level", "loc", F.round(rs.guarded_ratio(F.col("resid"), F.col("n_obs") - 1), 6).alias("ratio")
    )
