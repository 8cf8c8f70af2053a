"""Scans, layouts and derived inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import reshape as rs
from fieldloom.plans.registry import ctes, more, query
from fieldloom.session import sized_broadcast
from fieldloom.sources.grid import FIELDS, event_series, grid_field, grid_shape, residual_field
from fieldloom.sources.profiles import profiles
from fieldloom.sources.rawf32 import pack_f32, unpack_f32
from fieldloom.sources.results import coerce

R6 = 6


@query("s01_raw_volume", ctes("g") + "SELECT level, loc, value::FLOAT::DOUBLE AS value FROM g")
def s01_raw_volume(spark: SparkSession, sf: str) -> DataFrame:
    """Cells packed as raw float32 runs of up to 1000 locations, then scanned back."""
    lines = grid_field(spark, sf).groupBy("level", F.expr("loc div 1000").alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("loc", "value"))).alias("cells")
    )
    packed = lines.select("level", "cells.loc", pack_f32(F.col("cells.value")).alias("blob"))
    back = packed.select("level", "loc", unpack_f32(F.col("blob"), 0)["payload"].alias("v"))
    return back.select("level", F.explode(F.arrays_zip("loc", "v")).alias("c")).select(
        "level", F.col("c.loc").alias("loc"), F.col("c.v").cast("double").alias("value")
    )


@query(
    "s02_strided_levels",
    ctes("g") + """SELECT ds::BIGINT AS ds, level, y // ds AS y, x // ds AS x, value
FROM g, (VALUES (1), (2), (5)) d(ds) WHERE y % ds = 0 AND x % ds = 0""",
)
def s02_strided_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Every level at strides 1, 2 and 5."""
    g = grid_field(spark, sf).select("level", "y", "x", "value")
    ds = F.col("ds")
    return (
        g.withColumn("ds", F.explode(F.array(*[F.lit(d).cast("bigint") for d in (1, 2, 5)])))
        .where((F.col("y") % ds == 0) & (F.col("x") % ds == 0))
        .select("ds", "level", F.expr("y div ds").alias("y"), F.expr("x div ds").alias("x"), "value")
    )


@query(
    "s03_multi_field",
    ctes("g") + """SELECT level, loc, 'value' AS var, round(value, 6) AS value FROM g
UNION ALL SELECT level, loc, 'f_quantity', round(f_quantity, 6) FROM g
UNION ALL SELECT level, loc, 'f_discount', round(f_discount, 6) FROM g""",
)
def s03_multi_field(spark: SparkSession, sf: str) -> DataFrame:
    long = rs.long_form(grid_field(spark, sf), FIELDS)
    return long.select("level", "loc", "var", F.round("value", R6).alias("value"))


@query(
    "s04_unit_square",
    ctes("g", "sh") + """SELECT level, y, x, round(y/greatest(sh.ny-1, 1), 9) AS yn,
  round(x/9.0::DOUBLE, 9) AS xn, value FROM g, sh""",
)
def s04_unit_square(spark: SparkSession, sf: str) -> DataFrame:
    shape = grid_shape(spark, sf)
    return grid_field(spark, sf).select(
        "level", "y", "x",
        F.round(rs.unit_coordinate("y", shape.ny), 9).alias("yn"),
        F.round(rs.unit_coordinate("x", 10), 9).alias("xn"),
        "value",
    )


@query(
    "s05_skip_bottom",
    ctes("g") + "SELECT level - 10 AS level, y, x // 2 AS x, value FROM g WHERE level >= 10 AND x % 2 = 0",
)
def s05_skip_bottom(spark: SparkSession, sf: str) -> DataFrame:
    """Bottom ten levels dropped, x strided by two (the operator's own parameters)."""
    g = grid_field(spark, sf).where(F.col("level") >= 10)
    return rs.stride(g, 2).select((F.col("level") - 10).alias("level"), "y", "x", "value")


_MASK = """mask AS (SELECT loc, count(value) = (SELECT nl FROM sh) AND bool_or(value <> 0) AS is_active
  FROM g GROUP BY loc)"""


@query(
    "s06_masked_snapshots",
    more("g", "sh") + _MASK + """ SELECT level AS t, y AS lat_i, x AS lon_i,
  round((-90 + (y + 0.5)*180/sh.ny)::DOUBLE, 6) AS lat, round((-180 + (x + 0.5)*36.0)::DOUBLE, 6) AS lon,
  CASE WHEN is_active THEN value END AS value
FROM g JOIN mask USING (loc), sh""",
)
def s06_masked_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot series with latitude/longitude; masked cells are NULL."""
    shape = grid_shape(spark, sf)
    g = grid_field(spark, sf)
    mask = rs.active_mask(g, shape.n_levels)
    return g.join(mask, "loc").select(
        F.col("level").alias("t"), F.col("y").alias("lat_i"), F.col("x").alias("lon_i"),
        F.round(F.lit(-90.0) + (F.col("y") + 0.5) * 180 / shape.ny, 6).alias("lat"),
        F.round(F.lit(-180.0) + (F.col("x") + 0.5) * 36.0, 6).alias("lon"),
        F.when(F.col("is_active"), F.col("value")).alias("value"),
    )


@query("s07_mask_from_data", more("g", "sh") + _MASK + " SELECT loc, is_active FROM mask")
def s07_mask_from_data(spark: SparkSession, sf: str) -> DataFrame:
    return rs.active_mask(grid_field(spark, sf), grid_shape(spark, sf).n_levels)


@query(
    "s08_result_csv",
    ctes("g") + """SELECT 'M' || (level % 3)::VARCHAR AS method, loc AS k,
  CASE WHEN n_obs = 1 THEN NULL ELSE round(value, 6) END AS psnr,
  CASE WHEN n_obs = 2 THEN NULL ELSE n_obs END AS n_outliers FROM g""",
)
def s08_result_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Text rows in result-file form, with None and empty cells, coerced per column."""
    g = grid_field(spark, sf)
    line = F.concat_ws(
        ",",
        F.concat(F.lit("M"), F.col("level") % 3),
        F.col("loc"),
        F.when(F.col("n_obs") == 1, F.lit("None")).otherwise(F.col("value").cast("string")),
        F.when(F.col("n_obs") == 2, F.lit("")).otherwise(F.col("n_obs").cast("string")),
    )
    cell = F.split(line, ",")
    return g.select(
        cell[0].alias("method"),
        coerce(cell[1], "bigint").alias("k"),
        F.round(coerce(cell[2], "double"), 6).alias("psnr"),
        coerce(cell[3], "bigint").alias("n_outliers"),
    )


@query(
    "s09_timing_rows",
    ctes("s") + """SELECT kind AS method, loc % 4 AS k, round(value/1000, 9) AS sec, idx FROM s""",
)
def s09_timing_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The event stream read as timing records: method, k, seconds."""
    return event_series(spark, sf).select(
        F.col("kind").alias("method"), (F.col("loc") % 4).alias("k"),
        F.round(F.col("value") / 1000, 9).alias("sec"), "idx",
    )


@query(
    "s10_model_scan",
    ctes("g") + """SELECT loc, count(*) AS n_obs_levels, round(avg(value), 6) AS mu,
  round(CASE WHEN stddev_pop(value) < 1e-10 THEN 1 ELSE stddev_pop(value) END, 6) AS sd FROM g GROUP BY loc""",
)
def s10_model_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Per-location model columns (mean, guarded deviation) of the profile layout."""
    p = profiles(grid_field(spark, sf), grid_shape(spark, sf).n_levels)
    return p.select("loc", "n_obs_levels", F.round("mu", R6).alias("mu"), F.round("sd", R6).alias("sd"))


@query(
    "s12_latest_checkpoint",
    ctes("s") + """SELECT kind AS run, max(level) AS rounds, max_by(idx, level*1000000000000 + idx) AS last_idx
FROM s GROUP BY kind""",
)
def s12_latest_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Per run, the record with the most rounds (later record wins a tie)."""
    return event_series(spark, sf).groupBy(F.col("kind").alias("run")).agg(
        F.max("level").alias("rounds"),
        F.max_by("idx", F.struct("level", "idx")).alias("last_idx"),
    )


@query(
    "s13_packed_sensors",
    more("g", "p", "sens") + """x AS (SELECT p.level, sens.rank, p.resid FROM p JOIN sens USING (loc))
SELECT level, (8 + 4*count(*))::BIGINT AS n_bytes, count(*) AS k, sh.n AS n,
  round(sum(resid::FLOAT::DOUBLE), 4) AS payload_sum
FROM x, (SELECT max(loc)+1 AS n FROM g) sh GROUP BY level, sh.n""",
)
def s13_packed_sensors(spark: SparkSession, sf: str) -> DataFrame:
    """Per level: header (k, n) and float32 readings packed, then parsed again."""
    from fieldloom.plans.common import SENSORS, energetic_locations

    n = grid_shape(spark, sf).n_locs
    sensors = energetic_locations(spark, sf)
    rows = residual_field(spark, sf).join(sized_broadcast(sensors.select("loc", "rank"), SENSORS), "loc")
    per_level = rows.groupBy("level").agg(
        F.array_sort(F.collect_list(F.struct("rank", "resid")))["resid"].alias("v")
    )
    blob = per_level.select("level", pack_f32(F.col("v"), F.size("v"), F.lit(n)).alias("blob"))
    parsed = blob.select("level", F.length("blob").cast("bigint").alias("n_bytes"), unpack_f32(F.col("blob"), 2).alias("u"))
    total = F.aggregate("u.payload", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return parsed.select(
        "level", "n_bytes", F.col("u.header")[0].cast("bigint").alias("k"),
        F.col("u.header")[1].cast("bigint").alias("n"), F.round(total, 4).alias("payload_sum"),
    )


@query(
    "s14_analytic_fields",
    ctes("g", "sh") + """SELECT level, loc, round(0.6*a + sin(1.2*a), 9) AS f1,
  round(sin(a)*cos(b) + 0.2*a, 9) AS f2, round(sin(a)*cos(b) + 2*sin(2*c) + 0.2*a, 9) AS f3
FROM (SELECT level, loc, 10.0::DOUBLE*x/9 AS a, 6.0::DOUBLE*y/greatest(sh.ny-1, 1) AS b, 6.0::DOUBLE*level/(sh.nl-1) AS c
      FROM g, sh)""",
)
def s14_analytic_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Analytic test functions evaluated at every cell of the field."""
    shape = grid_shape(spark, sf)
    a = F.lit(10.0) * F.col("x") / 9
    b = F.lit(6.0) * F.col("y") / max(shape.ny - 1, 1)
    c = F.lit(6.0) * F.col("level") / (shape.n_levels - 1)
    return grid_field(spark, sf).select(
        "level", "loc",
        F.round(a * 0.6 + F.sin(a * 1.2), 9).alias("f1"),
        F.round(F.sin(a) * F.cos(b) + a * 0.2, 9).alias("f2"),
        F.round(F.sin(a) * F.cos(b) + F.sin(c * 2) * 2 + a * 0.2, 9).alias("f3"),
    )


@query(
    "s17_layer_profile",
    ctes("g", "sh").rstrip() + """, d AS (SELECT level, count(value) AS n, min(value) AS vmin, max(value) AS vmax,
  stddev_pop(value) AS sd, avg(value) AS mean FROM g GROUP BY level)
SELECT level, round(vmin, 6) AS vmin, round(vmax, 6) AS vmax, round(sd, 6) AS vstd,
  round(mean, 6) AS vmean, sh.n - d.n AS n_null FROM d, sh""",
)
def s17_layer_profile(spark: SparkSession, sf: str) -> DataFrame:
    n = grid_shape(spark, sf).n_locs
    return grid_field(spark, sf).groupBy("level").agg(
        F.round(F.min("value"), 6).alias("vmin"),
        F.round(F.max("value"), 6).alias("vmax"),
        F.round(F.stddev_pop("value"), 6).alias("vstd"),
        F.round(F.avg("value"), 6).alias("vmean"),
        (F.lit(n) - F.count("value")).cast("bigint").alias("n_null"),
    )
