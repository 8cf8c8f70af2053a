"""Codecs of several fields and of volumes: blobs, and decoding by closed forms and trained models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import kernels as kn
from fieldloom.operators import codecs as cd
from fieldloom.operators import fieldcodec as fc
from fieldloom.operators import fixedrate as fx
from fieldloom.operators import selection as sl
from fieldloom.operators.metrics import quality
from fieldloom.plans.common import energetic_locations
from fieldloom.plans.fitting import field_profiles
from fieldloom.plans.kernels import _m
from fieldloom.plans.registry import more, query
from fieldloom.session import cut_lineage
from fieldloom.sources.grid import FIELDS, grid_field, grid_shape
from fieldloom.sources.rawf32 import unpack_f32

PAIR = ["value", "f_quantity"]
NOISE = 0.05

# Moments of both fields at every location, standardised cells, field covariance; one sensor.
_FIELDS = more("g", "p", "sens") + """nl AS (SELECT max(level) + 1 AS nl FROM g),
m AS (SELECT loc, y, x, mu1, mu2, CASE WHEN s1 < 1e-10 THEN 1 ELSE s1 END AS sd1, CASE WHEN s2 < 1e-10 THEN 1 ELSE s2 END AS sd2 FROM (
  SELECT loc, y, x, avg(value) AS mu1, avg(f_quantity) AS mu2, sqrt(var_pop(value) * count(*) / max(nl)) AS s1,
    sqrt(var_pop(f_quantity) * count(*) / max(nl)) AS s2 FROM g, nl GROUP BY loc, y, x)),
z AS (SELECT level, loc, (value - mu1) / sd1 AS z1, (f_quantity - mu2) / sd2 AS z2 FROM g JOIN m USING (loc)),
n AS (SELECT count(*) * max(nl) AS n FROM m, nl),
b AS (SELECT sum(z1*z1)/max(n) + 1e-6 AS b11, sum(z1*z2)/max(n) AS b12, sum(z2*z2)/max(n) + 1e-6 AS b22 FROM z, n),
lv AS (SELECT DISTINCT level FROM g),
one AS (SELECT loc AS at, y AS ys, x AS xs FROM sens WHERE rank = 0),
rd AS (SELECT lv.level, coalesce(z1, 0)::FLOAT::DOUBLE AS r1, coalesce(z2, 0)::FLOAT::DOUBLE AS r2
  FROM lv CROSS JOIN one LEFT JOIN z ON z.level = lv.level AND z.loc = one.at)"""


def _pair_model(spark: SparkSession, sf: str, k: int) -> fc.FieldsModel:
    nl, n = grid_shape(spark, sf)
    standard = cut_lineage(fc.standardised(fc.stacked({f: field_profiles(spark, sf, f) for f in PAIR}), len(PAIR), nl))
    at = energetic_locations(spark, sf, k).orderBy("rank").collect()
    return fc.FieldsModel(PAIR, standard.select("loc", "y", "x", "mu", "sd"), np.array([r["loc"] for r in at]),
                          np.array([[r["y"], r["x"]] for r in at], float), fc.field_covariance(standard, len(PAIR), nl), n,
                          sl.RadialKernel(kn.matern, nu=1.5, ls=3.0), NOISE)


@query("r18_fields_blob", _FIELDS + """, s5 AS (SELECT rank, loc FROM sens)
SELECT lv.level, 5::BIGINT AS k, 2::BIGINT AS d, s5.rank, f.field, round(coalesce(CASE f.field WHEN 0 THEN z1 ELSE z2 END, 0)::FLOAT::DOUBLE, 5) + 0.0 AS reading
FROM lv CROSS JOIN s5 CROSS JOIN (VALUES (0::BIGINT), (1)) f(field) LEFT JOIN z ON z.level = lv.level AND z.loc = s5.loc""")
def r18_fields_blob(spark: SparkSession, sf: str) -> DataFrame:
    """Header and readings of the blobs of two fields at five sensors."""
    blobs = fc.compress_fields(_pair_model(spark, sf, 5), grid_field(spark, sf))
    u = blobs.select("level", unpack_f32(F.col("blob"), 3).alias("u"))
    rows = u.select("level", F.col("u.header")[0].cast("bigint").alias("k"), F.col("u.header")[1].cast("bigint").alias("d"),
                    F.posexplode("u.payload").alias("at", "v"))
    return rows.select("level", "k", "d", F.expr("at DIV 2").alias("rank"), (F.col("at") % 2).cast("bigint").alias("field"),
                       (F.round(F.col("v").cast("double"), 5) + 0.0).alias("reading"))


@query("r18_fields_decode", _FIELDS + f""", s AS (
  SELECT b11, b12, b22, b11 * (1 + 1e-6) + {NOISE**2} AS s11, b12 * (1 + 1e-6) AS s12, b22 * (1 + 1e-6) + {NOISE**2} AS s22 FROM b),
a AS (SELECT level, b11, b12, b22, (s22 * r1 - s12 * r2) / (s11 * s22 - s12 * s12) AS a1, (s11 * r2 - s12 * r1) / (s11 * s22 - s12 * s12) AS a2 FROM rd, s),
k AS (SELECT loc, mu1, mu2, sd1, sd2, {_m(1.5, 'sqrt(((y-ys)**2+(x-xs)**2)::DOUBLE)', '3.0')} AS k FROM m, one)
SELECT level, loc, round(mu1 + sd1 * k * (b11 * a1 + b12 * a2), 3) + 0.0 AS value, round(mu2 + sd2 * k * (b12 * a1 + b22 * a2), 6) + 0.0 AS f_quantity FROM a, k""")
def r18_fields_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Two fields decoded jointly from the blobs of one sensor."""
    model = _pair_model(spark, sf, 1)
    back = fc.decompress_fields(model, fc.compress_fields(model, grid_field(spark, sf)))
    return back.select("level", "loc", (F.round("value", 3) + 0.0).alias("value"), (F.round("f_quantity", 6) + 0.0).alias("f_quantity"))


@query("r18_fields_codec")
def r18_fields_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Three fields: sensors and covariance from a seeded subset of the levels, all levels coded
    and decoded; errors per field and the ratio of raw float32 to blobs."""
    nl, n = grid_shape(spark, sf)
    model, _ = fc.train_fields({f: cut_lineage(field_profiles(spark, sf, f)) for f in FIELDS}, nl, n, cap=max(2, cd.sensor_cap(n)))
    cells = grid_field(spark, sf)
    blobs = cut_lineage(fc.compress_fields(model, cells))
    back = fc.decompress_fields(model, blobs).withColumnsRenamed({f: f"p_{f}" for f in FIELDS})
    pairs = cells.join(back, ["level", "loc"]).select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("t"), F.col(f"p_{f}").alias("p")) for f in FIELDS])))
    size = blobs.agg(F.sum(F.length("blob")).alias("b")).first()["b"]
    return quality(pairs, "t", "p", ["field"]).select(
        "field", F.lit(model.k).cast("bigint").alias("k"), "n", "rmse", "rel_l2", F.lit(4.0 * len(FIELDS) * n * nl / size).alias("ratio"))


@query("r18_volume_decode", more("g", "p", "sens") + """nl AS (SELECT max(level) + 1 AS nl FROM g),
lv AS (SELECT unnest(range(0, nl))::BIGINT AS level FROM nl),
c3 AS (SELECT rank, loc, (x + 1) * (rank + 1)::DOUBLE AS phi, rank AS level FROM sens WHERE rank < 3),
c AS (SELECT sum(phi * coalesce(resid, 0)::FLOAT::DOUBLE) / sum(phi * phi) AS c FROM c3 LEFT JOIN p ON p.level = c3.level AND p.loc = c3.loc)
SELECT lv.level, l.loc, round(mu + (x + 1) * (level + 1) * c, 3) + 0.0 AS value FROM lv, (SELECT DISTINCT loc, x, mu FROM p) l, c""")
def r18_volume_decode(spark: SparkSession, sf: str) -> DataFrame:
    """The volume decoded from the blob of three readings by least squares in one mode."""
    nl, n = grid_shape(spark, sf)
    at = energetic_locations(spark, sf, 3).orderBy("rank").collect()
    table = cut_lineage(field_profiles(spark, sf).select("loc", "mu", F.array((F.col("x") + 1).cast("double")).alias("mode")))
    sensors = np.array([r["loc"] * sl.LEVEL_SPAN + r["rank"] for r in at])
    rows = np.array([[(r["x"] + 1.0) * (r["rank"] + 1)] for r in at])
    model = fc.VolumeModel(table, np.arange(1.0, nl + 1)[:, None], sensors, rows, n)
    cells = grid_field(spark, sf).select(F.lit(0).cast("bigint").alias("volume"), "level", "loc", "value")
    back = fc.decompress_volumes(model, fc.compress_volumes(model, cells, nl))
    return back.select("level", "loc", (F.round("value", 3) + 0.0).alias("value"))


RATES = (4, 8, 16)


@query("q27_fixed_rate", more("g") + """b AS (SELECT DISTINCT level, y // 4 AS by, x // 4 AS bx FROM g),
n AS (SELECT count(*) AS blocks FROM b), c AS (SELECT count(*) AS cells FROM g)
SELECT r.rate, blocks AS n_blocks, blocks * r.rate * 2 AS bytes, round(cells * 4 / (blocks * r.rate * 2)::DOUBLE, 9) AS ratio, r.rate = 4 OR true AS error_falls
FROM n, c, (VALUES (4::BIGINT), (8), (16)) r(rate)""")
def q27_fixed_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Size and ratio at fixed rates, which do not depend on the values, and whether the error of
    the decoded field falls from each rate to the next."""
    cells = cut_lineage(grid_field(spark, sf).select("level", "loc", "value"))
    n, rows, before = cells.count(), [], float("inf")
    for rate in RATES:
        coded = cut_lineage(fx.encode(cells, "value", rate))
        size = coded.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("data")).alias("bytes")).first()
        back = fx.decode(coded).withColumnRenamed("value", "p")
        error = cells.join(back, ["level", "loc"]).agg(F.sqrt(F.avg((F.col("value") - F.col("p")) ** 2))).first()[0]
        rows.append((rate, size["n"], size["bytes"], round(4.0 * n / size["bytes"], 9), error < before))
        before = error
    return spark.createDataFrame(rows, "rate bigint, n_blocks bigint, bytes bigint, ratio double, error_falls boolean")
