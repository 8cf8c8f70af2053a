"""Quality metrics of the mean predictor and timing statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.operators import metrics as mt
from fieldloom.operators import reshape as rs
from fieldloom.operators import spectra
from fieldloom.operators.quantiles import exact_quantiles
from fieldloom.plans.common import r6
from fieldloom.plans.registry import ctes, more, query
from fieldloom.plans.sources import _MASK
from fieldloom.sources.grid import FIELDS, NX, event_series, grid_field, grid_shape, residual_field

_Q = """SELECT {by}count(*) AS n, sqrt(avg(resid**2)) AS rmse, avg(abs(resid)) AS mae, max(abs(resid)) AS max_err,
 max(value)-min(value) AS vr, sqrt(sum(resid**2)/sum(value**2)) AS rel_l2 FROM p {grp}"""


def _levels_quality(spark: SparkSession, sf: str, zero_error: str = "inf") -> DataFrame:
    return mt.quality(residual_field(spark, sf), "value", "mu", ["level"], zero_error)


@query("m01_psnr", more("g", "p") + "q AS (" + _Q.format(by="level, ", grp="GROUP BY level") + ") SELECT level, n, round(20*log10(vr/rmse), 6) AS psnr FROM q")
def m01_psnr(spark: SparkSession, sf: str) -> DataFrame:
    return _levels_quality(spark, sf).select("level", "n", *r6("psnr"))


@query("m02_psnr_sentinel", more("g", "p") + """q AS (SELECT loc, sqrt(avg((f_quantity - least(f_quantity, 50))**2)) AS rmse, max(f_quantity)-min(f_quantity) AS vr FROM p GROUP BY loc)
SELECT loc, round(CASE WHEN rmse*rmse < 1e-15 OR vr < 1e-10 THEN 999.9 ELSE 20*log10(vr/nullif(rmse, 0)) END::DOUBLE, 6) AS psnr FROM q""")
def m02_psnr_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    """Locations reproduced exactly get the sentinel."""
    f = grid_field(spark, sf).withColumn("pred", F.least("f_quantity", F.lit(50.0)))
    return mt.quality(f, "f_quantity", "pred", ["loc"], "sentinel").select("loc", *r6("psnr"))


@query("m03_global_psnr", more("g", "p", "sh") + _MASK + """ SELECT count(*) AS n, round(sqrt(avg(resid**2)), 6) AS rmse,
 round(20*log10((max(value)-min(value))/sqrt(avg(resid**2))), 6) AS psnr FROM p JOIN mask USING (loc) WHERE is_active""")
def m03_global_psnr(spark: SparkSession, sf: str) -> DataFrame:
    f = residual_field(spark, sf)
    active = rs.gather_active(f, rs.active_mask(f, grid_shape(spark, sf).n_levels))
    return mt.quality(active, "value", "mu").select("n", *r6("rmse", "psnr"))


@query("m04_masked_snapshot_psnr", more("g", "p", "sh") + _MASK + """ SELECT level, count(*) AS n,
 round(20*log10((max(value)-min(value))/sqrt(avg(resid**2))), 6) AS psnr FROM p JOIN mask USING (loc) WHERE is_active GROUP BY level""")
def m04_masked_snapshot_psnr(spark: SparkSession, sf: str) -> DataFrame:
    f = residual_field(spark, sf)
    active = rs.gather_active(f, rs.active_mask(f, grid_shape(spark, sf).n_levels))
    return mt.quality(active, "value", "mu", ["level"]).select("level", "n", *r6("psnr"))


@query("m05_ssim_windows", more("g", "p", "sh") + """w AS (SELECT a.level, a.loc, sum(b.value)/49 AS mx, sum(b.mu)/49 AS my, sum(b.value**2)/49 AS xx, sum(b.mu**2)/49 AS yy, sum(b.value*b.mu)/49 AS xy
 FROM p a JOIN p b ON b.level = a.level AND b.y BETWEEN a.y-3 AND a.y+3 AND b.x BETWEEN a.x-3 AND a.x+3, sh
 WHERE a.x BETWEEN 3 AND 6 AND a.y BETWEEN 3 AND sh.ny-4 GROUP BY a.level, a.loc),
r AS (SELECT max(value)-min(value) AS r FROM p)
SELECT level, count(*) AS n_windows, round(avg(((2*mx*my + (0.01*r)**2)*(2*(xy-mx*my)*49/48 + (0.03*r)**2)) / ((mx*mx+my*my+(0.01*r)**2)*((xx-mx*mx+yy-my*my)*49/48 + (0.03*r)**2))), 6) AS ssim
FROM w, r GROUP BY level""")
def m05_ssim_windows(spark: SparkSession, sf: str) -> DataFrame:
    f = residual_field(spark, sf).select("level", "loc", "y", "x", "value", "mu")
    spread = f.select(F.max("value") - F.min("value")).scalar()
    return mt.ssim_windowed(f, "value", "mu", grid_shape(spark, sf).ny, spread).select("level", "n_windows", *r6("ssim"))


@query("m06_ssim_single", more("g", "p") + """m AS (SELECT level, avg(value) AS mx, avg(mu) AS my, var_pop(value) AS vx, var_pop(mu) AS vy, covar_pop(value, mu) AS c, max(value)-min(value) AS r FROM p GROUP BY level)
SELECT level, round((2*mx*my + (0.01*r)**2)*(2*c + (0.03*r)**2) / ((mx*mx+my*my+(0.01*r)**2)*(vx+vy+(0.03*r)**2)), 6) AS ssim FROM m""")
def m06_ssim_single(spark: SparkSession, sf: str) -> DataFrame:
    return mt.ssim_single_window(residual_field(spark, sf), "value", "mu", ["level"]).select("level", *r6("ssim"))


@query("m07_error_per_field", more("g") + " UNION ALL ".join(["q AS (SELECT 'value' AS var, value AS v, value - avg(value) OVER (PARTITION BY loc) AS e FROM g"] + [
    f"SELECT '{f}', {f}, {f} - avg({f}) OVER (PARTITION BY loc) FROM g" for f in FIELDS[1:]]) + """)
SELECT var, round(sqrt(avg(e*e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(max(abs(e)), 6) AS max_err, round(max(v)-min(v), 6) AS range FROM q GROUP BY var""")
def m07_error_per_field(spark: SparkSession, sf: str) -> DataFrame:
    long = rs.long_form(grid_field(spark, sf), FIELDS)
    pred = long.withColumn("pred", F.avg("value").over(Window.partitionBy("loc", "var")))
    return mt.quality(pred, "value", "pred", ["var"]).select("var", *r6("rmse", "mae", "max_err", "range"))


@query("m08_relative_l2", more("g", "p") + """q AS (SELECT level, sum(resid**2) AS se, sum(value**2) AS sy FROM p GROUP BY level)
SELECT level, round(sqrt(se/sy), 9) AS rel_l2, round(sqrt((SELECT sum(se)/sum(sy) FROM q)), 9) AS rel_l2_all FROM q""")
def m08_relative_l2(spark: SparkSession, sf: str) -> DataFrame:
    f = residual_field(spark, sf)
    whole = mt.quality(f, "value", "mu").select("rel_l2").scalar()
    return _levels_quality(spark, sf).select(
        "level", F.round("rel_l2", 9).alias("rel_l2"), F.round(whole, 9).alias("rel_l2_all")
    )


@query("m09_rmse_triple", more("g", "p") + """l AS (SELECT level, sqrt(avg(resid**2)) AS rmse FROM p GROUP BY level)
SELECT round(sqrt(avg(resid**2)), 6) AS rmse_mean, round((SELECT median(rmse) FROM l), 6) AS rmse_med,
 round(sqrt(avg(resid**2))/(max(value)-min(value)), 9) AS nrmse, round(sqrt(sum(resid**2)/sum(value**2)), 9) AS rel_rmse FROM p""")
def m09_rmse_triple(spark: SparkSession, sf: str) -> DataFrame:
    med = _levels_quality(spark, sf).select(F.percentile("rmse", 0.5)).scalar()
    q = mt.quality(residual_field(spark, sf), "value", "mu")
    return q.select(
        F.round("rmse", 6).alias("rmse_mean"), F.round(med, 6).alias("rmse_med"),
        F.round("nrmse", 9).alias("nrmse"), F.round("rel_l2", 9).alias("rel_rmse"),
    )


@query("m10_error_summary", more("g", "p") + """l AS (SELECT level, sqrt(avg(resid**2)) AS e FROM p GROUP BY level)
SELECT round(min(e), 6) AS lo, round(median(e), 6) AS med, round(max(e), 6) AS hi, round(avg(e), 6) AS mean FROM l""")
def m10_error_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Summary over levels (one error each, so the exact percentile is small)."""
    return _levels_quality(spark, sf).agg(
        F.round(F.min("rmse"), 6).alias("lo"), F.round(F.percentile("rmse", 0.5), 6).alias("med"),
        F.round(F.max("rmse"), 6).alias("hi"), F.round(F.avg("rmse"), 6).alias("mean"),
    )


@query("m11_fraction_within", more("g", "p") + """SELECT level, eb, round(avg((abs(resid) < eb)::INT), 9) AS frac FROM p, (VALUES (2000.0::DOUBLE), (10000.0), (20000.0)) b(eb) GROUP BY level, eb""")
def m11_fraction_within(spark: SparkSession, sf: str) -> DataFrame:
    f = residual_field(spark, sf).withColumn("eb", F.explode(F.array(*[F.lit(b) for b in (2000.0, 10000.0, 20000.0)])))
    hit = (F.abs("resid") < F.col("eb")).cast("int")
    return f.groupBy("level", "eb").agg(F.round(F.avg(hit), 9).alias("frac"))


@query("m12_residual_table", more("g", "p") + """s AS (SELECT stddev_pop(resid) AS s FROM p)
SELECT level, count(*) AS n, round(sqrt(avg(resid**2)), 6) AS rmse, round(stddev_pop(resid), 6) AS sd, round(kurtosis_pop(resid), 6) AS kurtosis,
 count(*) FILTER (abs(resid) > 2*s) AS n_2s, count(*) FILTER (abs(resid) > 3*s) AS n_3s, count(*) FILTER (abs(resid) > 5*s) AS n_5s FROM p, s GROUP BY level""")
def m12_residual_table(spark: SparkSession, sf: str) -> DataFrame:
    f = residual_field(spark, sf)
    sigma = f.select(F.stddev_pop("resid")).scalar()
    return mt.residual_summary(f, "resid", ["level"], sigma).select(
        "level", "n", *r6("rmse", "sd", "kurtosis"), "n_2s", "n_3s", "n_5s"
    )


_AC = more("g", "p") + """f AS (SELECT level, y, x, resid - avg(resid) OVER (PARTITION BY level) AS f FROM p),
lag(d) AS (SELECT range - 3 FROM range(0, 7)),
z AS (SELECT level, sum(f*f) AS z FROM f GROUP BY level),
pr AS (SELECT l.level, a.d AS dy, b.d AS dx, coalesce(sum(f1.f*f2.f), 0) AS s FROM (SELECT DISTINCT level FROM f) l, lag a, lag b
  LEFT JOIN f f1 ON f1.level = l.level LEFT JOIN f f2 ON f2.level = f1.level AND f2.y = f1.y + a.d AND f2.x = f1.x + b.d GROUP BY ALL),
ac AS (SELECT level, dy, dx, s/z AS ac FROM pr JOIN z USING (level))"""


@query("m13_autocorrelation", _AC + "SELECT level, dy, dx, round(ac, 6) + 0.0 AS ac FROM ac")
def m13_autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    return spectra.autocorrelation(residual_field(spark, sf), "resid", 3, grid_shape(spark, sf).n_levels).select(
        "level", "dy", "dx", (F.round("ac", 6) + 0.0).alias("ac")
    )


@query("m14_radial_profile", _AC + """, r AS (SELECT level, floor(sqrt((dy*dy+dx*dx)::DOUBLE))::BIGINT AS r, avg(ac) AS m FROM ac GROUP BY ALL),
e AS (SELECT level, min(r) AS efold FROM r WHERE m < exp(-1) GROUP BY level)
SELECT level, r, round(m, 6) + 0.0 AS mean_ac, efold FROM r LEFT JOIN e USING (level)""")
def m14_radial_profile(spark: SparkSession, sf: str) -> DataFrame:
    prof = spectra.radial_profile(spectra.autocorrelation(residual_field(spark, sf), "resid", 3, grid_shape(spark, sf).n_levels))
    below = F.min(F.when(F.col("mean_ac") < F.exp(F.lit(-1.0)), F.col("r"))).over(Window.partitionBy("level"))
    return prof.select("level", "r", (F.round("mean_ac", 6) + 0.0).alias("mean_ac"), below.alias("efold"))


_ALL_LAGS = more("g", "p") + """n AS (SELECT max(l_suppkey) // 10 + 1 AS ny FROM lineitem),
f AS (SELECT level, y, x, resid - avg(resid) OVER (PARTITION BY level) AS f FROM p),
z AS (SELECT level, sum(f*f) AS z FROM f GROUP BY level),
lag AS (SELECT level, dy, dx FROM z, n, unnest(range(1 - ny, ny)) a(dy), unnest(range(-9, 10)) b(dx)),
s AS (SELECT f1.level, f2.y - f1.y AS dy, f2.x - f1.x AS dx, sum(f1.f*f2.f) AS s FROM f f1 JOIN f f2 USING (level) GROUP BY ALL),
ac AS (SELECT level, dy, dx, coalesce(s, 0)/z AS ac FROM lag LEFT JOIN s USING (level, dy, dx) JOIN z USING (level)),
r AS (SELECT level, floor(sqrt((dy*dy+dx*dx)::DOUBLE))::BIGINT AS r, avg(ac) AS m FROM ac GROUP BY ALL)"""


def _all_lags(spark: SparkSession, sf: str) -> DataFrame:
    shape = grid_shape(spark, sf)
    return spectra.autocorrelation(residual_field(spark, sf), "resid", None, shape.n_levels, ny=shape.ny)


@query("m13_all_lags", _ALL_LAGS + "SELECT level, dy, dx, round(ac, 6) + 0.0 AS ac FROM ac")
def m13_all_lags(spark: SparkSession, sf: str) -> DataFrame:
    return _all_lags(spark, sf).select("level", "dy", "dx", (F.round("ac", 6) + 0.0).alias("ac"))


@query("m14_all_radii", _ALL_LAGS + """, n2 AS (SELECT least(ny // 2, 5) AS r_max FROM n)
SELECT level, r, round(m, 6) + 0.0 AS mean_ac FROM r, n2 WHERE r < r_max""")
def m14_all_radii(spark: SparkSession, sf: str) -> DataFrame:
    """Radii up to half the shorter side of the grid, from all lags."""
    r_max = min(grid_shape(spark, sf).ny, NX) // 2
    return spectra.radial_profile(_all_lags(spark, sf), r_max=r_max).select("level", "r", (F.round("mean_ac", 6) + 0.0).alias("mean_ac"))


@query("m14_e_folding", _ALL_LAGS + "SELECT level, min(r) FILTER (m < exp(-1)) AS efold FROM r GROUP BY level")
def m14_e_folding(spark: SparkSession, sf: str) -> DataFrame:
    return spectra.e_folding(spectra.radial_profile(_all_lags(spark, sf)))


_TIME = more("s") + "t AS (SELECT kind AS method, loc % 4 AS k, value/1000 AS sec FROM s)"


def _timing(spark: SparkSession, sf: str) -> DataFrame:
    return event_series(spark, sf).select(
        F.col("kind").alias("method"), (F.col("loc") % 4).alias("k"), (F.col("value") / 1000).alias("sec")
    )


@query("m15_break_even", _TIME + """, m AS (SELECT method, k, median(sec) AS med, max(sec)*10 AS train FROM t GROUP BY ALL),
b AS (SELECT k, max(med) AS base FROM m GROUP BY k)
SELECT method, k, round(med, 6) AS med, round(CASE WHEN med < base THEN train/(base-med) END, 4) AS n_break_even,
 round(train + 100*med, 6) AS cost_100 FROM m JOIN b USING (k)""")
def m15_break_even(spark: SparkSession, sf: str) -> DataFrame:
    """Uses needed before training pays off against the slowest method of the same k."""
    t = _timing(spark, sf)
    groups = t.select("method", "k").distinct().count()
    med = exact_quantiles(t, "sec", [0.5], ["method", "k"], groups).select("method", "k", F.col("q").alias("med"))
    train = t.groupBy("method", "k").agg((F.max("sec") * 10).alias("train"))
    m = med.join(train, ["method", "k"]).withColumn("base", F.max("med").over(Window.partitionBy("k")))
    gain = F.col("base") - F.col("med")
    return m.select(
        "method", "k", F.round("med", 6).alias("med"),
        F.round(F.when(gain > 0, F.col("train") / gain), 4).alias("n_break_even"),
        F.round(F.col("train") + F.col("med") * 100, 6).alias("cost_100"),
    )


@query("m16_timing_stats", _TIME + """ SELECT method, k, count(*) AS n, round(median(sec), 6) AS med, round(stddev_pop(sec), 6) AS sd,
 round(sum(sec)*1000/count(*), 4) AS ms_per_item, round(4e-6::DOUBLE*count(*)/sum(sec), 9) AS mb_per_s FROM t GROUP BY method, k""")
def m16_timing_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = _timing(spark, sf)
    groups = t.select("method", "k").distinct().count()
    med = exact_quantiles(t, "sec", [0.5], ["method", "k"], groups).select("method", "k", F.round("q", 6).alias("med"))
    n, total = F.count(F.lit(1)), F.sum("sec")
    return t.groupBy("method", "k").agg(
        n.alias("n"), F.round(F.stddev_pop("sec"), 6).alias("sd"),
        F.round(total * 1000 / n, 4).alias("ms_per_item"), F.round(n * 4e-6 / total, 9).alias("mb_per_s"),
    ).join(med, ["method", "k"])


@query("m17_field_statistics", ctes("g") + " UNION ALL ".join(
    f"SELECT '{f}' AS var, level, round(avg({f}), 6) AS mean, round(stddev_pop({f}), 6) AS sd, round(min({f}), 6) AS vmin, round(max({f}), 6) AS vmax FROM g GROUP BY level" for f in FIELDS))
def m17_field_statistics(spark: SparkSession, sf: str) -> DataFrame:
    long = rs.long_form(grid_field(spark, sf), FIELDS)
    return long.groupBy("var", "level").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"),
        F.round(F.min("value"), 6).alias("vmin"), F.round(F.max("value"), 6).alias("vmax"),
    )


@query("mq_exact_quantiles", more("g", "p") + """SELECT level, pr AS p, round(quantile_cont(resid, [0.005, 0.25, 0.5, 0.75, 0.98, 0.995])[i], 6) AS q
FROM p, (VALUES (0.005::DOUBLE, 1), (0.25, 2), (0.5, 3), (0.75, 4), (0.98, 5), (0.995, 6)) t(pr, i) GROUP BY level, pr, i""")
def mq_exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles of every level by sketch bracketing."""
    probs = [0.005, 0.25, 0.5, 0.75, 0.98, 0.995]
    q = exact_quantiles(residual_field(spark, sf), "resid", probs, ["level"], grid_shape(spark, sf).n_levels)
    return q.select("level", "p", F.round("q", 6).alias("q"))
