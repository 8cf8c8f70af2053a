"""Rate-distortion analytics over the result table, and figure tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.operators import fronts as fr
from fieldloom.operators.lorenzo import with_lorenzo
from fieldloom.operators.metrics import quality
from fieldloom.operators.quantiles import exact_quantiles, quantile_row
from fieldloom.plans.common import r6

from fieldloom.plans.ratedist import LORENZO_SQL, RESULTS_SQL, results, stored_results
from fieldloom.plans.registry import more, query
from fieldloom.sources.grid import residual_field

_ROW = ("method", "k", "abs_bound")
_PICK = "method, k, abs_bound, round(cr, 6) AS cr, round(psnr, 6) AS psnr"


def _pick(df: DataFrame) -> DataFrame:
    return df.select(*_ROW, *r6("cr", "psnr"))


def _front_sql(order: str, op: str, part: str = "method") -> str:
    return RESULTS_SQL + f"""SELECT {_PICK} FROM (SELECT *, max(psnr) OVER (PARTITION BY {part} ORDER BY {order}, k, abs_bound
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r) WHERE b IS NULL OR psnr {op} b"""


@query("a01_running_max_strict", _front_sql("cr", ">"))
def a01_running_max_strict(spark: SparkSession, sf: str) -> DataFrame:
    return _pick(fr.running_max_by_cr(results(spark, sf)))


@query("a02_running_max_ties", _front_sql("cr", ">="))
def a02_running_max_ties(spark: SparkSession, sf: str) -> DataFrame:
    return _pick(fr.running_max_by_cr(results(spark, sf), keep_ties=True))


@query("a03_pareto_front", _front_sql("cr DESC", ">"))
def a03_pareto_front(spark: SparkSession, sf: str) -> DataFrame:
    return _pick(fr.pareto_front(results(spark, sf)))


@query("a03_pareto_front_bpv", _front_sql("32/cr", ">=").replace("round(cr, 6) AS cr", "round(32/cr, 6) AS bpv"))
def a03_pareto_front_bpv(spark: SparkSession, sf: str) -> DataFrame:
    front = fr.pareto_front(results(spark, sf), keep_ties=True)
    return front.select(*_ROW, F.round(F.lit(32.0) / F.col("cr"), 6).alias("bpv"), *r6("psnr"))


_TRIM = """tr AS (SELECT * FROM (SELECT *, max(rise) OVER (PARTITION BY method, k ORDER BY abs_bound DESC) AS anyrise FROM
 (SELECT *, coalesce((cr > lag(cr) OVER (PARTITION BY method, k ORDER BY abs_bound DESC))::INT, 0) AS rise FROM r)) WHERE anyrise = 0)"""


@query("a04_trim_after_reversal", RESULTS_SQL + ",\n" + _TRIM + f" SELECT {_PICK} FROM tr")
def a04_trim_after_reversal(spark: SparkSession, sf: str) -> DataFrame:
    return _pick(fr.trim_after_reversal(results(spark, sf)))


@query("a05_keep_rising", RESULTS_SQL + f"""SELECT {_PICK} FROM (SELECT *, max(cr) OVER (PARTITION BY method, k ORDER BY abs_bound
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r) WHERE b IS NULL OR cr >= b""")
def a05_keep_rising(spark: SparkSession, sf: str) -> DataFrame:
    return _pick(fr.keep_rising(results(spark, sf)))


@query("a06_nearest_ratio", RESULTS_SQL + f"""SELECT {_PICK} FROM r QUALIFY row_number() OVER (PARTITION BY method ORDER BY round(abs(cr-5), 9), k, abs_bound) = 1""")
def a06_nearest_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _pick(fr.nearest_ratio(results(spark, sf), 5.0))


@query("a07_best_quality", RESULTS_SQL + f"SELECT {_PICK} FROM r QUALIFY row_number() OVER (PARTITION BY method ORDER BY round(psnr, 9) DESC, k, abs_bound) = 1")
def a07_best_quality(spark: SparkSession, sf: str) -> DataFrame:
    return _pick(fr.first_by(results(spark, sf), ["method"], F.desc(F.round("psnr", 9)), "k", "abs_bound"))


@query("a08_common_target", RESULTS_SQL + """, t AS (SELECT method, max(cr) AS top FROM r GROUP BY method)
SELECT round(min(top), 6) AS target_cr, arg_min(method, top) AS bottleneck FROM t""")
def a08_common_target(spark: SparkSession, sf: str) -> DataFrame:
    return fr.common_ratio(results(spark, sf)).select(F.round("target_cr", 6).alias("target_cr"), "bottleneck")


@query("a09_best_k_per_bound", RESULTS_SQL + """SELECT method, abs_bound, round(max(psnr), 6) AS best, arg_max(k, round(psnr, 9)*1000 - k*1e-6) AS best_k FROM r GROUP BY ALL""")
def a09_best_k_per_bound(spark: SparkSession, sf: str) -> DataFrame:
    key = F.round("psnr", 9) * 1000 - F.col("k") * 1e-6
    return results(spark, sf).groupBy("method", "abs_bound").agg(
        F.round(F.max("psnr"), 6).alias("best"), F.max_by("k", key).alias("best_k")
    )


_MID = "mid AS (SELECT *, row_number() OVER (PARTITION BY method, k ORDER BY abs_bound) AS rn, count(*) OVER (PARTITION BY method, k) AS cnt FROM r)"


@query("a10_middle_bound", RESULTS_SQL + ",\n" + _MID + f" SELECT {_PICK} FROM mid WHERE rn = cnt//2 + 1")
def a10_middle_bound(spark: SparkSession, sf: str) -> DataFrame:
    return _pick(fr.middle_row(results(spark, sf)))


@query("a11_budget_breakdown", RESULTS_SQL + """SELECT method, k, abs_bound, round(model_mb, 6) AS model_mb, round(sv_mb, 6) AS sv_mb, round(resid_mb, 6) AS resid_mb,
 round(greatest(0, model_mb+sv_mb+resid_mb - model_mb), 6) AS other_mb FROM r QUALIFY row_number() OVER (PARTITION BY method, k ORDER BY abs_bound) = 1""")
def a11_budget_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    tight = fr.first_by(results(spark, sf), ["method", "k"], "abs_bound")
    other = F.greatest(F.lit(0.0), F.col("model_mb") + F.col("sv_mb") + F.col("resid_mb") - F.col("model_mb"))
    return tight.select(*_ROW, *r6("model_mb", "sv_mb", "resid_mb"), F.round(other, 6).alias("other_mb"))


@query("a12_curves", RESULTS_SQL + """, m AS (SELECT method, quantile_disc(k, 0.5) AS mk, min(k) || '-' || max(k) AS label FROM (SELECT DISTINCT method, k FROM r) GROUP BY method)
SELECT method, k, row_number() OVER (PARTITION BY method, k ORDER BY cr, abs_bound) AS pos, round(cr, 6) AS cr, round(psnr, 6) AS psnr, round(ssim, 6) AS ssim, label, k = mk AS is_median_k FROM r JOIN m USING (method)""")
def a12_curves(spark: SparkSession, sf: str) -> DataFrame:
    """Curve points per k in ratio order, the k range label and the median-k proxy."""
    r = stored_results(spark, sf)
    ks = r.groupBy("method").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    ks = ks.select(
        "method",
        F.col("ks")[F.floor((F.size("ks") - 1) / 2).cast("int")].alias("mk"),
        F.concat_ws("-", F.array_min("ks"), F.array_max("ks")).alias("label"),
    )
    order = Window.partitionBy("method", "k").orderBy("cr", "abs_bound")
    return r.join(ks, "method").select(
        "method", "k", F.row_number().over(order).cast("bigint").alias("pos"),
        *r6("cr", "psnr", "ssim"), "label", (F.col("k") == F.col("mk")).alias("is_median_k"),
    )


_INTERP = """{n} AS (SELECT {by}, gi AS i, max(y0 + (y1-y0)*(x-x0)/(x1-x0)) AS v FROM
 (SELECT *, log10(cr) AS x0, psnr AS y0, log10(lead(cr) OVER (PARTITION BY {by} ORDER BY cr)) AS x1, lead(psnr) OVER (PARTITION BY {by} ORDER BY cr) AS y1 FROM {src}) s
 JOIN gr ON gr.x BETWEEN s.x0 AND s.x1 GROUP BY {by}, gi)"""


@query("a13_win_regions", RESULTS_SQL + ",\n" + _TRIM + """,
base AS (SELECT * FROM tr WHERE method = 'LORENZO-1D'), mine AS (SELECT * FROM r WHERE method IN ('MEAN', 'SENSOR')),
lim AS (SELECT greatest((SELECT min(log10(cr)) FROM base), (SELECT min(log10(cr)) FROM mine)) AS a, least((SELECT max(log10(cr)) FROM base), (SELECT max(log10(cr)) FROM mine)) AS z),
gr AS (SELECT range AS gi, a + range*((z-a)/799) AS x FROM range(0, 800), lim),
""" + _INTERP.format(n="im", by="method, k", src="mine") + ",\n" + _INTERP.format(n="ib", by="method", src="base") + """,
w AS (SELECT e.i, e.ours, ib.v AS theirs FROM (SELECT i, max(v) AS ours FROM im GROUP BY i) e JOIN ib USING (i) WHERE round(e.ours - ib.v, 9) > 0),
isl AS (SELECT *, i - row_number() OVER (ORDER BY i) AS g FROM w)
SELECT min(i) AS i_from, max(i) AS i_to, count(*) AS n_points, round(max(ours-theirs), 6) AS max_gain FROM isl GROUP BY g""")
def a13_win_regions(spark: SparkSession, sf: str) -> DataFrame:
    w = fr.win_regions(stored_results(spark, sf), ["MEAN", "SENSOR"], "LORENZO-1D")
    return w.select("i_from", "i_to", "n_points", *r6("max_gain"))


@query("a14_front_per_k", _front_sql("cr DESC", ">", "method, k"))
def a14_front_per_k(spark: SparkSession, sf: str) -> DataFrame:
    """Front per sensor-count multiplier."""
    return _pick(fr.pareto_front(results(spark, sf), by=["method", "k"]))


@query("a15_method_summary", RESULTS_SQL + """, mk AS (SELECT method, quantile_disc(k, 0.5) AS k FROM (SELECT DISTINCT method, k FROM r) GROUP BY method)
SELECT r.method, r.k, r.abs_bound, round(cr, 6) AS cr, round(psnr, 6) AS psnr, round(ssim, 6) AS ssim FROM r JOIN mk ON r.method = mk.method AND r.k = mk.k
QUALIFY row_number() OVER (PARTITION BY r.method ORDER BY abs_bound) = 1""")
def a15_method_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Median k of every method at its tightest bound."""
    r = stored_results(spark, sf)
    ks = r.groupBy("method").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    mk = ks.select("method", F.col("ks")[F.floor((F.size("ks") - 1) / 2).cast("int")].alias("k"))
    return fr.first_by(r.join(mk, ["method", "k"], "left_semi"), ["method"], "abs_bound").select(
        *_ROW, *r6("cr", "psnr", "ssim")
    )


@query("a16_group_by_method", RESULTS_SQL + "SELECT method, k, count(*) AS n_rows, round(min(cr), 6) AS cr_lo, round(max(cr), 6) AS cr_hi FROM r GROUP BY method, k")
def a16_group_by_method(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).groupBy("method", "k").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.min("cr"), 6).alias("cr_lo"), F.round(F.max("cr"), 6).alias("cr_hi")
    )


@query("a17_resume_pending", RESULTS_SQL + """, done AS (SELECT * FROM r WHERE psnr > 55)
SELECT method, k, abs_bound FROM r ANTI JOIN done USING (method, k, abs_bound)""")
def a17_resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    from fieldloom.sources.results import not_yet_done

    r = stored_results(spark, sf)
    return not_yet_done(r.select(*_ROW), r.where("psnr > 55"), _ROW)


@query("a18_clamped_k", RESULTS_SQL + "SELECT DISTINCT method, least(k, 3) AS k_eff FROM r")
def a18_clamped_k(spark: SparkSession, sf: str) -> DataFrame:
    """Sensor counts after the cap, duplicates dropped."""
    cap = F.least(F.col("k"), F.lit(3).cast("bigint"))
    return results(spark, sf).select("method", cap.alias("k_eff")).distinct()


@query("a19_winner_per_bound", RESULTS_SQL + """SELECT a.abs_bound, CASE WHEN round(a.cr-b.cr, 9) > 0 THEN a.method WHEN round(a.cr-b.cr, 9) < 0 THEN b.method ELSE 'tie' END AS winner,
 round(a.cr/b.cr, 6) AS ratio FROM r a JOIN r b USING (abs_bound) WHERE a.method = 'MEAN' AND b.method = 'LORENZO-2D'""")
def a19_winner_per_bound(spark: SparkSession, sf: str) -> DataFrame:
    r = results(spark, sf)
    one = lambda m, c: F.max(F.when(F.col("method") == m, F.col("cr"))).alias(c)
    both = r.groupBy("abs_bound").agg(one("MEAN", "a"), one("LORENZO-2D", "b"))
    gap = F.round(F.col("a") - F.col("b"), 9)
    return both.select(
        "abs_bound", F.when(gap > 0, "MEAN").when(gap < 0, "LORENZO-2D").otherwise("tie").alias("winner"),
        F.round(F.col("a") / F.col("b"), 6).alias("ratio"),
    )


@query("a20_error_scale", more("g", "p") + """SELECT round(quantile_cont(resid, 0.0005), 6) AS p_lo, round(quantile_cont(resid, 0.9995), 6) AS p_hi,
 round(quantile_cont(abs(resid), 0.98), 6) AS a98, round(quantile_cont(abs(resid), 0.995), 6) AS a995 FROM p""")
def a20_error_scale(spark: SparkSession, sf: str) -> DataFrame:
    f = residual_field(spark, sf)
    s = quantile_row(f, "resid", p_lo=0.0005, p_hi=0.9995)
    a = quantile_row(f, F.abs("resid"), a98=0.98, a995=0.995)
    return s.select(
        *r6("p_lo", "p_hi"),
        F.round(a.select("a98").scalar(), 6).alias("a98"), F.round(a.select("a995").scalar(), 6).alias("a995"),
    )


@query("a21_showcase_levels", more("g", "p") + """l AS (SELECT level, round(sqrt(sum(resid**2)/sum(value**2)), 9) AS e FROM p GROUP BY level)
SELECT * FROM (SELECT 'best' AS pick, level, e FROM l ORDER BY e, level LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'typical', level, e FROM l ORDER BY round(abs(e - (SELECT median(e) FROM l)), 9), level LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'worst', level, e FROM l ORDER BY e DESC, level LIMIT 1)""")
def a21_showcase_levels(spark: SparkSession, sf: str) -> DataFrame:
    q = quality(residual_field(spark, sf), "value", "mu", ["level"]).select("level", F.round("rel_l2", 9).alias("e"))
    med = q.select(F.percentile("e", 0.5)).scalar()
    picks = {"best": F.col("e"), "typical": F.round(F.abs(F.col("e") - F.col("med")), 9), "worst": -F.col("e")}
    tagged = q.withColumn("med", med).select(
        "level", "e", F.explode(F.array(*[F.struct(F.lit(n).alias("pick"), c.alias("key")) for n, c in picks.items()])).alias("p")
    )
    return fr.first_by(tagged.select("level", "e", "p.*"), ["pick"], "key", "level").select("pick", "level", "e")


@query("a22_config_grid", RESULTS_SQL + """, c AS (SELECT m.method, b.ab, l.lossless FROM (SELECT DISTINCT method FROM r) m, bounds b, (VALUES ('huffman'), ('none')) l(lossless))
SELECT c.method, c.ab AS abs_bound, lossless, CASE WHEN c.method = 'SENSOR' AND lossless = 'none' THEN 'error' ELSE 'ok' END AS status,
 round(CASE WHEN c.method = 'SENSOR' AND lossless = 'none' THEN NULL WHEN lossless = 'none' THEN 1.0 ELSE x.cr END, 6) AS cr
FROM c LEFT JOIN (SELECT method, abs_bound, max(cr) AS cr FROM r GROUP BY ALL) x ON x.method = c.method AND x.abs_bound = c.ab""")
def a22_config_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Discovered codecs x bounds x lossless stage; a failing configuration is a row."""
    best = results(spark, sf).groupBy("method", "abs_bound").agg(F.max("cr").alias("cr"))
    full = best.withColumn("lossless", F.explode(F.array(F.lit("huffman"), F.lit("none"))))
    bad = (F.col("method") == "SENSOR") & (F.col("lossless") == "none")
    cr = F.when(bad, None).when(F.col("lossless") == "none", 1.0).otherwise(F.col("cr"))
    return full.select(
        "method", "abs_bound", "lossless", F.when(bad, "error").otherwise("ok").alias("status"), F.round(cr, 6).alias("cr")
    )


@query("a23_sensors_per_level", more("g", "p", "sh") + """t AS (SELECT level FROM p QUALIFY row_number() OVER (ORDER BY round(abs(resid), 6) DESC, level, loc) <= 200)
SELECT level, count(*) AS n_sensors FROM t GROUP BY level""")
def a23_sensors_per_level(spark: SparkSession, sf: str) -> DataFrame:
    """Where the 200 globally largest residuals sit (a top-k report)."""
    top = residual_field(spark, sf).orderBy(F.desc(F.round(F.abs("resid"), 6)), "level", "loc").limit(200)
    return top.groupBy("level").agg(F.count(F.lit(1)).alias("n_sensors"))


@query("a25_matched_histogram", more("g", "p") + LORENZO_SQL + """, e AS (SELECT 'MEAN' AS method, abs(resid) AS e FROM lz UNION ALL SELECT 'LORENZO-2D', abs(value-lorenzo_2d) FROM lz),
t AS (SELECT quantile_cont(e, 0.95) AS top FROM e),
b AS (SELECT method, CASE WHEN e = top THEN 199 ELSE floor(e/(top/200))::BIGINT END AS bin FROM e, t WHERE e <= top)
SELECT method, bin, count(*) AS n FROM b GROUP BY ALL""")
def a25_matched_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Absolute-error histograms on a common scale: 200 bins on [0, pooled P95]."""
    e = _abs_errors(spark, sf)
    top = quantile_row(e, "e", top=0.95).select("top").scalar()
    b = e.withColumn("top", top).where(F.col("e") <= F.col("top"))
    bin_ = F.when(F.col("e") == F.col("top"), F.lit(199).cast("bigint")).otherwise(F.floor(F.col("e") / (F.col("top") / 200)))
    return b.groupBy("method", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _abs_errors(spark: SparkSession, sf: str) -> DataFrame:
    f = with_lorenzo(residual_field(spark, sf))
    return f.select(F.explode(F.array(
        F.struct(F.lit("MEAN").alias("method"), F.abs("resid").alias("e")),
        F.struct(F.lit("LORENZO-2D").alias("method"), F.abs(F.col("value") - F.col("lorenzo_2d")).alias("e")),
    )).alias("s")).select("s.*")


@query("a25_error_percentiles", more("g", "p") + LORENZO_SQL + """, e AS (SELECT 'MEAN' AS method, abs(resid) AS e FROM lz UNION ALL SELECT 'LORENZO-2D', abs(value-lorenzo_2d) FROM lz),
t AS (SELECT quantile_cont(e, 0.95) AS top FROM e)
SELECT method, round(median(e), 6) AS med, round(quantile_cont(e, 0.95), 6) AS p95, round(avg((e > top)::INT), 6) AS clipped FROM e, t GROUP BY method""")
def a25_error_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    e = _abs_errors(spark, sf)
    top = quantile_row(e, "e", top=0.95).select("top").scalar()
    q = exact_quantiles(e, "e", [0.5, 0.95], ["method"], 2).groupBy("method").agg(
        F.round(F.max(F.when(F.col("p") == 0.5, F.col("q"))), 6).alias("med"),
        F.round(F.max(F.when(F.col("p") == 0.95, F.col("q"))), 6).alias("p95"),
    )
    clipped = e.withColumn("top", top).groupBy("method").agg(
        F.round(F.avg((F.col("e") > F.col("top")).cast("int")), 6).alias("clipped")
    )
    return q.join(clipped, "method")


@query("a26_level_classes", more("g", "p") + """l AS (SELECT level, sqrt(sum(resid**2)/nullif(sum(value**2), 0)) AS e, count(*) FILTER (abs(resid) > 20000) AS n_above, count(resid) AS n_valid FROM p GROUP BY level)
SELECT level, CASE WHEN e IS NULL THEN 'undefined' WHEN e > 0.35 THEN 'exceeds' ELSE 'within' END AS class, n_above, n_valid FROM l""")
def a26_level_classes(spark: SparkSession, sf: str) -> DataFrame:
    r, v = F.col("resid"), F.col("value")
    per = residual_field(spark, sf).groupBy("level").agg(
        F.sqrt(F.sum(r * r) / F.nullif(F.sum(v * v), F.lit(0.0))).alias("e"),
        F.count_if(F.abs(r) > 20000).alias("n_above"), F.count(r).alias("n_valid"),
    )
    cls = F.when(F.col("e").isNull(), "undefined").when(F.col("e") > 0.35, "exceeds").otherwise("within")
    return per.select("level", cls.alias("class"), "n_above", "n_valid")


@query("a27_two_stage_nearest", RESULTS_SQL + f"""SELECT {_PICK} FROM r QUALIFY row_number() OVER (PARTITION BY method ORDER BY abs(k-3), k, abs(abs_bound-120), abs_bound) = 1""")
def a27_two_stage_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest k to 3, then nearest bound to 120."""
    order = (F.abs(F.col("k") - 3), "k", F.abs(F.col("abs_bound") - 120), "abs_bound")
    return _pick(fr.first_by(results(spark, sf), ["method"], *order))
