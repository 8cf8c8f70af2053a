"""Quantisers, entropy, size accounting and Lorenzo predictors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions import quantisers as qz
from fieldloom.operators import entropy as en
from fieldloom.operators import sizing as sz
from fieldloom.operators.lorenzo import (
    code_near, decode_volume_bins, encode_volume, lorenzo_bin, lorenzo_series, plane_residual, with_lorenzo, with_neighbours,
)
from fieldloom.operators.quantiles import quantile_row
from fieldloom.operators.ratedist import Predictor, sweep
from fieldloom.operators.search import search_bound
from fieldloom.plans.common import r6
from fieldloom.plans.ratedist import BOUNDS, LORENZO_SQL, RESULTS_SQL, lorenzo_code_sql, results
from fieldloom.plans.registry import ctes, more, query
from fieldloom.session import cut_lineage
from fieldloom.sources.grid import NX, event_series, grid_field, grid_shape, residual_field

AB, NB = 20000.0, 256
EB = 200.0

_Q1 = more("g", "p") + """q AS (SELECT level, loc, resid, raw, abs(raw) >= 128 AS is_out FROM
  (SELECT *, round_even(resid/(2*20000.0::DOUBLE/256), 0)::BIGINT AS raw FROM p))"""


@query("q01_range_zero", _Q1 + "SELECT CASE WHEN is_out THEN 0 ELSE raw END AS bin, count(*) AS n FROM q GROUP BY 1")
def q01_range_zero(spark: SparkSession, sf: str) -> DataFrame:
    b = qz.range_bin(F.col("resid"), AB, NB, "zero")
    return en.bin_counts(residual_field(spark, sf).select(b.alias("bin")), [])


@query("q02_range_clip", _Q1 + "SELECT greatest(-127, least(127, raw)) AS bin, count(*) AS n FROM q GROUP BY 1")
def q02_range_clip(spark: SparkSession, sf: str) -> DataFrame:
    b = qz.range_bin(F.col("resid"), AB, NB, "clip")
    return en.bin_counts(residual_field(spark, sf).select(b.alias("bin")), [])


@query("q03_range_dequantise", _Q1 + """, d AS (SELECT *, CASE WHEN is_out THEN resid::FLOAT::DOUBLE ELSE raw*(2*20000.0::DOUBLE/256) END AS rec FROM q)
SELECT level, count(*) FILTER (is_out) AS n_outliers, round(max(CASE WHEN is_out THEN NULL ELSE abs(resid-rec) END), 6) AS max_err,
  round(sqrt(avg((resid-rec)**2)), 6) AS rmse FROM d GROUP BY level""")
def q03_range_dequantise(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("resid")
    d = residual_field(spark, sf).select(
        "level", qz.range_is_outlier(v, AB, NB).alias("out"),
        (v - qz.range_dequantise(v, AB, NB)).alias("err"),
    )
    return d.groupBy("level").agg(
        F.count_if("out").alias("n_outliers"),
        F.round(F.max(F.when(~F.col("out"), F.abs("err"))), 6).alias("max_err"),
        F.round(F.sqrt(F.avg(F.col("err") * F.col("err"))), 6).alias("rmse"),
    )


_LAP = more("g", "p") + """b AS (SELECT greatest(avg(abs(resid)), 1e-30) AS b FROM p),
w AS (SELECT level, loc, resid, abs(resid) > 20000 AS is_out, b FROM p, b),
q AS (SELECT *, CASE WHEN is_out THEN 0 ELSE greatest(-127, least(127, round_even(0.5*sign(resid)*(1-exp(-abs(resid)/b))*256, 0)::BIGINT)) END AS bin FROM w)"""


def _laplacian(spark: SparkSession, sf: str) -> DataFrame:
    f = residual_field(spark, sf)
    scale = f.select(F.greatest(F.avg(F.abs("resid")), F.lit(1e-30))).scalar()
    f = f.select("level", "resid", scale.alias("b"))
    return f.withColumn("bin", qz.laplacian_bin(F.col("resid"), F.col("b"), AB, NB))


@query("q04_laplacian_bins", _LAP + "SELECT bin, count(*) AS n FROM q GROUP BY bin")
def q04_laplacian_bins(spark: SparkSession, sf: str) -> DataFrame:
    return en.bin_counts(_laplacian(spark, sf), [])


@query("q05_laplacian_dequantise", _LAP + """, d AS (SELECT *, CASE WHEN is_out THEN resid ELSE sign(bin)*(-b*ln(1-2*least(abs(bin)/256.0::DOUBLE, 0.5-1e-15))) END::FLOAT::DOUBLE AS rec FROM q)
SELECT level, round(sqrt(avg((resid-rec)**2)), 5) AS rmse, count(*) FILTER (is_out) AS n_outliers FROM d GROUP BY level""")
def q05_laplacian_dequantise(spark: SparkSession, sf: str) -> DataFrame:
    q = _laplacian(spark, sf)
    rec = qz.laplacian_dequantise(F.col("resid"), F.col("bin"), F.col("b"), AB, NB)
    err = F.col("resid") - rec
    return q.groupBy("level").agg(
        F.round(F.sqrt(F.avg(err * err)), 5).alias("rmse"),
        F.count_if(F.abs("resid") > AB).alias("n_outliers"),
    )


@query("q06_laplacian_size", _LAP + """, c AS (SELECT bin, count(*) AS c FROM q GROUP BY bin),
h AS (SELECT sum(c) AS n, log2(sum(c)) - sum(c*log2(c))/sum(c) AS h FROM c)
SELECT n::BIGINT AS n, round(h, 6) AS entropy, (4 + ceil(round(n*h/8, 6)) + 64 + 4*(SELECT count(*) FROM q WHERE is_out))::BIGINT AS n_bytes FROM h""")
def q06_laplacian_size(spark: SparkSession, sf: str) -> DataFrame:
    """Scale, estimated stream and raw outlier values (positions are coded apart)."""
    counts = _laplacian(spark, sf).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs("resid") > AB).alias("o")
    )
    h = counts.agg(F.sum("n").alias("n"), en.entropy_of(F.col("n")).alias("entropy"), F.sum("o").alias("o"))
    size = en.huffman_bytes_flat(F.col("n"), F.col("entropy")) + 4 + F.col("o") * 4
    return h.select("n", F.round("entropy", 6).alias("entropy"), size.alias("n_bytes"))


_EBS = "e(eb) AS (VALUES (50.0::DOUBLE), (200.0), (1000.0)), q AS (SELECT eb, level, loc, resid, round_even(resid/(2*eb), 0)::BIGINT AS bin FROM p, e)"


def _error_bins(spark: SparkSession, sf: str) -> DataFrame:
    f = residual_field(spark, sf).withColumn("eb", F.explode(F.array(*[F.lit(e) for e in (50.0, 200.0, 1000.0)])))
    return f.withColumn("bin", qz.error_bin(F.col("resid"), F.col("eb")))


@query("q07_error_quantise", more("g", "p") + _EBS + """SELECT eb, count(*) AS n, round(sqrt(avg((resid-bin*2*eb)**2)), 6) AS rmse,
  max(abs(resid-bin*2*eb)) <= eb*(1+1e-9) AS within, min(bin) AS lo, max(bin) AS hi FROM q GROUP BY eb""")
def q07_error_quantise(spark: SparkSession, sf: str) -> DataFrame:
    eb = F.col("eb")
    err = F.col("resid") - qz.error_dequantise(F.col("bin"), eb)
    return _error_bins(spark, sf).groupBy("eb").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(err * err)), 6).alias("rmse"),
        (F.max(F.abs(err)) <= F.first(eb) * (1 + 1e-9)).alias("within"),
        F.min("bin").alias("lo"), F.max("bin").alias("hi"),
    )


@query("q08_entropy", more("g", "p") + _EBS + """, c AS (SELECT eb, level, bin, count(*) AS n FROM q GROUP BY ALL)
SELECT eb, level, sum(n)::BIGINT AS n, count(*) AS n_unique, round(log2(sum(n)) - sum(n*log2(n))/sum(n), 6) AS entropy FROM c GROUP BY eb, level""")
def q08_entropy(spark: SparkSession, sf: str) -> DataFrame:
    e = en.entropy_by(_error_bins(spark, sf), ["eb", "level"])
    return e.select("eb", "level", "n", "n_unique", F.round("entropy", 6).alias("entropy"))


def _huffman(spark: SparkSession, sf: str, outlier: str) -> DataFrame:
    f = residual_field(spark, sf).select("level", qz.range_bin(F.col("resid"), AB, NB, outlier).alias("bin"))
    return en.entropy_by(f, ["level"])


_HC = """, c AS (SELECT level, {b} AS bin, count(*) AS c FROM q GROUP BY ALL),
h AS (SELECT level, sum(c)::BIGINT AS n, count(*) AS n_unique, log2(sum(c)) - sum(c*log2(c))/sum(c) AS h FROM c GROUP BY level)
"""


@query("q09_huffman_codebook", _Q1 + _HC.format(b="CASE WHEN is_out THEN 0 ELSE raw END")
       + "SELECT level, n, n_unique, (floor((ceil(round(h*n, 6))+7)/8) + 3*n_unique + 10)::BIGINT AS n_bytes FROM h")
def q09_huffman_codebook(spark: SparkSession, sf: str) -> DataFrame:
    size = en.huffman_bytes_codebook(F.col("n"), F.col("entropy"), F.col("n_unique"))
    return _huffman(spark, sf, "zero").select("level", "n", "n_unique", size.alias("n_bytes"))


@query("q10_huffman_flat", _Q1 + _HC.format(b="greatest(-127, least(127, raw))")
       + "SELECT level, n, (ceil(round(n*h/8, 6)) + 64)::BIGINT AS n_bytes FROM h")
def q10_huffman_flat(spark: SparkSession, sf: str) -> DataFrame:
    size = en.huffman_bytes_flat(F.col("n"), F.col("entropy"))
    return _huffman(spark, sf, "clip").select("level", "n", size.alias("n_bytes"))


@query("q11_lossless_model")
def q11_lossless_model(spark: SparkSession, sf: str) -> DataFrame:
    """Compressed size of the mean field in three stored precisions (codec-version bound)."""
    mu = grid_field(spark, sf).groupBy("loc").agg(F.avg("value").alias("mu"))
    out = None
    for dtype in ("float16", "float32", "int32"):
        row = sz.lossless_bytes(mu, "loc", "mu", dtype).select(F.lit(dtype).alias("dtype"), "n_bytes")
        out = row if out is None else out.unionAll(row)
    return out


@query("q12_fixed_range_entropy", more("g", "p") + """b AS (SELECT level, CASE WHEN resid = 40*200 THEN 39 ELSE floor((resid + 40*200)/400)::BIGINT END AS bin FROM p WHERE abs(resid) <= 40*200),
c AS (SELECT level, bin, count(*) AS n FROM b GROUP BY ALL)
SELECT level, sum(n)::BIGINT AS n, round(log2(sum(n)) - sum(n*log2(n))/sum(n), 6) AS entropy FROM c GROUP BY level""")
def q12_fixed_range_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy over a +-40 EB histogram; values outside it do not count."""
    half, v = 40 * EB, F.col("resid")
    inside = residual_field(spark, sf).where(F.abs(v) <= half)
    b = F.when(v == half, F.lit(39).cast("bigint")).otherwise(F.floor((v + half) / (2 * EB)))
    e = en.entropy_by(inside.select("level", b.alias("bin")), ["level"])
    return e.select("level", "n", F.round("entropy", 6).alias("entropy"))


@query("q13_histogram_stats", more("g", "p") + """b AS (SELECT round_even(resid/20.0::DOUBLE, 0)::BIGINT AS bin FROM p)
SELECT count(*) AS n, count(*) FILTER (abs(bin) > 512) AS n_out, count(*) FILTER (bin = 0) AS n_zero,
  count(DISTINCT bin) FILTER (abs(bin) <= 512) AS n_unique,
  greatest(10, least(200, floor(quantile_cont(abs(bin)::DOUBLE, 0.99))::BIGINT + 5)) AS half_width FROM b""")
def q13_histogram_stats(spark: SparkSession, sf: str) -> DataFrame:
    """1024-bin residual histogram statistics at eb = 10."""
    f = residual_field(spark, sf).select(qz.error_bin(F.col("resid"), 10.0).alias("bin"))
    p99 = quantile_row(f, F.abs("bin"), q=0.99).select("q").scalar()
    per_bin = en.bin_counts(f, [])
    inside = F.abs("bin") <= 512
    return per_bin.agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("n_out"),
        F.coalesce(F.sum(F.when(F.col("bin") == 0, F.col("n"))), F.lit(0)).alias("n_zero"),
        F.count_if(inside).alias("n_unique"),
        F.max(F.greatest(F.lit(10), F.least(F.lit(200), F.floor(p99) + 5))).cast("bigint").alias("half_width"),
    )


@query("q14_histogram_true_zero", _Q1 + """SELECT CASE WHEN is_out THEN 0 ELSE raw END AS bin, count(*) AS n,
  count(*) FILTER (NOT is_out AND raw = 0) AS n_true_zero, count(*) FILTER (is_out) AS n_out FROM q GROUP BY 1""")
def q14_histogram_true_zero(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("resid")
    out, b = qz.range_is_outlier(v, AB, NB), qz.range_bin(v, AB, NB, "zero")
    return residual_field(spark, sf).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~out & (b == 0)).alias("n_true_zero"), F.count_if(out).alias("n_out")
    )


# Five largest residuals of every level: the sensor rule of the size queries.
_TOPK = more("g", "p", "sh") + """t AS (SELECT level, loc, resid, value, level*sh.ny*10 + loc AS flat FROM p, sh
  QUALIFY row_number() OVER (PARTITION BY level ORDER BY round(abs(resid), 6) DESC, loc) <= 5)"""


def level_sensors(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """Top-k |residual| per level.  The rank filter is applied before the shuffle too,
    so only k rows per level and task travel."""
    shape = grid_shape(spark, sf)
    order = Window.partitionBy("level").orderBy(F.desc(F.round(F.abs("resid"), 6)), "loc")
    return (
        residual_field(spark, sf)
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank") <= k)
        .withColumn("flat", F.col("level") * (shape.ny * 10) + F.col("loc"))
    )


@query("q15_sensor_storage", _TOPK + "SELECT level, loc, round(value::FLOAT::DOUBLE, 6) AS v32, round_even(value/200, 0)::BIGINT*200.0::DOUBLE AS v_eb FROM t")
def q15_sensor_storage(spark: SparkSession, sf: str) -> DataFrame:
    return level_sensors(spark, sf).select(
        "level", "loc", F.round(F.col("value").cast("float").cast("double"), 6).alias("v32"),
        sz.eb_quantised(F.col("value"), EB).alias("v_eb"),
    )


@query("q15_sensor_half")
def q15_sensor_half(spark: SparkSession, sf: str) -> DataFrame:
    """float16 storage of the readings; no SQL type for it."""
    s = level_sensors(spark, sf)
    return s.select("level", "loc", sz.half_precision(F.col("f_quantity")).alias("q16"))


@query("q16_observation_noise", more("g", "p") + """v AS (SELECT level, var_pop(resid)*1e-4 AS noise FROM p GROUP BY level), e(eb) AS (VALUES (50.0::DOUBLE), (200.0), (1000.0))
SELECT level, eb, round(greatest(noise, (eb/2)**2), 4) AS obs_noise FROM v, e""")
def q16_observation_noise(spark: SparkSession, sf: str) -> DataFrame:
    noise = residual_field(spark, sf).groupBy("level").agg((F.var_pop("resid") * 1e-4).alias("noise"))
    e = noise.withColumn("eb", F.explode(F.array(*[F.lit(x) for x in (50.0, 200.0, 1000.0)])))
    return e.select("level", "eb", F.round(sz.observation_noise(F.col("noise"), F.col("eb")), 4).alias("obs_noise"))


@query("q17_sensor_bits", _TOPK + """, gp AS (SELECT flat - coalesce(lag(flat) OVER (ORDER BY flat), -1) AS gap FROM t),
c AS (SELECT count(*) AS c FROM gp GROUP BY gap), v AS (SELECT count(*) AS c FROM t GROUP BY round_even(value/200, 0)),
hi AS (SELECT sum(c)::BIGINT AS k, log2(sum(c)) - sum(c*log2(c))/sum(c) AS h FROM c), hv AS (SELECT log2(sum(c)) - sum(c*log2(c))/sum(c) AS h FROM v)
SELECT k, round(hi.h*k, 4) AS index_bits, round(hv.h*k, 4) AS value_bits FROM hi, hv""")
def q17_sensor_bits(spark: SparkSession, sf: str) -> DataFrame:
    bits = sz.sensor_bits(level_sensors(spark, sf), "flat", "value", EB)
    return bits.select("k", F.round("index_bits", 4).alias("index_bits"), F.round("value_bits", 4).alias("value_bits"))


@query("q18_flat_sensor_cost", _TOPK.replace("t AS", _EBS + ", t AS") + """, c AS (SELECT eb, bin, count(*) AS c FROM q GROUP BY ALL),
h AS (SELECT eb, sum(c)::BIGINT AS n, log2(sum(c)) - sum(c*log2(c))/sum(c) AS h FROM c GROUP BY eb)
SELECT eb, round((64.0*(SELECT count(*) FROM t) + h*n)/n, 6) AS bit_rate FROM h""")
def q18_flat_sensor_cost(spark: SparkSession, sf: str) -> DataFrame:
    k = level_sensors(spark, sf).select(F.count(F.lit(1))).scalar()
    e = en.entropy_by(_error_bins(spark, sf), ["eb"])
    rate = (k * sz.FLAT_SENSOR_BITS + F.col("entropy") * F.col("n")) / F.col("n")
    return e.select("eb", F.round(rate, 6).alias("bit_rate"))


@query("q19_size_accounting", RESULTS_SQL + """ SELECT method, k, abs_bound, round(cr, 6) AS cr, round(cr_no_model, 6) AS cr_no_model,
  round(32/cr, 6) AS bpv, round(cr*(sh.n*sh.nl)/r.n, 6) AS cr_full_grid, round(cr*3, 6) AS cr_three_fields FROM r, sh""")
def q19_size_accounting(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios against active cells, the full grid and a three-field volume."""
    shape = grid_shape(spark, sf)
    cr, n = F.col("cr"), F.col("n")
    return results(spark, sf).select(
        "method", "k", "abs_bound", *r6("cr", "cr_no_model"), F.round(F.lit(32.0) / cr, 6).alias("bpv"),
        F.round(cr * (shape.n_locs * shape.n_levels) / n, 6).alias("cr_full_grid"),
        F.round(cr * 3, 6).alias("cr_three_fields"),
    )


@query("q20_closed_form_ratio", ctes("g", "sh") + """SELECT level AS k, count(*) AS n_cells, round(sh.nl*sh.n/(level*sh.n + sh.n + level + level*sh.nl), 6) AS cr_shared,
  round(sh.nl*sh.n/(level*(sh.nl+sh.n) + 2*sh.n + 2*level), 6) AS cr_single, round(sh.nl*sh.n/(2.0::DOUBLE*level), 6) AS cr_amortised
FROM g, sh WHERE level > 0 GROUP BY level, sh.nl, sh.n""")
def q20_closed_form_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Closed-form ratios with k equal to each level index of the field."""
    nl, n = grid_shape(spark, sf)
    k = F.col("level")
    g = grid_field(spark, sf).where(k > 0).groupBy("level").agg(F.count(F.lit(1)).alias("n_cells"))
    return g.select(
        k.alias("k"), "n_cells",
        F.round(sz.shared_basis_ratio(nl, n, k), 6).alias("cr_shared"),
        F.round(sz.volume_basis_ratio(nl, n, k, k), 6).alias("cr_single"),
        F.round(sz.volume_basis_ratio(nl, n, k, k, amortised=True), 6).alias("cr_amortised"),
    )


@query("q21_plugin_ratio", _TOPK + """ SELECT level, count(*) AS k, round(sh.n*4/(8 + 4.0::DOUBLE*count(*)), 6) AS ratio_2d,
  round(sh.n*4/(16 + 4.0::DOUBLE*count(*)), 6) AS ratio_3d, round(sh.n*12/(12 + 12.0::DOUBLE*count(*)), 6) AS ratio_fields FROM t, sh GROUP BY level, sh.n""")
def q21_plugin_ratio(spark: SparkSession, sf: str) -> DataFrame:
    n = grid_shape(spark, sf).n_locs
    k = F.col("k")
    per = level_sensors(spark, sf).groupBy("level").agg(F.count(F.lit(1)).alias("k"))
    return per.select(
        "level", "k", F.round(sz.plugin_ratio(n, k), 6).alias("ratio_2d"),
        F.round(sz.plugin_ratio(n, k, 16), 6).alias("ratio_3d"),
        F.round(sz.plugin_ratio(n, k, 12, 3), 6).alias("ratio_fields"),
    )


@query("q22_aligned_histogram", more("g", "p") + """ed AS (SELECT floor(quantile_cont(resid, 0.005)/400)*400 - 200 AS lo, ceil(quantile_cont(resid, 0.995)/400)*400 + 200 AS hi FROM p),
b AS (SELECT CASE WHEN resid = hi THEN floor((hi-lo)/400)::BIGINT - 1 ELSE floor((resid-lo)/400)::BIGINT END AS bin FROM p, ed WHERE resid BETWEEN lo AND hi)
SELECT bin, count(*) AS n, round(count(*)/(sum(count(*)) OVER ())::DOUBLE, 9) AS share FROM b GROUP BY bin""")
def q22_aligned_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram on quantiser-aligned edges spanning P0.5 to P99.5."""
    f = residual_field(spark, sf).select("resid")
    w = 2 * EB
    q = quantile_row(f, "resid", a=0.005, z=0.995)
    lo = q.select(F.floor(F.col("a") / w) * w - EB).scalar()
    hi = q.select(F.ceil(F.col("z") / w) * w + EB).scalar()
    v = F.col("resid")
    b = f.withColumn("lo", lo).withColumn("hi", hi).where(v.between(F.col("lo"), F.col("hi")))
    n_bins = F.floor((F.col("hi") - F.col("lo")) / w)
    counts = en.bin_counts(b.select(F.least(F.floor((v - F.col("lo")) / w), n_bins - 1).alias("bin")), [])
    total = counts.select(F.sum("n")).scalar()
    return counts.select("bin", "n", F.round(F.col("n") / total, 9).alias("share"))


@query("q24_lorenzo_codec", RESULTS_SQL + """ SELECT method, abs_bound, (floor((ceil(round(entropy*n, 6))+7)/8) + 3*n_unique + 10)::BIGINT AS n_bytes,
  round(4*n/(floor((ceil(round(entropy*n, 6))+7)/8) + 3*n_unique + 10), 6) AS cr, round(psnr, 6) AS psnr FROM r WHERE method LIKE 'LORENZO%'""")
def q24_lorenzo_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in for the external codecs: Lorenzo prediction, error quantiser, entropy coder."""
    cells = with_neighbours(grid_field(spark, sf))
    preds = [Predictor(f"LORENZO-{d}D", 0, F.lit(0.0), near=code_near(d)) for d in (1, 2, 3)]
    r = sweep(cells, "value", preds, BOUNDS)
    size = en.huffman_bytes_codebook(F.col("n"), F.col("entropy"), F.col("n_unique"))
    return r.select(
        "method", "abs_bound", size.alias("n_bytes"),
        F.round(F.col("n") * 4 / size, 6).alias("cr"), F.round("psnr", 6).alias("psnr"),
    )


@query("q24_codec_round_trip", more("g", "p") + """q AS (SELECT m.method, b.ab, value, round_even(value/(2*b.ab), 0)::BIGINT*2*b.ab AS rec
  FROM g, (VALUES ('LORENZO-1D'), ('LORENZO-2D'), ('LORENZO-3D')) m(method), (VALUES (100.0::DOUBLE), (3200.0)) b(ab))
SELECT method, ab AS abs_bound, count(*) AS n, round(max(abs(value-rec)), 6) AS max_err, max(abs(value-rec)) <= ab*1.000000001 AS within_bound,
  round(20*log10((max(value)-min(value))/sqrt(avg((value-rec)**2))), 6) AS psnr FROM q GROUP BY method, ab""")
def q24_codec_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Bins written, then decoded from the bins alone and compared with the field."""
    shape = grid_shape(spark, sf)
    cells = cut_lineage(grid_field(spark, sf).select("level", "loc", "value"))  # read by every round trip
    out = None
    for dims in (1, 2, 3):
        for ab in (100.0, 3200.0):
            bins = cut_lineage(encode_volume(cells, shape.n_levels, shape.n_locs, NX, dims, ab))
            both = cells.join(decode_volume_bins(bins, dims, ab), ["level", "loc"])
            err = F.col("value") - F.col("decoded")
            worst, spread = F.max(F.abs(err)), F.max("value") - F.min("value")
            row = both.agg(
                F.lit(f"LORENZO-{dims}D").alias("method"), F.lit(ab).alias("abs_bound"), F.count(F.lit(1)).alias("n"),
                F.round(worst, 6).alias("max_err"), (worst <= ab * 1.000000001).alias("within_bound"),
                F.round(20 * F.log10(spread / F.sqrt(F.avg(err * err))), 6).alias("psnr"),
            )
            out = row if out is None else out.unionAll(row)
    return out


@query("q25_codec_sweep", more("g", "p") + LORENZO_SQL + """, q AS (SELECT level, b.ab, value - round_even(value/(2*b.ab), 0)::BIGINT*2*b.ab AS err,
  round_even(value/(2*b.ab), 0)::BIGINT - """ + lorenzo_code_sql(2, "b.ab") + """ AS bin
  FROM lz, (VALUES (25.0::DOUBLE), (100.0), (400.0), (1600.0)) b(ab)),
c AS (SELECT level, ab, bin, count(*) AS c, sum(err**2) AS se FROM q GROUP BY ALL)
SELECT level, ab AS abs_bound, sum(c)::BIGINT AS n, round(log2(sum(c)) - sum(c*log2(c))/sum(c), 6) AS entropy, round(sqrt(sum(se)/sum(c)), 5) AS rmse FROM c GROUP BY level, ab""")
def q25_codec_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Per-slice codec runs over a bound list."""
    cells = with_neighbours(grid_field(spark, sf)).withColumn(
        "ab", F.explode(F.array(*[F.lit(b) for b in (25.0, 100.0, 400.0, 1600.0)]))
    )
    v, ab = F.col("value"), F.col("ab")
    q = cells.select("level", "ab", lorenzo_bin(v, code_near(2), ab).alias("bin"),
                     (v - qz.error_dequantise(qz.error_bin(v, ab), ab)).alias("err"))
    err = F.col("err")
    counts = q.groupBy("level", "ab", "bin").agg(F.count(F.lit(1)).alias("c"), F.sum(err * err).alias("se"))
    return counts.groupBy("level", F.col("ab").alias("abs_bound")).agg(
        F.sum("c").alias("n"), F.round(en.entropy_of(F.col("c")), 6).alias("entropy"),
        F.round(F.sqrt(F.sum("se") / F.sum("c")), 5).alias("rmse"),
    )


@query("q26_residual_codec", more("g", "p", "sh") + """r2 AS (SELECT p.*, value - resid AS base FROM p),
d AS (SELECT a.value, a.resid AS e, coalesce(w.resid, 0) AS at_w, coalesce(n.resid, 0) AS at_n, coalesce(nw.resid, 0) AS at_nw FROM p a
  LEFT JOIN p w ON w.level=a.level AND w.y=a.y AND w.x=a.x-1 LEFT JOIN p n ON n.level=a.level AND n.y=a.y-1 AND n.x=a.x
  LEFT JOIN p nw ON nw.level=a.level AND nw.y=a.y-1 AND nw.x=a.x-1),
q AS (SELECT ab, value, e - round_even(e/(2*ab), 0)::BIGINT*2*ab AS err, round_even(e/(2*ab), 0)::BIGINT - """ + lorenzo_code_sql(2, "ab") + """ AS bin FROM d, (VALUES (25.0::DOUBLE),(50.0),(100.0),(200.0),(400.0),(800.0),(1600.0),(3200.0)) b(ab)),
c AS (SELECT ab, bin, count(*) AS c, sum(err**2) AS se, max(value) AS hi, min(value) AS lo FROM q GROUP BY ALL),
h AS (SELECT ab, sum(c) AS n, log2(sum(c)) - sum(c*log2(c))/sum(c) AS h, sqrt(sum(se)/sum(c)) AS rmse, max(hi)-min(lo) AS vr FROM c GROUP BY ab)
SELECT ab AS abs_bound, h.n::BIGINT AS n, round(h, 6) AS entropy, round(h.n*4/(ceil(round(h.n*h/8, 6)) + 64 + 4*sh.n), 6) AS cr, round(20*log10(vr/rmse), 6) AS psnr FROM h, sh""")
def q26_residual_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid: mean model, its residual coded by the planar Lorenzo codec."""
    shape = grid_shape(spark, sf)
    cells = with_neighbours(residual_field(spark, sf), "resid")
    p = Predictor("MEAN+LORENZO", 0, F.col("mu"), 4 * shape.n_locs, near=code_near(2))
    return sweep(cells, "value", [p], BOUNDS).select("abs_bound", "n", *r6("entropy", "cr", "psnr"))


@query("q27_nearest_ratio", RESULTS_SQL + """, t(target) AS (VALUES (3.0::DOUBLE), (4.0), (6.0))
SELECT method, k, target, arg_min(abs_bound, round(abs(cr-target), 9)) AS abs_bound, round(arg_min(cr, round(abs(cr-target), 9)), 6) AS cr FROM r, t GROUP BY method, k, target""")
def q27_nearest_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Bound of the grid whose ratio is nearest to each target."""
    r = results(spark, sf).withColumn("target", F.explode(F.array(*[F.lit(t) for t in (3.0, 4.0, 6.0)])))
    gap = F.round(F.abs(F.col("cr") - F.col("target")), 9)
    return r.groupBy("method", "k", "target").agg(
        F.min_by("abs_bound", gap).alias("abs_bound"), F.round(F.min_by("cr", gap), 6).alias("cr")
    )


@query("q27_bound_search")
def q27_bound_search(spark: SparkSession, sf: str) -> DataFrame:
    """Bound that reaches a ratio of 4 with the mean predictor, refined bracket by bracket."""
    shape = grid_shape(spark, sf)
    p = Predictor("MEAN", 0, F.col("mu"), 4 * shape.n_locs)
    return search_bound(residual_field(spark, sf), "value", p, target=4.0, lo=1.0, hi=1e5)


@query("l01_lorenzo_series", ctes("s") + """SELECT idx, round(coalesce(value - lag(value) OVER (ORDER BY idx), 0), 6) AS resid FROM s""")
def l01_lorenzo_series(spark: SparkSession, sf: str) -> DataFrame:
    return lorenzo_series(event_series(spark, sf)).select("idx", F.round("resid", 6).alias("resid"))


@query("l02_lorenzo_plane", more("g", "p") + LORENZO_SQL + "SELECT level, loc, round(CASE WHEN x = 0 OR y = 0 THEN 0 ELSE value - lorenzo_2d END, 6) AS resid FROM lz")
def l02_lorenzo_plane(spark: SparkSession, sf: str) -> DataFrame:
    return plane_residual(grid_field(spark, sf)).select("level", "loc", F.round("resid", 6).alias("resid"))


@query("l03_lorenzo_cube", more("g", "p") + LORENZO_SQL + """SELECT level, loc, round(lorenzo_3d, 6) AS pred, abs(value - lorenzo_3d) > 20000 AS is_out FROM lz""")
def l03_lorenzo_cube(spark: SparkSession, sf: str) -> DataFrame:
    f = with_lorenzo(grid_field(spark, sf))
    return f.select(
        "level", "loc", F.round("lorenzo_3d", 6).alias("pred"),
        (F.abs(F.col("value") - F.col("lorenzo_3d")) > AB).alias("is_out"),
    )
