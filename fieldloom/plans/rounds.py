"""Progressive rounds and what is derived from them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions import kernels as kn
from fieldloom.operators import progressive as pg
from fieldloom.operators import selection as sl
from fieldloom.operators.entropy import entropy_of
from fieldloom.operators.quantiles import quantile_row
from fieldloom.plans.common import r6
from fieldloom.plans.kernels import _m
from fieldloom.plans.registry import more, query
from fieldloom.sources.grid import NX, grid_shape, residual_field

ACCEPT, EB = 15000.0, 1500.0
CONFIG = pg.RoundConfig(accept=ACCEPT, eb=EB, k_per_round=1, max_rounds=2)


def _dist(a: str, b: str) -> str:
    return f"sqrt((({a}.y-{b}.y)**2 + ({a}.x-{b}.x)**2)::DOUBLE)"


def _k(a: str, b: str) -> str:
    return _m(2.5, _dist(a, b), "2.0")


# Two rounds, one sensor per level and round, exact one- and two-sensor solutions.
ROUNDS_SQL = more("g", "p", "sh") + f"""s1 AS (SELECT level, loc, y, x, resid AS e FROM p QUALIFY row_number() OVER (PARTITION BY level ORDER BY round(abs(resid), 6) DESC, loc) = 1),
r1 AS (SELECT p.*, p.loc = s1.loc AS sen1, resid - {_k('p', 's1')}*s1.e/1.001 AS err1 FROM p JOIN s1 USING (level)),
t1 AS (SELECT *, NOT sen1 AND abs(err1) < 15000 AS acc1 FROM r1),
s2 AS (SELECT level, loc, y, x, resid AS e FROM t1 WHERE NOT sen1 AND NOT acc1 QUALIFY row_number() OVER (PARTITION BY level ORDER BY round(abs(err1), 6) DESC, loc) = 1),
al AS (SELECT s1.level, s1.y AS y1, s1.x AS x1, s2.y AS y2, s2.x AS x2, s2.loc AS loc2, (1.001*s1.e - c*s2.e)/(1.001*1.001 - c*c) AS a1, (1.001*s2.e - c*s1.e)/(1.001*1.001 - c*c) AS a2
  FROM (SELECT s1.level, {_k('s1', 's2')} AS c FROM s1 JOIN s2 USING (level)) JOIN s1 USING (level) JOIN s2 USING (level)),
k2 AS (SELECT t1.*, coalesce(t1.loc = al.loc2, false) AS sen2, a1, a2, sqrt(((y-y1)**2+(x-x1)**2)::DOUBLE) AS d1, sqrt(((y-y2)**2+(x-x2)**2)::DOUBLE) AS d2 FROM t1 LEFT JOIN al USING (level)),
r2 AS (SELECT *, coalesce(resid - ({_m(2.5, 'd1', '2.0')}*a1 + {_m(2.5, 'd2', '2.0')}*a2), err1) AS err2 FROM k2),
t2 AS (SELECT *, NOT sen1 AND NOT acc1 AND NOT sen2 AND abs(err2) < 15000 AS acc2 FROM r2),
h AS (SELECT 1 AS round, level, loc, value, resid, CASE WHEN sen1 THEN 0 ELSE err1 END AS e, CASE WHEN sen1 THEN 'sensor' WHEN acc1 THEN 'settled' ELSE 'open' END AS role FROM t2
  UNION ALL SELECT 2, level, loc, value, resid, CASE WHEN sen1 OR sen2 THEN 0 WHEN acc1 THEN err1 ELSE err2 END, CASE WHEN sen1 OR sen2 THEN 'sensor' WHEN acc1 OR acc2 THEN 'settled' ELSE 'open' END FROM t2)
"""


def two_rounds(spark: SparkSession, sf: str) -> pg.RoundResult:
    return pg.run_rounds(residual_field(spark, sf), "resid", CONFIG)


def history(spark: SparkSession, sf: str) -> DataFrame:
    return pg.union_history(two_rounds(spark, sf).history)


def _role():
    return F.when(F.col("sensed").isNotNull(), "sensor").when(F.col("settled").isNotNull(), "settled").otherwise("open")


@query("g02_level_rounds", ROUNDS_SQL + """SELECT 1::BIGINT AS round, count(*) AS n, count(*) FILTER (sen1) AS n_sensed, count(*) FILTER (acc1) AS n_settled, count(*) FILTER (NOT sen1 AND NOT acc1) AS n_left FROM t2
UNION ALL SELECT 2, count(*), count(*) FILTER (sen2), count(*) FILTER (acc2), count(*) FILTER (NOT sen1 AND NOT acc1 AND NOT sen2 AND NOT acc2) FROM t2""")
def g02_level_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds, every level its own process."""
    rows = [(r["round"], r["n"], r["n_sensed"], r["n_settled"], r["n_left"]) for r in two_rounds(spark, sf).records]
    return spark.createDataFrame(rows, "round bigint, n bigint, n_sensed bigint, n_settled bigint, n_left bigint")


@query("g05_accepted", ROUNDS_SQL + "SELECT level, loc, round(err1, 5) AS err FROM t2 WHERE acc1 UNION ALL SELECT level, loc, round(err2, 5) FROM t2 WHERE acc2")
def g05_accepted(spark: SparkSession, sf: str) -> DataFrame:
    s = two_rounds(spark, sf).state.where(F.col("settled").isNotNull())
    return s.select("level", "loc", F.round("settled_err", 5).alias("err"))


@query("g06_candidate_state", ROUNDS_SQL + "SELECT round::BIGINT AS round, level, loc, role FROM h")
def g06_candidate_state(spark: SparkSession, sf: str) -> DataFrame:
    return history(spark, sf).select("round", "level", "loc", _role().alias("role"))


@query("g07_error_array", ROUNDS_SQL + "SELECT round::BIGINT AS round, level, loc, round(e, 5) + 0.0 AS err FROM h")
def g07_error_array(spark: SparkSession, sf: str) -> DataFrame:
    return history(spark, sf).select("round", "level", "loc", (F.round("full_err", 5) + 0.0).alias("err"))


@query("g08_replay", ROUNDS_SQL + "SELECT round::BIGINT AS round, level, loc, role, round(e, 5) + 0.0 AS err FROM h WHERE round = 2")
def g08_replay(spark: SparkSession, sf: str) -> DataFrame:
    """State rebuilt from the round tables."""
    points = history(spark, sf).select("round", "level", "loc", _role().alias("role"), F.col("full_err").alias("err"))
    return pg.replay(points).select("round", "level", "loc", "role", (F.round("err", 5) + 0.0).alias("err"))


_POINT = """, sen AS (SELECT level*sh.n + loc AS flat, resid FROM t2, sh WHERE sen1 OR sen2), gp AS (SELECT flat - coalesce(lag(flat) OVER (ORDER BY flat), -1) AS gap FROM sen),
ci AS (SELECT count(*) AS c FROM gp GROUP BY gap), cv AS (SELECT count(*) AS c FROM sen GROUP BY round_even(resid/1500, 0)),
hi AS (SELECT sum(c) AS k, (log2(sum(c)) - sum(c*log2(c))/sum(c))*sum(c) AS bits FROM ci), hv AS (SELECT (log2(sum(c)) - sum(c*log2(c))/sum(c))*sum(c) AS bits FROM cv)"""


def _curve(bounds: str, include: bool = False) -> str:
    keep = "true" if include else "role <> 'sensor'"
    return f""", qb AS (SELECT eb, role, resid, e, round_even(e/(2*eb), 0)::BIGINT AS bin FROM h, (VALUES {bounds}) b(eb) WHERE round = 2),
cb AS (SELECT eb, bin, count(*) AS c FROM qb WHERE {keep} GROUP BY ALL), he AS (SELECT eb, sum(c) AS n_resid, log2(sum(c)) - sum(c*log2(c))/sum(c) AS h FROM cb GROUP BY eb),
qe AS (SELECT eb, count(*) AS n, sqrt(avg((e-bin*2*eb)**2)) AS rmse, max(resid)-min(resid) AS vr FROM qb GROUP BY eb)"""


@query("g09_stop_estimate", ROUNDS_SQL + _POINT + _curve("(1500.0::DOUBLE)") + """ SELECT round((hi.bits + hv.bits + h*n_resid)/n, 6) AS bit_rate, round(32/((hi.bits + hv.bits + h*n_resid)/n), 6) AS cr,
 (32/((hi.bits + hv.bits + h*n_resid)/n)) >= 6 AS ratio_met, 20*log10(vr/rmse) >= 60 AS quality_met, (hi.bits + hv.bits + h*n_resid)/n <= 6 AS rate_met FROM hi, hv, he JOIN qe USING (eb)""")
def g09_stop_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """What the stopping rule sees after two rounds, and which targets it would meet."""
    p = pg.rd_point(two_rounds(spark, sf).state, EB)
    return p.select(
        *r6("bit_rate", "cr"), (F.col("cr") >= 6).alias("ratio_met"), (F.col("psnr") >= 60).alias("quality_met"),
        (F.col("bit_rate") <= 6).alias("rate_met"),
    )


@query("g10_rd_point", ROUNDS_SQL + _POINT + _curve("(1500.0::DOUBLE)") + """ SELECT eb, n, hi.k::BIGINT AS k_total, round(h, 6) AS entropy, round(hi.bits, 4) AS index_bits, round(hv.bits, 4) AS value_bits,
 round((hi.bits + hv.bits + h*n_resid)/n, 6) AS bit_rate, round(rmse, 5) AS rmse, round(20*log10(vr/rmse), 6) AS psnr FROM hi, hv, he JOIN qe USING (eb)""")
def g10_rd_point(spark: SparkSession, sf: str) -> DataFrame:
    p = pg.rd_point(two_rounds(spark, sf).state, EB)
    return p.select(
        "eb", "n", "k_total", *r6("entropy"), F.round("index_bits", 4).alias("index_bits"),
        F.round("value_bits", 4).alias("value_bits"), *r6("bit_rate"), F.round("rmse", 5).alias("rmse"), *r6("psnr"),
    )


@query("g11_rd_curve", ROUNDS_SQL + _curve("(100.0::DOUBLE), (400.0), (1600.0), (6400.0)", include=True) + """ SELECT eb, n, round(h, 6) AS entropy, round(rmse, 5) AS rmse, round((64.0*(SELECT count(*) FROM t2 WHERE sen1 OR sen2) + h*n)/n, 6) AS bit_rate FROM he JOIN qe USING (eb)""")
def g11_rd_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Final round re-quantised over a bound list, flat sensor cost."""
    s = two_rounds(spark, sf).state
    k = s.select(F.count("sensed")).scalar()
    c = pg.rd_curve(s, [100.0, 400.0, 1600.0, 6400.0], include_sensors=True)
    return c.select(
        "eb", "n", *r6("entropy"), F.round("rmse", 5).alias("rmse"),
        F.round((k * 64 + F.col("entropy") * F.col("n")) / F.col("n"), 6).alias("bit_rate"),
    )


_RMSE = "lr AS (SELECT round, level, sqrt(avg(e*e)) AS rmse FROM h GROUP BY ALL)"


def _level_rmse(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("full_err")
    return history(spark, sf).groupBy("round", "level").agg(F.sqrt(F.avg(e * e)).alias("rmse"))


@query("g12_level_rmse", ROUNDS_SQL + ", " + _RMSE + " SELECT round::BIGINT AS round, level, round(rmse, 5) AS rmse FROM lr")
def g12_level_rmse(spark: SparkSession, sf: str) -> DataFrame:
    return _level_rmse(spark, sf).select("round", "level", F.round("rmse", 5).alias("rmse"))


@query("g13_fractions", ROUNDS_SQL + """, f AS (SELECT 1 AS round, count(*) AS n, count(*) FILTER (acc1) AS c, count(*) FILTER (sen1) AS s, count(*) AS pool FROM t2
 UNION ALL SELECT 2, count(*), count(*) FILTER (acc2), count(*) FILTER (sen2), count(*) FILTER (NOT sen1 AND NOT acc1) FROM t2)
SELECT round::BIGINT AS round, round(c/n, 9) AS frac_new, round(sum(c) OVER (ORDER BY round)/n, 9) AS frac_done, round(c/(pool - s), 9) AS pool_rate FROM f""")
def g13_fractions(spark: SparkSession, sf: str) -> DataFrame:
    """Newly settled, cumulative and pool share per round (one row per round)."""
    rows = [(r["round"], r["n"], r["n_settled"], r["n_left"]) for r in two_rounds(spark, sf).records]
    f = spark.createDataFrame(rows, "round bigint, n bigint, c bigint, n_left bigint")
    n, c = F.col("n"), F.col("c")
    done = F.sum(c).over(Window.orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return f.select(
        "round", F.round(c / n, 9).alias("frac_new"), F.round(done / n, 9).alias("frac_done"),
        F.round(c / (c + F.col("n_left")), 9).alias("pool_rate"),
    )


@query("a24_worst_level", ROUNDS_SQL + ", " + _RMSE + " SELECT round::BIGINT AS round, level, round(rmse, 5) AS rmse FROM lr QUALIFY row_number() OVER (PARTITION BY round ORDER BY round(rmse, 5) DESC, level) = 1")
def a24_worst_level(spark: SparkSession, sf: str) -> DataFrame:
    key = F.struct(F.round("rmse", 5), -F.col("level"))
    return _level_rmse(spark, sf).groupBy("round").agg(
        F.max_by("level", key).alias("level"), F.round(F.max("rmse"), 5).alias("rmse")
    )


@query("m18_settled_share", ROUNDS_SQL + """, f AS (SELECT round, level, avg((role = 'settled')::INT) AS f FROM h GROUP BY ALL)
SELECT round::BIGINT AS round, count(*) AS n_levels, round(avg(f), 9) AS mean, round(stddev_pop(f), 9) AS sd FROM f GROUP BY round""")
def m18_settled_share(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and deviation over levels of the settled share per round."""
    per = history(spark, sf).groupBy("round", "level").agg(F.avg(F.col("settled").isNotNull().cast("int")).alias("f"))
    return per.groupBy("round").agg(
        F.count(F.lit(1)).alias("n_levels"), F.round(F.avg("f"), 9).alias("mean"), F.round(F.stddev_pop("f"), 9).alias("sd")
    )


@query("m19_pooled_histogram", ROUNDS_SQL + """, ed AS (SELECT floor(quantile_cont(e, 0.005)/3000)*3000 - 1500 AS lo, ceil(quantile_cont(e, 0.995)/3000)*3000 + 1500 AS hi FROM h),
b AS (SELECT round, least(floor((e-lo)/3000)::BIGINT, ((hi-lo)/3000)::BIGINT - 1) AS bin FROM h, ed WHERE e BETWEEN lo AND hi)
SELECT round::BIGINT AS round, bin, count(*) AS n, round(count(*)/(sum(count(*)) OVER (PARTITION BY round))::DOUBLE, 9) AS share FROM b GROUP BY round, bin""")
def m19_pooled_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Per-round error histogram pooled over levels on shared aligned edges."""
    h = history(spark, sf).select("round", F.col("full_err").alias("e"))
    w = 2 * EB
    q = quantile_row(h, "e", a=0.005, z=0.995)
    b = h.withColumn("lo", q.select(F.floor(F.col("a") / w) * w - EB).scalar()).withColumn(
        "hi", q.select(F.ceil(F.col("z") / w) * w + EB).scalar()
    ).where(F.col("e").between(F.col("lo"), F.col("hi")))
    last = F.round((F.col("hi") - F.col("lo")) / w).cast("bigint") - 1
    c = b.groupBy("round", F.least(F.floor((F.col("e") - F.col("lo")) / w), last).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("round"))
    return c.select("round", "bin", "n", F.round(share, 9).alias("share"))


@query("q23_round_bit_rate", ROUNDS_SQL + """, b AS (SELECT round, floor((e + 1500)/3000)::BIGINT AS bin, count(*) AS c FROM h GROUP BY ALL),
hh AS (SELECT round, sum(c) AS n, log2(sum(c)) - sum(c*log2(c))/sum(c) AS h FROM b GROUP BY round),
k AS (SELECT round, count(*) FILTER (role = 'settled') AS cc, count(*) FILTER (role = 'sensor') AS ss, sqrt(avg(e*e)) AS rmse, max(resid)-min(resid) AS vr FROM h GROUP BY round)
SELECT round::BIGINT AS round, round(h, 6) AS entropy, round((cc*h + ss*128 + (n-cc-ss)*32)/n, 6) AS bits_per_element, round(20*log10(vr/rmse), 6) AS psnr FROM hh JOIN k USING (round)""")
def q23_round_bit_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Bit rate if the run stopped here: settled at H, sensors 128, the rest 32 bits."""
    h = history(spark, sf)
    e = F.col("full_err")
    b = h.groupBy("round", F.floor((e + EB) / (2 * EB)).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    ent = b.groupBy("round").agg(F.sum("c").alias("n"), entropy_of(F.col("c")).alias("h"))
    k = h.groupBy("round").agg(
        F.count_if(F.col("settled").isNotNull() & F.col("sensed").isNull()).alias("cc"), F.count("sensed").alias("ss"),
        F.sqrt(F.avg(e * e)).alias("rmse"), (F.max("v") - F.min("v")).alias("vr"),
    )
    cc, ss, n = F.col("cc"), F.col("ss"), F.col("n")
    bits = (cc * F.col("h") + ss * 128 + (n - cc - ss) * 32) / n
    return ent.join(k, "round").select(
        "round", F.round("h", 6).alias("entropy"), F.round(bits, 6).alias("bits_per_element"),
        F.round(F.log10(F.col("vr") / F.col("rmse")) * 20, 6).alias("psnr"),
    )


def _records(spark: SparkSession, res: pg.RoundResult) -> DataFrame:
    rows = [(r["round"], r["n"], r["n_sensed"], r["n_settled"], r["n_left"], res.stopped) for r in res.records]
    return spark.createDataFrame(rows, "round bigint, n bigint, n_sensed bigint, n_settled bigint, n_left bigint, stopped string")


def volume_config(spark: SparkSession, sf: str, **kw) -> pg.RoundConfig:
    """3-D process on unit-cube coordinates."""
    shape = grid_shape(spark, sf)
    ext = (float(max(shape.n_levels - 1, 1)), float(max(shape.ny - 1, 1)), float(NX - 1))
    base = pg.RoundConfig(
        accept=ACCEPT, eb=EB, k_per_round=20, max_rounds=2, scope="volume", strategy="rpgks",
        kernel=sl.RadialKernel(kn.matern, nu=2.5, ls=0.2), scales=ext, n_local=16, seed=7,
    )
    return replace(base, **kw)


@query("g01_volume_rounds")
def g01_volume_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """3-D rounds: column-subset sensors, local prediction from the nearest sensors."""
    return _records(spark, pg.run_rounds(residual_field(spark, sf), "resid", volume_config(spark, sf)))


@query("g03_volume_targets")
def g03_volume_targets(spark: SparkSession, sf: str) -> DataFrame:
    """3-D rounds that stop at a quality target."""
    cfg = volume_config(spark, sf, strategy="max_residual", max_rounds=4, target_psnr=41.0)
    return _records(spark, pg.run_rounds(residual_field(spark, sf), "resid", cfg))


@query("g04_snapshot_rounds")
def g04_snapshot_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Every snapshot on its own: covariance-based sensors, then the worst quarter."""
    cfg = replace(CONFIG, k_per_round=4, strategy="hybrid", storage="float16")
    res = pg.run_rounds(residual_field(spark, sf), "resid", cfg)
    d = pg.decode(res.state, cfg)
    return d.groupBy("level").agg(
        F.count("sensed").alias("n_sensors"), F.count("settled").alias("n_settled"),
        F.sqrt(F.avg(F.col("decode_err") * F.col("decode_err"))).alias("decode_rmse"),
    )


@query("g14_length_scale_sweep")
def g14_length_scale_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """One round per length scale over the same field."""
    out = []
    for ls in (1.0, 4.0):
        cfg = replace(CONFIG, max_rounds=1, kernel=sl.RadialKernel(kn.matern, nu=2.5, ls=ls))
        res = pg.run_rounds(residual_field(spark, sf), "resid", cfg)
        p = pg.rd_point(res.state, EB).first()
        out.append((ls, p["bit_rate"], p["cr"], p["psnr"], p["k_total"]))
    return spark.createDataFrame(out, "ls double, bit_rate double, cr double, psnr double, k_total bigint")
