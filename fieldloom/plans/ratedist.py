"""Rate-distortion tables over the derived field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.lorenzo import CORNERS, SIGNS, code_near, with_neighbours
from fieldloom.operators.ratedist import Predictor, sweep
from fieldloom.plans.registry import more, query
from fieldloom.session import cut_lineage, sized_broadcast
from fieldloom.sources.grid import grid_shape, residual_field

BOUNDS = [25.0, 50.0, 100.0, 200.0, 400.0, 800.0, 1600.0, 3200.0]
SENSOR_COUNTS = [1, 2, 4, 8]


@query(
    "rd_mean_predictor",
    more("g", "p")
    + """b(eb) AS (VALUES (50.0::DOUBLE), (200.0::DOUBLE), (1000.0::DOUBLE)),
q AS (SELECT eb, value, resid, round_even(resid/(2*eb), 0)::BIGINT AS bin FROM p, b),
c AS (SELECT eb, bin, count(*) AS n FROM q GROUP BY 1, 2),
t AS (SELECT eb, sum(n)::BIGINT AS n FROM c GROUP BY 1),
h AS (SELECT eb, any_value(t.n) AS n, count(*) AS n_unique, -sum(c.n/t.n::DOUBLE*log2(c.n/t.n::DOUBLE)) AS h
      FROM c JOIN t USING (eb) GROUP BY 1),
e AS (SELECT eb, sqrt(avg((resid-bin*2*eb)*(resid-bin*2*eb))) AS rmse, max(value)-min(value) AS vr FROM q GROUP BY 1)
SELECT eb AS abs_bound, n, n_unique, round(h, 6) AS entropy, round(rmse, 6) AS rmse,
       round(20*log10(vr/rmse), 6) AS psnr
FROM h JOIN e USING (eb)""",
)
def rd_mean_predictor(spark: SparkSession, sf: str) -> DataFrame:
    rows = sweep(
        residual_field(spark, sf), "value",
        [Predictor("MEAN", 0, F.col("mu"))], [50.0, 200.0, 1000.0],
    )
    return rows.select(
        "abs_bound", "n", "n_unique",
        *[F.round(c, 6).alias(c) for c in ("entropy", "rmse", "psnr")],
    )


def sensor_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Residual field plus, per sensor count k, the centred reading at the sensor of the
    location's block: a low-rank predictor with piecewise-constant modes, whose k
    sensors are spread evenly."""
    n_levels, n = grid_shape(spark, sf)
    field = residual_field(spark, sf)
    sensors = sorted({-(-b * n // k) for k in SENSOR_COUNTS for b in range(k)})
    readings = field.where(F.col("loc").isin(sensors)).groupBy("level").agg(
        F.map_from_entries(F.collect_list(F.struct("loc", "resid"))).alias("readings")
    )
    # levels x sum(k) readings, whatever the number of locations
    df = field.join(sized_broadcast(readings, n_levels, 24 * len(sensors) + 64), "level", "left")
    for k in SENSOR_COUNTS:
        # smallest loc of the block, in integers
        sensor = F.expr(f"((loc * {k} div {n}) * {n} + {k - 1}) div {k}")
        reading = F.try_element_at("readings", sensor)
        df = df.withColumn(f"sensor_{k}", F.col("mu") + F.coalesce(reading, F.lit(0.0)))
    return df.drop("readings")


def results(spark: SparkSession, sf: str) -> DataFrame:
    """The sweep every analytics query reads: three Lorenzo baselines, the mean model
    and the sensor model for several k, over eight bounds."""
    shape = grid_shape(spark, sf)
    cells = with_neighbours(sensor_blocks(spark, sf))
    predictors = [
        *[Predictor(f"LORENZO-{d}D", 0, F.lit(0.0), near=code_near(d)) for d in (1, 2, 3)],
        Predictor("MEAN", 0, F.col("mu"), 4 * shape.n_locs, 0),
        *[
            Predictor("SENSOR", k, F.col(f"sensor_{k}"),
                      4 * shape.n_locs + 4 * k, 4 * k * shape.n_levels)
            for k in SENSOR_COUNTS
        ],
    ]
    return sweep(cells, "value", predictors, BOUNDS)


def _lorenzo_sql() -> str:
    def at(dl, dy, dx, a):
        return (f"LEFT JOIN g {a} ON {a}.level = p.level + {dl} AND {a}.y = p.y + {dy} "
                f"AND {a}.x = p.x + {dx}\n")

    joins = "".join([
        at(0, 0, -1, "w"), at(0, -1, 0, "n"), at(0, -1, -1, "nw"), at(-1, 0, 0, "u"),
        at(-1, 0, -1, "uw"), at(-1, -1, 0, "un"), at(-1, -1, -1, "unw"),
    ])
    c = lambda a: f"coalesce({a}.value, 0)"
    plane = f"({c('w')} + {c('n')} - {c('nw')})"
    at_columns = ", ".join(f"{c(a)} AS at_{a}" for a in CORNERS)
    return f"""lz AS (SELECT p.*, {at_columns}, {c('u')} AS lorenzo_1d, {plane} AS lorenzo_2d,
  ({plane} + {c('u')}) - ({c('uw')} + {c('un')}) + {c('unw')} AS lorenzo_3d
FROM p {joins})"""


LORENZO_SQL = _lorenzo_sql()


def lorenzo_code_sql(dims: int, ab: str) -> str:
    """Signed sum of the neighbours' quantised values."""
    terms = [f"{'+' if sign > 0 else '-'} round_even(at_{a}/(2*{ab}), 0)::BIGINT" for a, sign in SIGNS[dims].items()]
    return "(0 " + " ".join(terms) + ")"


_NO_NEAR = ", ".join(f"0.0::DOUBLE AS at_{a}" for a in CORNERS)
_NEAR = ", ".join(f"at_{a}" for a in CORNERS)

# ``r``: the result table; opens with WITH and can be continued by ", ..." or SELECT.
RESULTS_SQL = (
    more("g", "p", "sh") + LORENZO_SQL + """,
ks(k) AS (VALUES (1), (2), (4), (8)),
sr AS (SELECT p.level, p.loc, k.k, p.value,
         p.mu + coalesce(q.resid, 0) AS pred
       FROM p CROSS JOIN ks k CROSS JOIN sh
       LEFT JOIN p q ON q.level = p.level
        AND q.loc = ((p.loc*k.k // sh.n)*sh.n + k.k - 1) // k.k),
preds AS (
  SELECT 'LORENZO-1D' AS method, 0 AS k, value AS v, 0.0::DOUBLE AS pred, 1 AS dims, """ + _NEAR + """ FROM lz
  UNION ALL SELECT 'LORENZO-2D', 0, value, 0.0::DOUBLE, 2, """ + _NEAR + """ FROM lz
  UNION ALL SELECT 'LORENZO-3D', 0, value, 0.0::DOUBLE, 3, """ + _NEAR + """ FROM lz
  UNION ALL SELECT 'MEAN', 0, value, mu, 0, """ + _NO_NEAR + """ FROM lz
  UNION ALL SELECT 'SENSOR', k, value, pred, 0, """ + _NO_NEAR + """ FROM sr),
bounds(ab) AS (VALUES (25.0::DOUBLE),(50.0),(100.0),(200.0),(400.0),(800.0),(1600.0),(3200.0)),
qq AS (SELECT method, k::BIGINT AS k, ab, v, pred, round_even((v-pred)/(2*ab),0)::BIGINT AS q,
        CASE dims WHEN 1 THEN """ + lorenzo_code_sql(1, "ab") + " WHEN 2 THEN " + lorenzo_code_sql(2, "ab")
        + " WHEN 3 THEN " + lorenzo_code_sql(3, "ab") + """ ELSE 0 END AS near FROM preds, bounds),
q2 AS (SELECT *, q - near AS bin, pred + q*2*ab AS rec FROM qq),
cc AS (SELECT method, k, ab, bin, count(*) AS c FROM q2 GROUP BY ALL),
hh AS (SELECT method, k, ab, count(*) AS n_unique, log2(sum(c)) - sum(c*log2(c))/sum(c) AS entropy FROM cc GROUP BY ALL),
mm AS (SELECT method, k, ab, count(*) AS n, sqrt(avg((v-rec)*(v-rec))) AS rmse, max(v)-min(v) AS vr,
        avg(v) AS mv, avg(rec) AS mr, var_pop(v) AS vv, var_pop(rec) AS vre, covar_pop(v, rec) AS cov FROM q2 GROUP BY ALL),
r0 AS (SELECT method, k, ab AS abs_bound, mm.n, n_unique, entropy, rmse, 20*log10(vr/rmse) AS psnr,
        ((2*mv*mr + (0.01*vr)**2) * (2*cov + (0.03*vr)**2)) /
        ((mv*mv + mr*mr + (0.01*vr)**2) * (vv + vre + (0.03*vr)**2)) AS ssim,
        ceil(round(mm.n*entropy/8, 6)) + 64 AS resid_b,
        CASE WHEN method = 'MEAN' THEN 4*sh.n WHEN method = 'SENSOR' THEN 4*sh.n + 4*k ELSE 0 END AS model_b,
        CASE WHEN method = 'SENSOR' THEN 4*k*sh.nl ELSE 0 END AS sens_b
       FROM mm JOIN hh USING (method, k, ab) CROSS JOIN sh),
r AS (SELECT method, k, abs_bound, n, n_unique, entropy, rmse, psnr, ssim,
        n*4/(resid_b+model_b+sens_b) AS cr, n*4/(resid_b+sens_b) AS cr_no_model,
        (resid_b+model_b+sens_b)*8/n AS bpv,
        resid_b/1e6 AS resid_mb, model_b/1e6 AS model_mb, sens_b/1e6 AS sv_mb FROM r0)"""
)


def stored_results(spark: SparkSession, sf: str) -> DataFrame:
    """The result table written once, for analytics that read it several times."""
    return cut_lineage(results(spark, sf))


@query(
    "rd_sweep",
    RESULTS_SQL + """
SELECT method, k, abs_bound, n, n_unique, round(entropy,6) AS entropy, round(rmse,6) AS rmse,
 round(psnr,6) AS psnr, round(ssim,6) AS ssim, round(cr,6) AS cr, round(cr_no_model,6) AS cr_no_model, round(bpv,6) AS bpv,
 round(resid_mb,6) AS resid_mb, round(model_mb,6) AS model_mb, round(sv_mb,6) AS sv_mb FROM r""",
)
def rd_sweep(spark: SparkSession, sf: str) -> DataFrame:
    r = results(spark, sf)
    keep = ("method", "k", "abs_bound", "n", "n_unique")
    return r.select(*keep, *[F.round(c, 6).alias(c) for c in r.columns if c not in keep])
