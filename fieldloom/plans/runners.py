"""Method runners: fit, select, predict once per k, sweep the bounds, score."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import kernels as kn
from fieldloom.operators import codecs as cd
from fieldloom.operators import decompose as dc
from fieldloom.operators import predict as pr
from fieldloom.operators.predict import check_model
from fieldloom.operators import selection as sl
from fieldloom.operators.lorenzo import code_near, with_neighbours
from fieldloom.operators.metrics import quality
from fieldloom.operators.ratedist import Predictor, sweep
from fieldloom.operators.sizing import compress_bytes, lossless_bytes
from fieldloom.operators.slabselect import SlabScore
from fieldloom.plans.common import r6
from fieldloom.plans.fitting import field_profiles, location_points, stored_profiles
from fieldloom.plans.prediction import NOISE, coregional
from fieldloom.plans.prediction import _kronecker as kronecker
from fieldloom.plans.ratedist import RESULTS_SQL, results
from fieldloom.plans.registry import more, query
from fieldloom.session import cut_lineage
from fieldloom.sources.grid import FIELDS, NX, grid_shape, residual_field
from fieldloom.sources.profiles import block, list_column, map_blocks, scalar

BOUNDS = [100.0, 400.0, 1600.0, 6400.0]


def ks(n: int, wanted=(4, 12)) -> list[int]:
    """Distinct ranks after the cap."""
    return sorted({min(k, max(1, n // 2)) for k in wanted})


def compressed_size(df: DataFrame, key: str, column: str, dtype: str) -> float:
    """Losslessly compressed bytes of an array column, in chunks by key: the same however the
    rows are spread over tasks."""
    flat = df.select((F.col(key) * F.size(column)).alias("k0"), F.posexplode(column).alias("i", "v"))
    size = lossless_bytes(flat.select((F.col("k0") + F.col("i")).alias("at"), "v"), "at", "v", dtype)
    return float(size.first()[0] or 0)


def compressed_scalar(df: DataFrame, column: str) -> float:
    return float(lossless_bytes(df.select("loc", F.col(column).cast("double").alias("v")), "loc", "v", "float32").first()[0] or 0)


def _cells(df: DataFrame, names: list[str]) -> DataFrame:
    """level, loc, y, x, resid and one column per prediction array, absent cells left out."""
    seen = ["seen"] if "seen" in df.columns else []
    z = df.select("loc", F.posexplode(F.arrays_zip("vec", *seen, *names)).alias("level", "c"))
    return z.where("c.seen" if seen else F.lit(True)).select(
        F.col("level").cast("bigint").alias("level"), "loc", F.expr(f"loc div {NX}").alias("y"), (F.col("loc") % NX).alias("x"),
        F.col("c.vec").alias("resid"), *[F.col(f"c.{n}").alias(n) for n in names],
    )


def _present(cells: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """Cells that the field has: predictions for absent ones are not scored."""
    return cells.join(residual_field(spark, sf).select("level", "loc"), ["level", "loc"], "left_semi")


def _all_ranks(prof: DataFrame, columns: list[str], parts: dict) -> DataFrame:
    """loc, vec and one prediction array per rank, all in one pass: ``parts[name](batch)``."""
    schema = "loc bigint, vec array<double>, seen array<boolean>, " + ", ".join(f"{n} array<double>" for n in parts)
    return cut_lineage(map_blocks(
        prof, ["loc", "vec", "seen", *columns], schema,
        lambda b: [b.column("loc"), b.column("vec"), b.column("seen"), *(list_column(f(b)) for f in parts.values())],
    ))


class _Rotate:
    """Profile rows times a levels x levels matrix: projection, solve and rebuild in one."""

    def __init__(self, matrix: np.ndarray):
        check_model(matrix)
        self.matrix = matrix

    def __call__(self, b) -> np.ndarray:
        return block(b, "vec") @ self.matrix


class _Krige:
    def __init__(self, kernel, sensors: np.ndarray, alpha: np.ndarray):
        check_model(sensors, alpha)
        self.kernel, self.sensors, self.alpha = kernel, sensors, alpha

    def __call__(self, b) -> np.ndarray:
        x = np.column_stack([scalar(b, "y"), scalar(b, "x")]).astype(float)
        return self.kernel(x, self.sensors) @ self.alpha


def _rows(df: DataFrame) -> DataFrame:
    return df.select("method", "k", "abs_bound", "n", "cr", "cr_no_model", "psnr", "ssim", "rmse", "entropy", "resid_mb", "model_mb", "sv_mb")


def deim_predictions(spark: SparkSession, sf: str, prof: DataFrame):
    """Largest k once; smaller ranks reuse its basis.  (merged rows, cost per k)."""
    nl, n = grid_shape(spark, sf)
    ranks = ks(n)
    basis = dc.svd_basis(prof, nl, max(ranks))
    frames, cost = {}, {}
    mean = compressed_scalar(prof, "mu")
    for k in ranks:
        modes = dc.spatial_modes(prof, basis, k)
        picks = sl.qdeim(modes, k)
        y = pr.readings_at(prof, picks.ids)
        turn = basis.v[:, :k] / np.maximum(basis.s[:k], 1e-300)
        frames[f"k{k}"] = _Rotate(turn @ np.linalg.lstsq(picks.rows, y, rcond=None)[0])
        model = compressed_size(modes, "id", "x", "float16") + mean + compress_bytes(picks.ids.astype("i4").tobytes())
        cost[k] = (model, compress_bytes(y.astype("f2").tobytes()))
    return _all_ranks(prof, [], frames), cost


def kriging_predictions(spark: SparkSession, sf: str, prof: DataFrame, ls: float = 3.0):
    """Sensors selected once for the largest k; prefixes serve the smaller ones."""
    _, n = grid_shape(spark, sf)
    kernel = sl.RadialKernel(kn.matern, nu=1.5, ls=ls)
    ranks = ks(n)
    picks = sl.gks(location_points(prof), kernel, max(ranks), 20, "random", 42)
    y = pr.readings_at(prof, picks.ids)
    mean = compressed_scalar(prof, "mu") + compressed_scalar(prof, "sd")
    frames, cost = {}, {}
    for k in ranks:
        s = picks.rows[:k]
        frames[f"k{k}"] = _Krige(kernel, s, pr.solve_spd(kernel(s, s) + NOISE * np.eye(k), y[:k]))
        cost[k] = (mean + compress_bytes(picks.ids[:k].astype("i4").tobytes()) + 24, compress_bytes(y[:k].astype("f2").tobytes()))
    return _all_ranks(prof, ["y", "x"], frames), cost


def _plain(merged, cost, method: str) -> DataFrame:
    names = [f"k{k}" for k in cost]
    preds = [Predictor(method, k, F.col(f"k{k}"), m, s) for k, (m, s) in cost.items()]
    return _rows(sweep(_cells(merged, names), "resid", preds, BOUNDS))


def _hybrid(merged, cost, method: str) -> DataFrame:
    """Prediction residual coded by the planar Lorenzo codec."""
    out = None
    for k, (m, s) in cost.items():
        cells = _cells(merged, [f"k{k}"]).withColumn("d", F.col("resid") - F.col(f"k{k}"))
        coded = with_neighbours(cells, "d")
        p = Predictor(method, k, F.col(f"k{k}"), m, s, code_near(2))
        r = sweep(coded, "resid", [p], BOUNDS)
        out = r if out is None else out.unionAll(r)
    return _rows(out)


@query("e01_volume_basis_sweep")
def e01_volume_basis_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Volume modes, square solve; the model holds both factors."""
    nl, n = grid_shape(spark, sf)
    prof = stored_profiles(spark, sf)
    out = None
    for k in ks(n):
        modes, picks, coef = cd.fit_volume(prof, nl, k)
        p = Predictor("VOLUME-BASIS", k, F.col("pred"), 2.0 * k * (nl + n) + 4.0 * n, 6.0 * len(picks.ids))
        r = sweep(_present(cd.decode_volume(modes, coef), spark, sf), "resid", [p], BOUNDS)
        out = r if out is None else out.unionAll(r)
    return _rows(out)


@query("e02_coregional_sweep")
def e02_coregional_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Two correlated fields; metrics of the first, the second field in its own rows."""
    nl, n = grid_shape(spark, sf)
    fields = list(FIELDS[:2])
    k = max(ks(n))
    stack, picks, out = coregional(spark, sf, k, fields)
    joined = cut_lineage(stack.join(out, "loc"))
    rows = None
    for f in fields:
        cells = joined.select("loc", f"sd_{f}", F.posexplode(F.arrays_zip(f"vec_{f}", f"pred_{f}", "seen")).alias("level", "c"))
        sd = F.col(f"sd_{f}")
        cells = cells.where("c.seen").select((F.col(f"c.vec_{f}") * sd).alias("t"), (F.col(f"c.pred_{f}") * sd).alias("p"))
        scale = 1.0 if f == "value" else 1e-3
        p = Predictor(f"COREGIONAL/{f}", k, F.col("p"), 16.0 * n + 4.0 * k, 2.0 * k * nl)
        r = sweep(cells, "t", [p], [b * scale for b in BOUNDS])
        rows = r if rows is None else rows.unionAll(r)
    return _rows(rows)


@query("e03_deim_sweep")
def e03_deim_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(*deim_predictions(spark, sf, stored_profiles(spark, sf)), "DEIM-2D")


@query("e04_kriging_sweep")
def e04_kriging_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(*kriging_predictions(spark, sf, stored_profiles(spark, sf)), "KRIGING-2D")


def _active(spark: SparkSession, sf: str, prof: DataFrame) -> DataFrame:
    return prof.select("loc", (F.col("n_obs_levels") == grid_shape(spark, sf).n_levels).alias("is_active"))


@query("e05_deim_hybrid_masked")
def e05_deim_hybrid_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Basis prediction plus coded residual over active locations only."""
    prof = stored_profiles(spark, sf)
    mask = _active(spark, sf, prof)
    live = cut_lineage(prof.join(mask.where("is_active").select("loc"), "loc", "left_semi"))
    return _hybrid(*deim_predictions(spark, sf, live), "DEIM-2D+LORENZO/masked")


@query("e06_kriging_hybrid_masked")
def e06_kriging_hybrid_masked(spark: SparkSession, sf: str) -> DataFrame:
    prof = stored_profiles(spark, sf)
    mask = _active(spark, sf, prof)
    live = cut_lineage(prof.join(mask.where("is_active").select("loc"), "loc", "left_semi"))
    return _hybrid(*kriging_predictions(spark, sf, live), "KRIGING-2D+LORENZO/masked")


@query("e07_deim_hybrid")
def e07_deim_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(*deim_predictions(spark, sf, stored_profiles(spark, sf)), "DEIM-2D+LORENZO")


@query("e08_kriging_hybrid")
def e08_kriging_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(*kriging_predictions(spark, sf, stored_profiles(spark, sf), 2.0), "KRIGING-2D+LORENZO")


@query("e09_kronecker_hybrid")
def e09_kronecker_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Separable 3-D process; the residual volume is coded by the 3-D Lorenzo codec."""
    n = grid_shape(spark, sf).n_locs
    k_z, k_xy = 8, max(ks(n))
    out, levels, picks = kronecker(spark, sf, k_z, k_xy)
    cells = _present(_cells(out, ["pred"]), spark, sf).withColumn("d", F.col("resid") - F.col("pred"))
    coded = with_neighbours(cells, "d")
    k = len(levels) * len(picks.ids)
    p = Predictor("KRIGING-3D+LORENZO", k, F.col("pred"), 4.0 * n, 2.0 * k + 4.0 * (len(levels) + len(picks.ids)), code_near(3))
    return _rows(sweep(coded, "resid", [p], BOUNDS))


@query("e10_coregional_reconstruction")
def e10_coregional_reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    """Three fields from shared sensors, error metrics only."""
    k = max(ks(grid_shape(spark, sf).n_locs))
    stack, _, out = coregional(spark, sf, k, list(FIELDS))
    joined = cut_lineage(stack.join(out, "loc"))
    rows = None
    for f in FIELDS:
        c = joined.select(f"sd_{f}", F.posexplode(F.arrays_zip(f"vec_{f}", f"pred_{f}", "seen")).alias("level", "c")).where("c.seen")
        sd = F.col(f"sd_{f}")
        q = quality(c.select((F.col(f"c.vec_{f}") * sd).alias("t"), (F.col(f"c.pred_{f}") * sd).alias("p")), "t", "p")
        q = q.select(F.lit(f).alias("field"), "n", "rmse", "mae", "max_err", "range", "psnr")
        rows = q if rows is None else rows.unionAll(q)
    return rows


# --- residual-coding variants ------------------------------------------------------------

@query("x1_sensors_only", RESULTS_SQL + """, o AS (SELECT k.k::BIGINT AS k, count(*) AS n, sqrt(avg((value-pred)**2)) AS rmse, max(value)-min(value) AS vr FROM sr k GROUP BY k.k)
SELECT o.k, o.n, round(o.n*4/(4.0::DOUBLE*sh.n + 4*o.k + 4*o.k*sh.nl), 6) AS cr, round(20*log10(vr/o.rmse), 6) AS psnr FROM o, sh""")
def x1_sensors_only(spark: SparkSession, sf: str) -> DataFrame:
    """No residual stream: model and readings only."""
    from fieldloom.plans.ratedist import SENSOR_COUNTS, sensor_blocks

    shape = grid_shape(spark, sf)
    cells = sensor_blocks(spark, sf).select("value", F.explode(F.array(*[
        F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"sensor_{k}").alias("pred")) for k in SENSOR_COUNTS
    ])).alias("s")).select("value", "s.*")
    q = quality(cells, "value", "pred", ["k"])
    size = F.col("k") * (4 + 4 * shape.n_levels) + 4.0 * shape.n_locs
    return q.select("k", "n", F.round(F.col("n") * 4 / size, 6).alias("cr"), F.round("psnr", 6).alias("psnr"))


@query("x2_rms_residual", more("g", "p", "sh") + """e AS (SELECT sqrt(avg(resid**2)) AS eb FROM p), q AS (SELECT value, resid, eb, round_even(resid/(2*eb), 0)::BIGINT AS bin FROM p, e),
c AS (SELECT bin, count(*) AS c FROM q GROUP BY bin), h AS (SELECT sum(c) AS n, count(*) AS u, log2(sum(c)) - sum(c*log2(c))/sum(c) AS h FROM c)
SELECT round(any_value(eb), 6) AS eb, any_value(h.n)::BIGINT AS n, any_value(u) AS n_unique, round(any_value(h), 6) AS entropy, round(any_value(h.n)*4/(ceil(round(any_value(h.n*h)/8, 6)) + 64 + 4*any_value(sh.n)), 6) AS cr,
 round(20*log10((max(value)-min(value))/sqrt(avg((resid-bin*2*eb)**2))), 6) AS psnr FROM q, h, sh""")
def x2_rms_residual(spark: SparkSession, sf: str) -> DataFrame:
    """Uniform residual bins of twice the RMS error, no outliers."""
    f = residual_field(spark, sf)
    eb = f.select(F.sqrt(F.avg(F.col("resid") * F.col("resid")))).first()[0]
    p = Predictor("MEAN/rms", 0, F.col("mu"), 4 * grid_shape(spark, sf).n_locs)
    r = sweep(f, "value", [p], [eb])
    return r.select(F.round("abs_bound", 6).alias("eb"), "n", "n_unique", *r6("entropy", "cr", "psnr"))


@query("x3_coefficients")
def x3_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """Mode coefficients quantised with bin 2 rms sqrt(n/k), then the field rebuilt."""
    nl, n = grid_shape(spark, sf)
    prof = stored_profiles(spark, sf)
    out = None
    for k in ks(n):
        basis = dc.svd_basis(prof, nl, k)
        coef = basis.v * basis.s
        left = max(float(prof.select(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v).alias("e")).agg(F.sum("e")).first()[0]) - (basis.s**2).sum(), 0.0)
        step = 2.0 * np.sqrt(left / (nl * n)) * np.sqrt(n / k)
        bins = np.rint(coef / step)
        _, c = np.unique(bins, return_counts=True)
        share = c / c.sum()
        bits = float(-(share * np.log2(share)).sum()) * bins.size
        rebuilt = pr.deim_reconstruct_basis(prof, basis.v, basis.s, np.eye(k), (bins * step).T)
        q = quality(pr.cells_of(rebuilt), "resid", "pred").select(
            F.lit(k).cast("bigint").alias("k"), F.lit(float(step)).alias("bin_width"), "n", "rmse", "psnr",
            (F.lit(4.0 * nl * n) / (bits / 8 + 2.0 * n * k + 4.0 * n)).alias("cr"),
        )
        out = q if out is None else out.unionAll(q)
    return out


@query("k01_result_rows", RESULTS_SQL + """ SELECT method, k::VARCHAR AS k, abs_bound::BIGINT::VARCHAR AS abs_bound, n::VARCHAR AS n_total FROM r""")
def k01_result_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows as a sink writes them: fixed fields as text, the rest ignored."""
    return results(spark, sf).select(
        "method", F.col("k").cast("string").alias("k"),
        F.col("abs_bound").cast("bigint").cast("string").alias("abs_bound"), F.col("n").cast("string").alias("n_total"),
    )


@query("s15_random_field")
def s15_random_field(spark: SparkSession, sf: str) -> DataFrame:
    """Gaussian random field over the locations with drift: a factor grown until no location has
    variance left (``missing_var`` tells), times normals."""
    points = cut_lineage(location_points(field_profiles(spark, sf)))
    scorer = SlabScore(sl.RadialKernel(kn.rbf, ls=3.0))
    picks = sl.random_select(points, scorer, grid_shape(spark, sf).n_locs, 0)
    z = np.random.default_rng(0).standard_normal(len(picks.ids))

    def drawn(b):
        x = block(b, "x")
        draw, left = scorer.draw(x, z)
        return [b.column("id"), draw + 0.15 * x[:, 1], left]

    return map_blocks(scorer.deal(points), ["id", "x"], "loc bigint, draw double, missing_var double", drawn)
