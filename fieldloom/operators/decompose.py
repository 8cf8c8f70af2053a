"""Low-rank bases and Gaussian-process fits.

Dense algebra is confined to matrices whose side is the number of levels, modes or
sampled points; anything as long as the field stays a distributed pass.
"""

from __future__ import annotations

from typing import Callable, NamedTuple, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.sources.profiles import block, collect_matrix, list_column, map_blocks, sum_blocks

MAX_SIDE = 5000


class Basis(NamedTuple):
    """Singular values, level modes (levels x k) of the centred snapshot matrix."""

    s: np.ndarray
    v: np.ndarray


def gram(profiles: DataFrame, n_levels: int) -> DataFrame:
    """Level x level Gram matrix of the profile rows: ``i, j, v``."""
    if n_levels > MAX_SIDE:
        raise ValueError("too many levels for a Gram matrix; use randomised_basis")
    return sum_blocks(profiles, ["vec"], (n_levels, n_levels), lambda b: (lambda m: m.T @ m)(block(b, "vec")))


def svd_basis(profiles: DataFrame, n_levels: int, k: int | None = None) -> Basis:
    """Thin SVD through the Gram matrix of the short side."""
    lam, v = np.linalg.eigh(collect_matrix(gram(profiles, n_levels), (n_levels, n_levels)))
    order = np.argsort(lam)[::-1]
    s = np.sqrt(np.maximum(lam[order], 0.0))
    keep = k or n_levels
    return Basis(s[:keep], v[:, order[:keep]])


def spatial_modes(profiles: DataFrame, basis: Basis, k: int, key: str = "loc") -> DataFrame:
    """Left singular rows ``id, x`` (k per location): a narrow projection."""
    turn = basis.v[:, :k] / np.maximum(basis.s[:k], 1e-300)
    return map_blocks(
        profiles.withColumnRenamed(key, "id"), ["id", "vec"], "id bigint, x array<double>",
        lambda b: [b.column("id"), list_column(block(b, "vec") @ turn)],
    )


def energy_rank(spectrum: DataFrame, tol: float, cap: int) -> DataFrame:
    """rank, s, proj_err, chosen: smallest k with sqrt(1 - captured energy) <= tol, else
    all, then capped.  The spectrum has one row per mode."""
    run = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(F.col("s") * F.col("s")).over(Window.partitionBy())
    err = F.sqrt(F.greatest(F.lit(1.0) - F.sum(F.col("s") * F.col("s")).over(run) / total, F.lit(0.0)))
    out = spectrum.select("rank", "s", err.alias("proj_err"), total.alias("total"))
    whole = Window.partitionBy()
    first = F.min(F.when(F.round("proj_err", 9) <= tol, F.col("rank"))).over(whole)
    k = F.least(F.coalesce(first, F.max("rank").over(whole)), F.lit(cap))
    return out.withColumn("chosen", k)


def choose_rank(s: np.ndarray, tol: float, cap: int) -> int:
    """Driver form of :func:`energy_rank` for a spectrum already at hand."""
    left = np.sqrt(np.maximum(1.0 - np.cumsum(s * s) / (s * s).sum(), 0.0))
    hit = np.flatnonzero(left <= tol)
    return min(int(hit[0]) + 1 if len(hit) else len(s), cap)


def relative_tolerance(abs_tol: float, n_cells: int, frobenius: float, sd_rms: float) -> float:
    """Relative truncation level that yields an absolute RMSE target."""
    return float(np.clip(abs_tol * np.sqrt(n_cells) / (frobenius * sd_rms), 1e-14, 1.0))


def randomised_basis(profiles: DataFrame, n_levels: int, k: int, oversample: int = 10, power: int = 1, seed: int = 42) -> Basis:
    """Basis from a random range sketch with subspace iterations.

    Only (levels x sketch) and (sketch x sketch) sums leave the executors, so it also
    serves when there are too many levels for a Gram matrix.
    """
    width = min(k + oversample, n_levels)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_levels, width)))[0]
    for _ in range(power + 1):
        # A^T (A q): one pass, a levels x sketch result
        z = collect_matrix(
            sum_blocks(profiles, ["vec"], (n_levels, width), lambda b, q=q: (lambda m: m.T @ (m @ q))(block(b, "vec"))),
            (n_levels, width),
        )
        q = np.linalg.qr(z)[0]
    small = collect_matrix(
        sum_blocks(profiles, ["vec"], (width, width), lambda b: (lambda y: y.T @ y)(block(b, "vec") @ q)), (width, width)
    )
    lam, w = np.linalg.eigh(small)
    top = np.argsort(lam)[::-1][:k]
    return Basis(np.sqrt(np.maximum(lam[top], 0.0)), q @ w[:, top])


def cross_field(z: DataFrame, fields: Sequence[str], jitter: float = 1e-6, factor: float = 1.0) -> DataFrame:
    """Symmetric cross-field covariance of standardised fields: i, j, b_ij, corr.

    One aggregate of all products; ``factor`` scales the estimate (0.5 for the halved variant).
    """
    names = [f"z_{f}" for f in fields]
    d = len(names)
    row = z.agg(*[
        (F.avg(F.col(names[i]) * F.col(names[j])) * factor + (jitter if i == j else 0.0)).alias(f"b_{i}_{j}")
        for i in range(d) for j in range(i, d)
    ])
    entry = lambda i, j: F.col(f"b_{min(i, j)}_{max(i, j)}")
    cells = [
        F.struct(
            F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j"), entry(i, j).alias("b_ij"),
            (entry(i, j) / F.sqrt(entry(i, i) * entry(j, j))).alias("corr"),
        )
        for i in range(d) for j in range(d)
    ]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


# --- Gaussian-process likelihoods --------------------------------------------------------

def gp_nll(cov: np.ndarray, y: np.ndarray) -> float:
    """Negative log marginal likelihood; 1e10 when the covariance is not definite.
    Several right-hand sides share one factorisation and are averaged."""
    y = y.reshape(len(cov), -1)
    try:
        low = np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        return 1e10
    a = np.linalg.solve(low, y)
    n = len(cov)
    quad = (a * a).sum() / y.shape[1]
    return float(0.5 * (quad + 2.0 * np.log(np.diag(low)).sum() + n * np.log(2 * np.pi)))


def lmc_nll(lam_b: np.ndarray, q_b: np.ndarray, cov: np.ndarray, y: np.ndarray, noise: float) -> float:
    """Coregionalised likelihood on the product of both eigenbases, averaged over the
    leading axis of ``y`` (snapshots x points x fields)."""
    lam, q = np.linalg.eigh(cov)
    white = q.T @ y @ q_b
    d = np.maximum(lam, 0)[:, None] * np.maximum(lam_b, 0)[None, :] + noise
    quad = (white**2 / d).sum() / len(white)
    return float(0.5 * (quad + np.log(d).sum() + d.size * np.log(2 * np.pi)))


def fit_by_zoom(
    spark: SparkSession, objective: Callable[[np.ndarray], float], bounds: Sequence[tuple[float, float]],
    per_axis: int = 5, rounds: int = 4,
) -> tuple[np.ndarray, float, float]:
    """Minimise over a box in log parameters: (best, value, value at the box centre).

    Each round evaluates a grid as one Spark job, a likelihood per row, then zooms to the
    cells around the winner.  The data inside ``objective`` is a bounded sample.
    """
    lo, hi = np.array([b[0] for b in bounds], float), np.array([b[1] for b in bounds], float)
    start = objective((lo + hi) / 2)
    best, best_v = (lo + hi) / 2, start
    names = [f"p{i}" for i in range(len(lo))]
    a, z = lo.copy(), hi.copy()

    def evaluate(parts):
        for pdf in parts:
            yield pdf.assign(nll=[objective(r) for r in pdf[names].to_numpy()])

    schema = ", ".join(f"{n} double" for n in names)
    for _ in range(rounds):
        axes = [np.linspace(u, v, per_axis) for u, v in zip(a, z)]
        mesh = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, len(lo))
        frame = spark.createDataFrame(pd.DataFrame(mesh, columns=names), schema)
        got = frame.repartition(min(len(mesh), spark.sparkContext.defaultParallelism)).mapInPandas(
            evaluate, schema + ", nll double"
        ).orderBy("nll", *names).first()
        if got["nll"] < best_v:
            best, best_v = np.array([got[n] for n in names]), float(got["nll"])
        width = (z - a) / (per_axis - 1)
        a, z = np.maximum(best - width, lo), np.minimum(best + width, hi)
    return best, best_v, start
