"""Field reconstruction from sensors.

A model is a small closure (sensor coordinates, weights); prediction is a narrow pass
over profile rows or cells.  Models are bounded by the sensor budget and checked.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.selection import distance_matrix
from fieldloom.sources.profiles import block, list_column, map_blocks, scalar

MAX_MODEL_BYTES = 256 << 20
MAX_SENSORS = 8192  # half a gigabyte of covariance
BRUTE_FORCE = 2048
SHARED = 1 << 21  # values of a batch of rows that may share their systems
FLAT = 1e-10  # deviation under which a location counts as constant


def check_model(*arrays: np.ndarray) -> None:
    """Refuse to ship a model that is not small."""
    size = sum(a.nbytes for a in arrays)
    if size > MAX_MODEL_BYTES:
        raise ValueError(f"model of {size} bytes exceeds the broadcast budget")


def solve_spd(cov: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cholesky solve; a failing factorisation is retried with 1e-4 on the diagonal."""
    if len(cov) > MAX_SENSORS:
        raise ValueError("too many sensors for a dense solve; use the local predictor")
    for ridge in (0.0, 1e-4, 1e-2):
        try:
            low = np.linalg.cholesky(cov + ridge * np.eye(len(cov)))
            return np.linalg.solve(low.T, np.linalg.solve(low, y))
        except np.linalg.LinAlgError:
            continue
    return np.linalg.pinv(cov) @ y


def readings_at(profiles: DataFrame, ids: np.ndarray, key: str = "loc", value: str = "vec") -> np.ndarray:
    """Values at the sensors in sensor order (sensors x levels)."""
    got = profiles.where(F.col(key).isin([int(i) for i in ids])).select(key, value).toPandas().set_index(key)[value]
    return np.stack([got[i] for i in ids])


def _coords(b: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([scalar(b, "y"), scalar(b, "x")]).astype(float)


def deim_reconstruct(profiles: DataFrame, modes: DataFrame, sensor_rows: np.ndarray, readings: np.ndarray) -> DataFrame:
    """loc, vec, pred: ``Phi A^-1 y`` for all levels at once (least squares when there are
    more sensors than modes).  ``modes(id, x)`` comes from the same rows as ``profiles``."""
    coef = np.linalg.lstsq(sensor_rows, readings, rcond=None)[0]
    check_model(coef)
    rows = profiles.select("loc", "vec").join(modes.withColumnRenamed("id", "loc"), "loc")
    return map_blocks(
        rows, ["loc", "vec", "x"], "loc bigint, vec array<double>, pred array<double>",
        lambda b: [b.column("loc"), b.column("vec"), list_column(block(b, "x") @ coef)],
    )


def deim_reconstruct_basis(profiles: DataFrame, v: np.ndarray, s: np.ndarray, sensor_rows: np.ndarray, readings: np.ndarray) -> DataFrame:
    """As :func:`deim_reconstruct`, with mode rows formed from the profile in the same pass."""
    turn = v / np.maximum(s, 1e-300)
    coef = np.linalg.lstsq(sensor_rows, readings, rcond=None)[0]
    check_model(turn, coef)
    return map_blocks(
        profiles, ["loc", "vec"], "loc bigint, vec array<double>, pred array<double>",
        lambda b: [b.column("loc"), b.column("vec"), list_column((block(b, "vec") @ turn) @ coef)],
    )


def kriging(
    profiles: DataFrame, sensors: np.ndarray, readings: np.ndarray, kernel: Callable, noise: float,
    trend: Callable[[np.ndarray], np.ndarray] | None = None, var_floor: float = 0.0,
) -> DataFrame:
    """loc, vec, pred, var: Gaussian-process mean for every level and posterior variance.

    With ``trend`` (a design-matrix function) the mean is universal Kriging by generalised
    least squares and the variance carries the trend correction.
    """
    k_ss = kernel(sensors, sensors) + noise * np.eye(len(sensors))
    inv = solve_spd(k_ss, np.eye(len(sensors)))
    if trend is not None:
        g = trend(sensors)
        gram_inv = np.linalg.pinv(g.T @ inv @ g)
        beta = gram_inv @ (g.T @ inv @ readings)
        alpha = inv @ (readings - g @ beta)
    else:
        g = gram_inv = beta = None
        alpha = inv @ readings
    check_model(alpha, inv)

    def predict(b):
        x = _coords(b)
        k = kernel(x, sensors)
        mean = k @ alpha
        prior = kernel(x[:1], x[:1])[0, 0]
        var = prior - ((k @ inv) * k).sum(1)
        flat = block(b, "vec").std(1) < FLAT  # no variance in training: the mean stands
        if g is not None:
            h = trend(x)
            mean = mean + h @ beta
            u = h - k @ inv @ g
            var = var + ((u @ gram_inv) * u).sum(1)
        mean[flat] = 0.0
        return [b.column("loc"), b.column("vec"), list_column(mean), np.maximum(var, var_floor)]

    return map_blocks(
        profiles, ["loc", "y", "x", "vec"], "loc bigint, vec array<double>, pred array<double>, var double", predict
    )


def nearest(x: np.ndarray, sensors: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and distances of the ``n`` nearest sensors of every row, exactly.

    Many sensors are first cut to the rows' bounding box grown by a radius; sensors outside
    are further than the radius from every row, so the answer stands once the furthest
    neighbour found is within it.  Otherwise the radius doubles.
    """
    n = min(n, len(sensors))
    lo, hi = x.min(0), x.max(0)
    span = np.maximum(np.ptp(sensors, axis=0), 1e-12)
    r = float((np.prod(span) * n / len(sensors)) ** (1.0 / x.shape[1]))
    everything = len(sensors) <= BRUTE_FORCE
    while True:
        near_box = np.arange(len(sensors)) if everything else np.flatnonzero(
            ((sensors >= lo - r) & (sensors <= hi + r)).all(1)
        )
        everything = everything or len(near_box) == len(sensors)
        if len(near_box) >= n:
            d = distance_matrix(x, sensors[near_box])
            pos = np.argpartition(d, n - 1, axis=1)[:, :n]
            dist = np.take_along_axis(d, pos, 1)
            if everything or dist.max() <= r:
                return near_box[pos], dist
        r *= 2.0


def local_solve(
    x: np.ndarray, sensors: np.ndarray, readings: np.ndarray, kernel, noise: float, n_local: int, batch: int = 500
) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of every row from its nearest sensors, as batched small systems.
    Rows are taken in spatial order, so a batch covers a small box."""
    n_local = min(n_local, len(sensors))
    fn, p = kernel.fn, kernel.params
    ridge = (noise + 1e-6) * np.eye(n_local)
    prior = fn(np.zeros(1), m=np, **p)[0]
    mean, var = np.empty(len(x)), np.empty(len(x))
    order = np.lexsort(x.T[::-1])
    for a in range(0, len(x), batch):
        rows = order[a : a + batch]
        near, dist = nearest(x[rows], sensors, n_local)
        s = sensors[near]
        gap = np.sqrt(((s[:, :, None] - s[:, None]) ** 2).sum(-1))
        k = fn(dist, m=np, **p)
        w = np.linalg.solve(fn(gap, m=np, **p) + ridge, k[:, :, None])[:, :, 0]
        mean[rows] = (w * readings[near]).sum(1)
        var[rows] = prior - (w * k).sum(1)
    return mean, np.maximum(var, 0.0)


def local_mean(
    x: np.ndarray, sensors: np.ndarray, readings: np.ndarray, kernel, noise: float, n_local: int
) -> np.ndarray:
    """Mean of :func:`local_solve`: rows that have the same nearest sensors share one solved system."""
    n_local = min(n_local, len(sensors))
    fn, p = kernel.fn, kernel.params
    ridge = (noise + 1e-6) * np.eye(n_local)
    mean = np.empty(len(x))
    order = np.lexsort(x.T[::-1])
    # few sensors are all compared with every row, so that more rows make more that share
    batch = max(500, min(SHARED // len(sensors), SHARED // n_local**2)) if len(sensors) <= BRUTE_FORCE else 500
    for a in range(0, len(x), batch):
        rows = order[a : a + batch]
        near, dist = nearest(x[rows], sensors, n_local)
        by = np.argsort(near, axis=1)
        near, dist = np.take_along_axis(near, by, 1), np.take_along_axis(dist, by, 1)
        if len(sensors) < 63:
            _, first, at = np.unique((1 << near).sum(1), return_index=True, return_inverse=True)
            sets = near[first]
        else:
            sets, at = np.unique(near, axis=0, return_inverse=True)
        s = sensors[sets]
        gap = np.sqrt(((s[:, :, None] - s[:, None]) ** 2).sum(-1))
        alpha = np.linalg.solve(fn(gap, m=np, **p) + ridge, readings[sets][:, :, None])[:, :, 0]
        mean[rows] = (fn(dist, m=np, **p) * alpha[at.ravel()]).sum(1)
    return mean


def local_kriging(
    cells: DataFrame, coords: list[str], value: str, sensors: np.ndarray, readings: np.ndarray,
    kernel: Callable, noise: float, n_local: int,
) -> DataFrame:
    """level, loc, coordinates, value, pred, var: every cell from its nearest sensors."""
    check_model(sensors, readings)
    columns = ["level", "loc", *[c for c in coords if c not in ("level", "loc")], value]

    def predict(b):
        x = np.column_stack([scalar(b, c) for c in coords]).astype(float)
        return [*(b.column(c) for c in columns), *local_solve(x, sensors, readings, kernel, noise, n_local)]

    types = dict(cells.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", pred double, var double"
    return map_blocks(cells, columns, schema, predict)


def kronecker_kriging(
    profiles: DataFrame, n_levels: int, levels: np.ndarray, sensors: np.ndarray, readings: np.ndarray,
    k_z: Callable, k_xy: Callable, var: float, noise: float,
) -> DataFrame:
    """loc, vec, pred: separable vertical x horizontal process, sensors on a full grid of
    ``levels`` x ``sensors`` (readings: levels x sensors).

    Both factors are diagonalised, so the joint solve costs two small eigenproblems.
    """
    z_all, z_s = np.arange(n_levels, dtype=float)[:, None], levels.astype(float)[:, None]
    lz, qz = np.linalg.eigh(k_z(z_s, z_s))
    lx, qx = np.linalg.eigh(k_xy(sensors, sensors))
    white = qz.T @ readings @ qx
    alpha = qz @ (white / (var * np.outer(np.maximum(lz, 0), np.maximum(lx, 0)) + noise)) @ qx.T
    left = var * (k_z(z_all, z_s) @ alpha)
    check_model(left)
    return map_blocks(
        profiles, ["loc", "y", "x", "vec"], "loc bigint, vec array<double>, pred array<double>",
        lambda b: [b.column("loc"), b.column("vec"), list_column(k_xy(_coords(b), sensors) @ left.T)],
    )


def coregional_kriging(
    profiles: DataFrame, fields: list[str], sensors: np.ndarray, readings: np.ndarray,
    b_matrix: np.ndarray, kernel: Callable, noise: float,
) -> DataFrame:
    """loc, pred_<field>, var: linear model of coregionalisation.

    ``readings`` is fields x sensors x levels; the joint system is ``B (x) K + noise I``.
    """
    d, k, n_levels = readings.shape
    cov = np.kron(b_matrix, kernel(sensors, sensors)) + noise * np.eye(d * k)
    alpha = solve_spd(cov, readings.reshape(d * k, n_levels)).reshape(d, k, n_levels)
    mixed = np.einsum("ij,jkl->ikl", b_matrix, alpha)
    check_model(mixed, cov)
    inv = solve_spd(cov, np.eye(d * k))

    def predict(b):
        kx = kernel(_coords(b), sensors)
        cross = np.einsum("ij,mk->mijk", b_matrix, kx).reshape(len(kx), d, d * k)
        prior = np.diag(b_matrix) * kernel(sensors[:1], sensors[:1])[0, 0]
        var = prior[None] - np.einsum("mia,ab,mib->mi", cross, inv, cross)
        return [b.column("loc"), *[list_column(kx @ mixed[i]) for i in range(d)], list_column(np.maximum(var, 0.0))]

    schema = "loc bigint, " + ", ".join(f"pred_{f} array<double>" for f in fields) + ", var array<double>"
    return map_blocks(profiles, ["loc", "y", "x"], schema, predict)


def cells_of(predicted: DataFrame) -> DataFrame:
    """level, loc, resid, pred from profile rows (truth and prediction both centred)."""
    zipped = F.posexplode(F.arrays_zip("vec", "pred"))
    return predicted.select("loc", zipped.alias("level", "c")).select(
        F.col("level").cast("bigint").alias("level"), "loc",
        F.col("c.vec").alias("resid"), F.col("c.pred").alias("pred"),
    )
