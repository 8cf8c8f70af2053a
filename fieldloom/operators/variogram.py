"""Semivariograms over neighbouring blocks of space, and ordinary Kriging in three dimensions.

Pairs within ``max_lag`` lie in one block of that side or in adjoining ones.  Every point goes to its own
block and to the half of the adjoining blocks that come before it, so each pair meets once, in
one task, and a block holds no more cells than its volume.  Axes are scaled separately before any
distance is taken.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.selection import distance_matrix
from fieldloom.sources.profiles import block, map_blocks, scalar

ROWS = 2048
AXES = ("level", "y", "x")


def semivariogram(cells: DataFrame, value: str, max_lag: float, n_lags: int, scales: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """lag, n, distance, gamma: pairs, mean distance and semivariance by bins of equal width up to
    ``max_lag`` (the end of a bin belongs to it)."""
    side, width = float(max_lag), float(max_lag) / n_lags
    at = [F.col(a).cast("double") / s for a, s in zip(AXES, scales)]
    home = [F.floor(c / side).cast("bigint") for c in at]
    ahead = [o for o in product((-1, 0, 1), repeat=3) if o > (0, 0, 0)]
    targets = [F.struct(*[(h - o).alias(f"b{i}") for i, (h, o) in enumerate(zip(home, off))], F.lit(own).alias("own"))
               for off, own in [((0, 0, 0), True), *[(o, False) for o in ahead]]]
    rows = cells.where(F.col(value).isNotNull()).select(F.array(*at).alias("x"), F.col(value).cast("double").alias("v"), F.inline(F.array(*targets)))

    def sums(key: tuple, group: pa.Table) -> pa.Table:
        batch = group.combine_chunks().to_batches()[0]
        own = scalar(batch, "own").astype(bool)
        x, v = block(batch, "x"), scalar(batch, "v")
        axes, reach = np.ascontiguousarray(x.T), side * side * (1 + 1e-9)  # the exact bound is on the root
        mine, n, d_sum, g_sum = np.flatnonzero(own), np.zeros(n_lags, np.int64), np.zeros(n_lags), np.zeros(n_lags)
        for low in range(0, mine.size, ROWS):
            part = mine[low : low + ROWS]
            square = sum((axis[part][:, None] - axis[None]) ** 2 for axis in axes)
            i, j = np.nonzero(square <= reach)
            far = np.sqrt(square[i, j])
            use = (far <= side) & (~own[j] | (j > part[i]))
            i, j, far = i[use], j[use], far[use]
            bin_ = np.clip(np.ceil(far / width).astype(int) - 1, 0, n_lags - 1)
            n += np.bincount(bin_, minlength=n_lags)
            d_sum += np.bincount(bin_, weights=far, minlength=n_lags)
            g_sum += np.bincount(bin_, weights=0.5 * (v[part[i]] - v[j]) ** 2, minlength=n_lags)
        return pa.table({"lag": pa.array(np.arange(n_lags)), "n": pa.array(n), "d": pa.array(d_sum), "g": pa.array(g_sum)})

    parts = rows.groupBy("b0", "b1", "b2").applyInArrow(sums, "lag bigint, n bigint, d double, g double")
    total = parts.groupBy("lag").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("g").alias("g")).where("n > 0")
    return total.select("lag", "n", (F.col("d") / F.col("n")).alias("distance"), (F.col("g") / F.col("n")).alias("gamma"))


@dataclass(frozen=True)
class Spherical:
    """``nugget + sill (1.5 h/reach - 0.5 (h/reach)^3)`` up to the reach, nugget and sill beyond, 0 at 0."""

    reach: float
    sill: float
    nugget: float

    def __call__(self, h: np.ndarray) -> np.ndarray:
        t = np.minimum(h / self.reach, 1.0)
        return np.where(h > 0, self.nugget + self.sill * (1.5 * t - 0.5 * t**3), 0.0)


def fit_spherical(lags: DataFrame, steps: int = 60, rounds: int = 4) -> tuple[Spherical, float]:
    """(variogram, misfit): weighted least squares of the binned semivariances.

    For a given reach nugget and sill are a non-negative linear fit in closed form, so only the reach
    is searched, on a grid that narrows around the best.
    """
    rows = lags.orderBy("lag").toPandas()
    h, g, w = (rows[c].to_numpy(float) for c in ("distance", "gamma", "n"))

    def best(reach: float) -> tuple[float, float, float]:
        t = np.minimum(h / reach, 1.0)
        shape = 1.5 * t - 0.5 * t**3
        options = [(0.0, max(0.0, (w * g * shape).sum() / (w * shape * shape).sum())), (max(0.0, (w * g).sum() / w.sum()), 0.0)]
        m, c = (w * shape).sum() / w.sum(), (w * g).sum() / w.sum()
        spread = (w * (shape - m) ** 2).sum()
        if spread > 0:
            sill = (w * (shape - m) * (g - c)).sum() / spread
            options.append((c - sill * m, sill))
        return min((float((w * (g - a - b * shape) ** 2).sum() / w.sum()), a, b) for a, b in options if a >= 0 and b >= 0)

    low, high = h.min() / 2, 3 * h.max()
    for _ in range(rounds):
        grid = np.geomspace(low, high, steps)
        at = int(np.argmin([best(r)[0] for r in grid]))
        low, high = grid[max(at - 1, 0)], grid[min(at + 1, steps - 1)]
    misfit, nugget, sill = best(grid[at])
    return Spherical(float(grid[at]), sill, nugget), misfit


def kriging_weights(x: np.ndarray, sensors: np.ndarray, variogram: Spherical) -> tuple[np.ndarray, np.ndarray]:
    """(weights, variance) of every row of ``x``: the system bordered by the unbiasedness condition."""
    k = len(sensors)
    system = np.ones((k + 1, k + 1))
    system[:k, :k] = variogram(distance_matrix(sensors, sensors) * (1 - np.eye(k)))
    system[k, k] = 0.0
    right = np.ones((k + 1, len(x)))
    right[:k] = variogram(np.sqrt(((sensors[:, None] - x[None]) ** 2).sum(-1)))
    full = np.linalg.lstsq(system, right, rcond=None)[0] if np.linalg.matrix_rank(system) <= k else np.linalg.solve(system, right)
    return full[:k].T, np.maximum((full * right).sum(0), 0.0)


def ordinary_kriging(cells: DataFrame, value: str, sensors: np.ndarray, readings: np.ndarray, variogram: Spherical,
                     scales: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """level, loc, value, pred, var of every cell from sensors anywhere in the volume (level, y, x)."""
    scale = np.asarray(scales, float)
    at = np.asarray(sensors, float) / scale

    def predict(b: pa.RecordBatch) -> list:
        weights, var = kriging_weights(np.column_stack([scalar(b, a) for a in AXES]).astype(float) / scale, at, variogram)
        return [b.column("level"), b.column("loc"), b.column(value), weights @ readings, var]

    rows = cells.select("level", "loc", "y", "x", F.col(value).cast("double").alias(value))
    return map_blocks(rows, ["level", "loc", "y", "x", value], f"level bigint, loc bigint, {value} double, pred double, var double", predict)
