"""Maximum-likelihood fits of covariances: bounded quasi-Newton, one start a task.

An objective gives the negative log marginal likelihood and its gradient in log parameters from one
factorisation.  The sample behind it is bounded by the caller; every start is a row, so starts
run side by side on the executors and only optima return.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAILED = 1e10  # value where a covariance is not definite

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


class Fit(NamedTuple):
    """Optimum (log parameters and value), the value at the first start, and one row per start."""

    theta: np.ndarray
    value: float
    start: float
    runs: pd.DataFrame


def matern_slope(r: np.ndarray, nu: float, ls: float) -> tuple[np.ndarray, np.ndarray]:
    """Unit-variance Matern covariance and its derivative by the log length scale."""
    if nu == 0.5:
        s = r / ls
        k = np.exp(-s)
        return k, s * k
    s = r * (np.sqrt(2 * nu) / ls)
    e = np.exp(-s)
    if nu == 1.5:
        return (1 + s) * e, s * s * e
    if nu == 2.5:
        return (1 + s + s * s / 3) * e, s * s * (1 + s) * e / 3
    raise ValueError(f"Matern smoothness must be 0.5, 1.5 or 2.5, got {nu}")


def _inverse_lower(low: np.ndarray) -> np.ndarray:
    """Inverse of a lower triangle, by halves."""
    n = len(low)
    if n <= 64:
        return np.tril(np.linalg.inv(low))
    h = n // 2
    out = np.zeros_like(low)
    out[:h, :h], out[h:, h:] = _inverse_lower(low[:h, :h]), _inverse_lower(low[h:, h:])
    out[h:, :h] = -out[h:, h:] @ (low[h:, :h] @ out[:h, :h])
    return out


def _solve_lower(low: np.ndarray, y: np.ndarray, rows: int = 128) -> np.ndarray:
    """``low^-1 y``, block of rows by block of rows."""
    out = np.empty_like(y)
    for i in range(0, len(low), rows):
        at = slice(i, i + rows)
        out[at] = np.linalg.solve(low[at, at], y[at] - low[at, :i] @ out[:i])
    return out


Slopes = Callable[[], Sequence[np.ndarray]]
Gradient = Callable[[], np.ndarray]


def nll_at(cov: np.ndarray, slopes: Slopes, y: np.ndarray) -> tuple[float, Gradient]:
    """Negative log likelihood, averaged over the columns of ``y``, and what gives its derivatives along
    ``slopes()`` from the same factorisation; a search asks for those at accepted points only."""
    y = np.asarray(y, float).reshape(len(cov), -1)
    try:
        low = np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        return FAILED, lambda: np.zeros(len(slopes()))
    n, m = y.shape
    white = _solve_lower(low, y)
    value = 0.5 * ((white * white).sum() / m + 2 * np.log(np.diag(low)).sum() + n * np.log(2 * np.pi))

    def gradient() -> np.ndarray:
        root = _inverse_lower(low)
        a = root.T @ white
        spread = root.T @ root - (a @ a.T) / m
        return np.array([0.5 * np.vdot(spread, s) for s in slopes()])

    return float(value), gradient


class Stationary:
    """Base of the covariances over coordinates ``x``: value and gradient in one call, or one after the other."""

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        value, gradient = self.at(theta)
        return value, gradient()

    @property
    def scale(self) -> float:
        return float(len(self.x))

    @cached_property
    def apart(self) -> np.ndarray:
        return _distances(self.x, self.x)


def _with_noise(cov: np.ndarray, noise: float) -> np.ndarray:
    cov[np.diag_indices(len(cov))] += noise
    return cov


@dataclass(frozen=True)
class Isotropic(Stationary):
    """Length scale, variance and, unless it is given, noise (all log) of a process over coordinates ``x``."""

    x: np.ndarray
    y: np.ndarray
    nu: float
    noise: float | None = None

    def at(self, theta: np.ndarray) -> tuple[float, Gradient]:
        ls, var = np.exp(theta[:2])
        noise = self.noise if self.noise is not None else float(np.exp(theta[2]))
        k, slope = matern_slope(self.apart, self.nu, ls)

        def slopes() -> list[np.ndarray]:
            return [var * slope, var * k] + ([noise * np.eye(len(self.x))] if self.noise is None else [])

        return nll_at(_with_noise(var * k, noise), slopes, self.y)


@dataclass(frozen=True)
class Anisotropic(Stationary):
    """Vertical and horizontal length scale, variance and noise (all log); the first axis is vertical."""

    x: np.ndarray
    y: np.ndarray

    @cached_property
    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        return _distances(self.x[:, :1], self.x[:, :1]) ** 2, _distances(self.x[:, 1:], self.x[:, 1:]) ** 2

    def at(self, theta: np.ndarray) -> tuple[float, Gradient]:
        lz, lxy, var, noise = np.exp(theta)
        dz, dh = (d / scale**2 for d, scale in zip(self.squares, (lz, lxy)))
        s = np.sqrt(5 * (dz + dh))
        e = np.exp(-s)
        k = (1 + s + s * s / 3) * e

        def slopes() -> list[np.ndarray]:
            common = 5.0 / 3.0 * var * (1 + s) * e
            return [common * dz, common * dh, var * k, noise * np.eye(len(self.x))]

        return nll_at(_with_noise(var * k, noise), slopes, self.y)


@dataclass(frozen=True)
class LengthScale(Stationary):
    """Length scale (log) of a unit-variance process with known noise."""

    x: np.ndarray
    y: np.ndarray
    nu: float
    noise: float

    def at(self, theta: np.ndarray) -> tuple[float, Gradient]:
        k, slope = matern_slope(self.apart, self.nu, float(np.exp(theta[0])))
        return nll_at(_with_noise(k.copy(), self.noise), lambda: [slope], self.y)


@dataclass(frozen=True)
class Coregional:
    """Length scale (log) of the spatial factor beside a field covariance ``b``; ``y`` is snapshots x points x fields."""

    x: np.ndarray
    y: np.ndarray
    b: np.ndarray
    nu: float
    noise: float

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        k, slope = matern_slope(_distances(self.x, self.x), self.nu, float(np.exp(theta[0])))
        lam_b, q_b = np.linalg.eigh(self.b)
        lam, q = np.linalg.eigh(k)
        white = q.T @ self.y @ q_b
        d = np.maximum(lam, 0)[:, None] * np.maximum(lam_b, 0)[None, :] + self.noise
        value = 0.5 * ((white**2 / d).sum() / len(white) + np.log(d).sum() + d.size * np.log(2 * np.pi))
        turned = q.T @ slope @ q
        a = white / d
        pull = np.einsum("lpf,pq,lqf,f->", a, turned, a, np.maximum(lam_b, 0), optimize=True) / len(white)
        spread = (np.diag(turned)[:, None] * np.maximum(lam_b, 0)[None, :] / d).sum()
        return float(value), np.array([0.5 * (spread - pull)])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact distances, zero on the diagonal."""
    total = np.zeros((len(a), len(b)))
    for one, other in zip(a.T, b.T):
        total += (one[:, None] - other[None, :]) ** 2
    return np.sqrt(total)


def minimise(objective: Objective, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 200,
             tol: float = 1e-7) -> tuple[np.ndarray, float, int]:
    """(optimum, value, evaluations): quasi-Newton steps on the free parameters, projected to the box.

    An objective with ``at(theta)`` gives the value first and the gradient on request, which only accepted
    points need; one with ``scale`` is searched in ``scale * asinh(f / scale)``, which has the same optima
    but grows no faster than the logarithm where a misfit explodes.  The curvature is that of the
    free parameters alone.  A step is cut to the minimum of a parabola; the search ends where no step
    promises a change that the value's last digits can show.
    """
    scale = getattr(objective, "scale", None)

    def at(theta: np.ndarray) -> tuple[float, Gradient]:
        if hasattr(objective, "at"):
            return objective.at(theta)
        value, gradient = objective(theta)
        return value, lambda: gradient

    def bent(f: float) -> tuple[float, float]:
        """Value searched, and its derivative by ``f``."""
        return (scale * float(np.arcsinh(f / scale)), 1.0 / float(np.hypot(1.0, f / scale))) if scale else (f, 1.0)

    x = np.clip(np.asarray(start, float), low, high)
    f, gradient = at(x)
    v, by = bent(f)
    g = by * gradient()
    h, fresh, calls = np.eye(len(x)), True, 1
    for _ in range(rounds):
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        if not free.any() or np.abs(g[free]).max() < by * tol * max(1.0, abs(f)):
            break
        digits = 1e-13 * max(1.0, abs(v))
        step = np.zeros(len(x))
        step[free] = -np.linalg.solve(h[np.ix_(free, free)], g[free])
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))  # at most two log units a step
        if g @ (np.clip(x + step, low, high) - x) >= -digits:  # the box takes the descent away: along the gradient
            h, fresh, step = np.eye(len(x)), True, np.where(free, -g, 0.0)
            step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        t = 1.0
        while True:
            to = np.clip(x + t * step, low, high)
            fall = g @ (to - x)
            if fall >= -digits:
                return x, f, calls
            fn, gradient = at(to)
            vn, by = bent(fn)
            calls += 1
            if vn <= v + 1e-4 * fall and fn < FAILED:
                break
            t *= 0.5 if fn >= FAILED else float(np.clip(-0.5 * fall / (vn - v - fall), 0.1, 0.5))
        gn = by * gradient()
        s, y = to - x, gn - g
        small = v - vn <= digits
        x, f, v, g = to, fn, vn, gn
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            if fresh:
                h, fresh = np.eye(len(x)) * (y @ y) / (s @ y), False
            hs = h @ s
            h = h + np.outer(y, y) / (s @ y) - np.outer(hs, hs) / (s @ hs)
        if small:
            break
    return x, f, calls


def fit(spark: SparkSession, objective: Objective, bounds: Sequence[tuple[float, float]], starts: int = 3, first: Sequence[float] | None = None,
        seed: int = 0) -> Fit:
    """Best optimum of several starts: ``first`` (or the box's centre), and others drawn in the box."""
    low, high = (np.array([b[i] for b in bounds], float) for i in (0, 1))
    begin = np.clip((low + high) / 2 if first is None else np.asarray(first, float), low, high)
    drawn = np.random.default_rng(seed).uniform(low, high, size=(max(0, starts - 1), len(low)))
    names = [f"p{i}" for i in range(len(low))]
    begins = np.vstack([begin[None], drawn])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in part["id"]:
                first_value = objective.at(begins[i])[0] if hasattr(objective, "at") else objective(begins[i])[0]
                theta, value, calls = minimise(objective, begins[i], low, high)
                yield pd.DataFrame([[i, *theta, value, first_value, calls]], columns=["run", *names, "nll", "nll_start", "calls"])

    kinds = ", ".join(f"{n} double" for n in names)
    # a range of as many slices as starts: one start a task
    rows = spark.range(0, starts, 1, starts)
    runs = rows.mapInPandas(run, f"run bigint, {kinds}, nll double, nll_start double, calls bigint").orderBy("run").toPandas()
    best = runs.iloc[int(np.argmin(runs["nll"].to_numpy()))]
    return Fit(best[names].to_numpy(float), float(best["nll"]), float(runs["nll_start"].iloc[0]), runs)


def fit_frame(spark: SparkSession, names: Sequence[str], found: Fit, n: int) -> DataFrame:
    """One row: the fitted parameters, value and first value, and the sample's size."""
    cells = [*(float(np.exp(t)) for t in found.theta), found.value, found.start, n]
    return spark.createDataFrame([tuple(cells)], ", ".join(f"{c} double" for c in [*names, "nll", "nll_start"]) + ", n bigint").select(
        *names, "nll", "nll_start", F.col("n"))
