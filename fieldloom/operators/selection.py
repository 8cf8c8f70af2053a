"""Sensor selection as distributed greedy search.

The greedy rules (pivoted Cholesky, pivoted QR, farthest point) all pick the point with
the largest score, and scores never rise as points are added.  That makes them lazy:
one narrow pass scores every point and brings back a small pool of the best; the driver
then keeps picking from the pool for as long as its best current score is above the
best score left outside.  The picks equal those of the one-pass-per-pick rule.

Pivoted QR of mode rows is the same search with a linear kernel: the residual column
norm after k pivots is the Schur-complement diagonal of ``Phi Phi^T``.
"""

from __future__ import annotations

import heapq
from typing import Callable, NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import kernels as kn
from fieldloom.session import cut_lineage
from fieldloom.sources.profiles import block, collect_matrix, list_column, map_blocks, scalar, sum_blocks

ROUND = 9
POOL = 2048
WIDE = 256  # columns of a factor from which on the scores of a pass are written
VALUES = 1 << 21  # of a covariance block in a task
SLACK = 1e-8  # by which rounding may lift a score, beside the largest
LEVEL_SPAN = 1 << 31  # id of a cell = loc * LEVEL_SPAN + level


class Picks(NamedTuple):
    """Ordered selection: ids, their payload rows and the score at the time of picking."""

    ids: np.ndarray
    rows: np.ndarray
    scores: np.ndarray

    def to_frame(self, spark) -> DataFrame:
        rows = [(r, int(i), float(s)) for r, (i, s) in enumerate(zip(self.ids, self.scores))]
        return spark.createDataFrame(rows, "rank bigint, id bigint, score double")


RADIAL = {f.__name__: f for f in (kn.rbf, kn.matern, kn.multiscale)}


def linear_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


def distance_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d2, 0.0))


class RadialKernel:
    """Covariance of coordinates through a function of distance."""

    def __init__(self, fn: Callable, **params):
        self.fn, self.params = fn, params

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.fn(distance_matrix(a, b), m=np, **self.params)

    @property
    def reach(self) -> float:
        """Distance from which on the covariance is zero in floating point (``exp(-746)`` is)."""
        ls, nu = self.params.get("ls", 1.0), self.params.get("nu")
        if self.fn is kn.rbf:
            return ls * float(np.sqrt(2 * 746.0))
        if self.fn is kn.matern:
            return ls * 746.0 / float(np.sqrt(2 * nu))
        if self.fn is kn.multiscale:
            return max(ls, self.params.get("ls_local", 0.2)) * 746.0 / float(np.sqrt(5.0))
        return float("inf")


def described(kernel: RadialKernel) -> tuple[str, dict[str, float]]:
    """Name and parameters of a radial covariance, from which ``restored`` makes it again."""
    if not isinstance(kernel, RadialKernel) or RADIAL.get(kernel.fn.__name__) is not kernel.fn:
        raise ValueError("only radial covariances of the library can be stored")
    return kernel.fn.__name__, {k: float(v) for k, v in kernel.params.items()}


def restored(name: str, parameters: dict[str, float]) -> RadialKernel:
    return RadialKernel(RADIAL[name], **parameters)


class CholeskyScore:
    """Residual variance of a point given the points picked so far."""

    def __init__(self, kernel: Callable, noise: float = 0.0, scale: float = 1.0):
        self.kernel, self.noise, self.scale = kernel, noise, scale
        self.picked, self.inv = None, np.zeros((0, 0))

    def prior(self, x: np.ndarray) -> np.ndarray:
        if self.kernel is linear_kernel:
            return self.scale * (x * x).sum(1)
        return np.full(len(x), self.scale * self.kernel(x[:1], x[:1])[0, 0])

    def features(self, x: np.ndarray) -> np.ndarray:
        if self.picked is None:
            return np.zeros((len(x), 0))
        return self.scale * (self.kernel(x, self.picked) @ self.inv.T)

    def score(self, x: np.ndarray) -> np.ndarray:
        f = self.features(x)
        return np.maximum(self.prior(x) - (f * f).sum(1), 0.0)

    @property
    def width(self) -> int:
        """Covariances that a score of a point takes."""
        return len(self.inv)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """What the kernel takes, for points as they come."""
        return x

    def random_picks(self, points: DataFrame, k: int, seed: int) -> Picks | None:
        """All picks of :func:`random_select`, where the scorer has a way of its own for them."""
        return None

    def step(self, since: int) -> Callable[[np.ndarray], np.ndarray]:
        """Columns of the factor from pick ``since`` on, as a function of points."""
        if since == len(self.inv):
            return lambda x: np.zeros((len(x), 0))
        kernel, picked, turn = self.kernel, self.picked, self.scale * self.inv[since:].T
        return lambda x: kernel(x, picked) @ turn

    def variance(self) -> Callable[[np.ndarray], np.ndarray]:
        """Variance before any pick, as a function of points."""
        return CholeskyScore(self.kernel, self.noise, self.scale).prior

    def _pivot(self, x: np.ndarray, f: np.ndarray) -> float:
        return np.sqrt(max(self.prior(x)[0] + self.noise - f @ f, 1e-300))

    def column(self, x: np.ndarray, row: np.ndarray, factor: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Next column of ``factor`` (the features of ``x``) for the pick ``row`` with features ``f``."""
        return (self.scale * self.kernel(x, row[None])[:, 0] - factor @ f) / self._pivot(row[None], f)

    def add(self, row: np.ndarray, f: np.ndarray | None = None) -> None:
        x = row[None]
        f = self.features(x)[0] if f is None else f
        pivot = self._pivot(x, f)
        k = len(f)
        grown = np.zeros((k + 1, k + 1))
        grown[:k, :k] = self.inv
        grown[k, :k] = -(f @ self.inv) / pivot
        grown[k, k] = 1.0 / pivot
        self.inv = grown
        self.picked = x if self.picked is None else np.vstack([self.picked, x])

    def extend(self, rows: np.ndarray, low: np.ndarray) -> None:
        """As :func:`add` for several picks, given their rows ``low`` of the triangular factor."""
        k, m = len(self.inv), len(rows)
        grown = np.zeros((k + m, k + m))
        grown[:k, :k] = self.inv
        grown[k:, k:] = np.tril(np.linalg.inv(low[:, k:]))
        grown[k:, :k] = -grown[k:, k:] @ (low[:, :k] @ self.inv)
        self.inv = grown
        self.picked = rows if self.picked is None else np.vstack([self.picked, rows])


class ModeScore(CholeskyScore):
    """Pivoted QR over the mode rows ``features(x) @ turn`` of a covariance factor, for points that
    are given by their coordinates: a mode row is as long as there are sensors and is worked out
    where it is needed."""

    def __init__(self, factor: CholeskyScore, turn: np.ndarray):
        super().__init__(linear_kernel)
        self.of, self.pivots = factor.kernel, factor.picked
        self.turn = factor.scale * (factor.inv.T @ turn)

    @property
    def width(self) -> int:
        return len(self.pivots)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.of(x, self.pivots) @ self.turn

    def score(self, x: np.ndarray) -> np.ndarray:
        return super().score(self.rows(x))

    def step(self, since: int) -> Callable[[np.ndarray], np.ndarray]:
        if since == len(self.inv):
            return lambda x: np.zeros((len(x), 0))
        of, pivots, turn = self.of, self.pivots, self.turn @ (self.picked.T @ self.inv[since:].T)
        return lambda x: of(x, pivots) @ turn

    def variance(self) -> Callable[[np.ndarray], np.ndarray]:
        of, pivots, turn = self.of, self.pivots, self.turn
        return lambda x: ((of(x, pivots) @ turn) ** 2).sum(1)


class Pool:
    """Residual variances ``left`` of a bounded number of points; a pick adds one column to their
    part of the factor instead of scoring them anew."""

    def __init__(self, scorer: CholeskyScore, x: np.ndarray, room: int):
        self.scorer, self.x, self.done = scorer, scorer.rows(x), len(scorer.inv)
        self.factor = np.zeros((len(x), self.done + room), order="F")
        self.factor[:, : self.done] = scorer.features(self.x)
        self.left = np.maximum(scorer.prior(self.x) - (self.factor * self.factor).sum(1), 0.0)
        self.taken, self.pivots = [], []

    def take(self, j: int) -> None:
        before, f = self.factor[:, : self.done], self.factor[j, : self.done]
        self.pivots.append(self.scorer._pivot(self.x[j][None], f))
        self.factor[:, self.done] = self.scorer.column(self.x, self.x[j], before, f)
        self.left = np.maximum(self.left - self.factor[:, self.done] ** 2, 0.0)
        self.taken.append(j)
        self.done += 1

    def close(self) -> None:
        """The picks become the scorer's."""
        if self.taken:
            low = np.tril(self.factor[self.taken, : self.done], self.done - len(self.taken))
            at = np.arange(len(self.taken))
            low[at, self.done - len(self.taken) + at] = self.pivots
            self.scorer.extend(self.x[self.taken], low)


class CoregionalScore:
    """Variance summed over the latent fields of a coregionalisation, each weighted by
    its eigenvalue and observed with noise."""

    def __init__(self, eigenvalues: np.ndarray, kernel: Callable, noise: float):
        self.parts = [(lam, CholeskyScore(kernel, noise, lam)) for lam in eigenvalues]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sum(lam * part.score(x) for lam, part in self.parts)

    def add(self, row: np.ndarray) -> None:
        for _, part in self.parts:
            part.add(row)


class DistanceScore:
    """Distance to the nearest point picked so far (farthest-point ordering)."""

    def __init__(self):
        self.picked = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.picked is None:
            return np.full(len(x), 1e18)
        return distance_matrix(x, self.picked).min(1)

    def add(self, row: np.ndarray) -> None:
        self.picked = row[None] if self.picked is None else np.vstack([self.picked, row[None]])


def in_slices(fn: Callable[[np.ndarray], np.ndarray], x: np.ndarray, width: int) -> np.ndarray:
    """``fn`` of the rows of ``x``, at most ``VALUES`` covariances at a time."""
    step = max(1, VALUES // max(width, 1))
    return np.concatenate([fn(x[low : low + step]) for low in range(0, len(x), step)])


def _scored(points: DataFrame, scorer) -> DataFrame:
    """points(id, x array<double>) with the current score: one narrow pass."""
    return map_blocks(
        points, ["id", "x"], "id bigint, x array<double>, score double",
        lambda b: [b.column("id"), b.column("x"), np.round(scorer.score(block(b, "x")), ROUND)],
    )


class _Passes:
    """Scores of all points, pass by pass.

    Those of a wide factor are written, so that the next pass takes and ships only the columns of the
    picks since then.  Others are written by a second pass that tells what score is ``wanted``: variances
    never rise, so later passes work out those points alone that were not below it.  What is wanted is
    told by points from everywhere (``some``), as a pool has but the surroundings of a pick."""

    def __init__(self, points: DataFrame, scorer):
        self.points, self.scorer, self.known, self.since = points, scorer, None, 0
        self.least, self.some, self.written = -np.inf, None, -np.inf

    def scored(self, wanted: float | None = None) -> DataFrame:
        """Points with their scores, all of those that score ``least`` or more."""
        scorer = self.scorer
        width = scorer.width if isinstance(scorer, CholeskyScore) else 0
        if width <= WIDE:
            self.least = -np.inf
            if wanted is None or (wanted <= 0 and self.known is not None):
                return _scored(self.points, scorer)
            if self.known is None or wanted < self.written / 4:
                self.known = cut_lineage(_scored(self.points, scorer))
                self.some = self.known.orderBy(F.xxhash64("id"), "id").limit(POOL).select("id", "x").toPandas()
                self.written = self.reached([])
                return self.known
            self.least = wanted
            return _scored(self.known.where(F.col("score") >= wanted), scorer)
        first, columns = self.known is None, scorer.step(self.since)
        variance = scorer.variance() if first else None

        def left(b):
            x = block(b, "x")
            before = in_slices(variance, x, width) if first else scalar(b, "left")
            return [b.column("id"), b.column("x"),
                    np.maximum(before - in_slices(lambda rows: (columns(rows) ** 2).sum(1), x, width), 0.0)]

        rows, names = (self.points, ["id", "x"]) if first else (self.known, ["id", "x", "left"])
        self.known = cut_lineage(map_blocks(rows, names, "id bigint, x array<double>, left double", left))
        self.since = len(scorer.inv)
        return self.known.select("id", "x", F.round("left", ROUND).alias("score"))

    def reached(self, ids: list[int]) -> float:
        """A score that a point beside ``ids`` has."""
        free = [] if self.some is None else self.some["x"][~self.some["id"].isin(ids)]
        return float(np.round(self.scorer.score(np.stack(free)), ROUND).max()) if len(free) else -np.inf


def greedy_select(points: DataFrame, scorer, k: int, pool: int = POOL) -> Picks:
    """``k`` picks by largest score, ties to the lowest id."""
    pool = max(pool, 4)
    ids, rows, scores = [], [], []
    passes, wanted = _Passes(points, scorer), None
    while len(ids) < k:
        got = (
            passes.scored(wanted).where(~F.col("id").isin(ids) if ids else F.lit(True))
            .orderBy(F.desc("score"), "id").limit(pool).toPandas()
        )
        if got.empty:
            break
        cand, x = got["id"].to_numpy(), np.stack(got["x"].to_numpy())
        outside = max(passes.least, got["score"].iloc[-1] if len(got) == pool else -np.inf)
        more, best = _pick_from(cand, x, outside, scorer, k, ids, rows, scores)
        if not more:
            break
        if isinstance(scorer, CholeskyScore):
            wanted = max(best, passes.reached(ids)) - SLACK * (1.0 + scores[0])
    return Picks(np.array(ids, "i8"), np.array(rows), np.array(scores))


def greedy_select_by(points: DataFrame, group: str, scorers: dict, k: int, pool: int = 64) -> dict[int, Picks]:
    """:func:`greedy_select` for every group at once: ``points(<group>, id, x)``.

    A pass keeps ``pool`` candidates per group; the rank filter also runs before the
    shuffle, so a hot group costs no more than any other.  Groups are bounded (levels).
    """
    out = {g: ([], [], []) for g in scorers}
    open_groups = set(scorers)
    order = Window.partitionBy(group).orderBy(F.desc("score"), "id")

    def scored(b):
        g, x = scalar(b, group), block(b, "x")
        s = np.empty(len(g))
        for name in np.unique(g):
            hit = g == name
            s[hit] = live[name].score(x[hit]) if name in live else -1.0
        return [b.column(group), b.column("id"), b.column("x"), np.round(s, ROUND)]

    while open_groups:
        live = {g: scorers[g] for g in open_groups}
        got = (
            map_blocks(points, [group, "id", "x"], f"{group} bigint, id bigint, x array<double>, score double", scored)
            .where("score > 0")
            .withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= pool)
            .toPandas()
        )
        frames = dict(list(got.groupby(group)))
        for g in list(open_groups):
            cand = frames.get(g)
            if cand is None:
                open_groups.discard(g)
                continue
            cand = cand.sort_values("_rn")
            ids, rows, scores = out[g]
            _pick_from(cand["id"].to_numpy(), np.stack(cand["x"].to_numpy()),
                       cand["score"].iloc[-1] if len(cand) == pool else -np.inf, scorers[g], k, ids, rows, scores)
            if len(ids) >= k or len(cand) < pool:
                open_groups.discard(g)
    return {g: Picks(np.array(i, "i8"), np.array(r), np.array(s)) for g, (i, r, s) in out.items()}


def _pick_from(cand, x, outside, scorer, k, ids, rows, scores) -> tuple[bool, float]:
    """Greedy picks from one pool, as far as it is conclusive; False when nothing with a
    positive score is left.  With the best score left in the pool, as far as it is known."""
    free = ~np.isin(cand, ids)
    first, more, best = True, True, -np.inf
    pool = Pool(scorer, x, min(k - len(ids), len(x))) if isinstance(scorer, CholeskyScore) else None
    while len(ids) < k and free.any():
        s = np.where(free, np.round(pool.left if pool else scorer.score(x), ROUND), -np.inf)
        j = int(np.lexsort((cand, -s))[0])
        best = float(s[j])
        if not first and s[j] <= outside:
            break
        if s[j] <= 0:
            more = False
            break
        pool.take(j) if pool else scorer.add(x[j])
        ids.append(int(cand[j])), rows.append(x[j]), scores.append(s[j])
        free[j], first, best = False, False, -np.inf
    if pool:
        pool.close()
    return more, best


def random_select(points: DataFrame, scorer: CholeskyScore, k: int, seed: int, pool: int = POOL) -> Picks:
    """Randomly pivoted Cholesky: each pick has probability proportional to its residual
    variance.

    Every point is a Poisson clock ticking at the variance known at the last pass; a tick
    is accepted with probability current/known variance.  Thinning leaves exactly the
    sequential distribution, and one pass serves many picks.  Clocks are functions of the
    id and the pass, so a retried task reproduces them.  Fewer than ``k`` picks mean that no
    point has residual variance left.  The driver keeps the factor's pivot block; a rank that grows
    with the points takes ``slabselect.SlabScore``.
    """
    own = scorer.random_picks(points, k, seed)
    if own is not None:
        return own
    rng = np.random.default_rng(seed)
    ids, rows, scores = [], [], []
    passes, known = 0, _Passes(points, scorer)
    while len(ids) < k:
        bits = F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(seed), F.lit(passes)), 11)
        ticking = (
            known.scored().where(F.col("score") > 1e-9)
            .withColumn("t", -F.log((bits + 0.5) / float(2**53)) / F.col("score"))
            .orderBy("t", "id").limit(pool).toPandas()
        )
        passes += 1
        if ticking.empty:
            break
        x = np.stack(ticking["x"].to_numpy())
        horizon = ticking["t"].iloc[-1] if len(ticking) == pool else np.inf
        accept_ticks(ticking["id"].to_numpy(), x, ticking["score"].to_numpy(), ticking["t"], horizon, scorer, k, ids, rows, scores, rng)
    return Picks(np.array(ids, "i8"), np.array(rows), np.array(scores))


def accept_ticks(cand, x, known, first, horizon: float, scorer, k: int, ids: list, rows: list, scores: list, rng) -> None:
    """Picks from a pool of clocks that tick at the variances ``known``, in order of their ticks up to
    ``horizon``: a tick is accepted with probability current/known variance."""
    queue = [(t, j) for j, t in enumerate(first)]
    heapq.heapify(queue)
    current, idle = known.copy(), 0
    pool, earlier = Pool(scorer, x, min(k - len(ids), len(x))), np.isin(cand, ids)
    while queue and len(ids) < k and idle < 8 * len(cand):
        t, j = heapq.heappop(queue)
        again = t + rng.exponential() / known[j]
        if again <= horizon:
            heapq.heappush(queue, (again, j))
        if rng.random() * known[j] < current[j] and current[j] > 1e-9:
            pool.take(j)
            ids.append(int(cand[j])), rows.append(x[j]), scores.append(current[j])
            current, idle = pool.left.copy(), 0
            current[pool.taken] = 0.0
            current[earlier] = 0.0
        else:
            idle += 1
    pool.close()


def qdeim(modes: DataFrame, k: int, n_sensors: int | None = None) -> Picks:
    """Sensors of a basis: pivoted QR over mode rows ``modes(id, x)``.

    Beyond the k pivots of a square selection, extra sensors are the rows with the most
    weight among the rest.
    """
    picks = greedy_select(modes, CholeskyScore(linear_kernel), k)
    extra = (n_sensors or k) - len(picks.ids)
    if extra <= 0:
        return picks
    weight = F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v), ROUND)
    more = (
        modes.where(~F.col("id").isin(picks.ids.tolist())).withColumn("w", weight)
        .orderBy(F.desc("w"), "id").limit(extra).toPandas()
    )
    return Picks(
        np.concatenate([picks.ids, more["id"].to_numpy()]),
        np.vstack([picks.rows, np.stack(more["x"].to_numpy())]),
        np.concatenate([picks.scores, more["w"].to_numpy()]),
    )


def deim_constant(rows: np.ndarray, norm: str = "spectral") -> float:
    """Amplification of the projection error by interpolating at the sensors."""
    inv = np.linalg.pinv(rows)
    return float(np.linalg.norm(inv, 2 if norm == "spectral" else "fro"))


def maxmin(points: DataFrame, k: int) -> Picks:
    """Farthest-point ordering from the lowest id."""
    return greedy_select(points, DistanceScore(), k)


def low_rank_turn(points: DataFrame, scorer: CholeskyScore, k: int, power: int = 0) -> np.ndarray:
    """Turn of the low-rank factor ``F`` behind ``scorer`` (``K ~ F F^T``) to its leading left singular
    vectors: Gram matrix of F and a small eigenproblem.

    Columns of F fade with the distance from their pivots as the covariance does. Products below the
    square of the machine precision are left out of what the tasks send, so the matrix has as many
    entries as there are neighbouring pivots.
    """
    r, features = scorer.inv.shape[0], scorer.step(0)
    least = float(scorer.prior(scorer.picked[:1])[0]) * np.finfo(float).eps ** 2

    def products(b):
        x, total = block(b, "x"), np.zeros((r, r))
        for low in range(0, len(x), max(1, VALUES // r)):
            f = features(x[low : low + max(1, VALUES // r)])
            total += f.T @ f
        return np.triu(total)

    upper = collect_matrix(sum_blocks(points, ["x"], (r, r), products, least), (r, r))
    lam, v = np.linalg.eigh(upper + np.triu(upper, 1).T)
    top = np.argsort(lam)[::-1][:k]
    keep = top[lam[top] > lam.max() * 1e-12]
    return v[:, keep] / np.sqrt(lam[keep]) ** (1 - power)


def gks(points: DataFrame, kernel: Callable, k: int, oversample: int = 20, mode: str = "random", seed: int = 0) -> Picks:
    """Column subset of a covariance: low-rank factor of rank ``k + oversample``, its
    leading singular vectors, then pivoted QR on their rows.  ``mode`` chooses how the
    factor's pivots are found (``random`` or ``greedy``)."""
    scorer = CholeskyScore(kernel)
    if mode == "random":
        pivots = random_select(points, scorer, k + oversample, seed)
    else:
        pivots = greedy_select(points, scorer, k + oversample)
    if len(pivots.ids) < k:
        raise ValueError(f"only {len(pivots.ids)} of {k} points have residual variance")
    if len(pivots.ids) == k:
        return pivots
    return greedy_select(points, ModeScore(scorer, low_rank_turn(points, scorer, k)), k)


def greedy_error(profiles: DataFrame, k: int, candidates: np.ndarray, kernel: Callable, noise: float) -> list[int]:
    """Oracle placement: add the candidate whose one-step Kriging update lowers the total
    squared error most.

    ``profiles(loc, y, x, vec)``.  For a Gaussian posterior the reduction by candidate c
    is ``|C(:,c) e_c / (C_cc + noise)|`` against the current error, so all candidates of a
    step are scored in one pass of partial sums instead of one solve each.
    """
    coords = {int(r[0]): r[1:] for r in candidates}
    order = sorted(coords)
    xy = np.array([coords[i] for i in order], float)
    readings = np.stack(
        profiles.where(F.col("loc").isin(order)).select("loc", "vec").toPandas()
        .sort_values("loc")["vec"].to_numpy()
    )
    chosen = [0, len(order) - 1][: max(k, 1)]
    while True:
        s = xy[chosen]
        base = kernel(s, s) + noise * np.eye(len(s))
        w = np.linalg.solve(base, kernel(s, xy))
        post = kernel(xy, xy) - kernel(xy, s) @ w
        err_c = readings - w.T @ readings[chosen]
        if len(chosen) >= k:
            return [order[c] for c in chosen]
        alpha = np.linalg.solve(base, readings[chosen])
        gain_rows = err_c / (np.diag(post) + noise)[:, None]

        def reduction(b, s=s, w=w, alpha=alpha, gain_rows=gain_rows):
            x = np.column_stack([scalar(b, "y"), scalar(b, "x")]).astype(float)
            err = block(b, "vec") - kernel(x, s) @ alpha
            c = kernel(x, xy) - kernel(x, s) @ w
            cross = (c * (err @ gain_rows.T)).sum(0)
            square = (c * c).sum(0) * (gain_rows * gain_rows).sum(1)
            return (2.0 * cross - square)[None]

        drop = collect_matrix(sum_blocks(profiles, ["y", "x", "vec"], (1, len(order)), reduction), (1, len(order)))[0]
        drop[chosen] = -np.inf
        chosen.append(int(np.argmax(np.round(drop, 6))))


def worst_unused_levels(level_rmse: DataFrame, used: DataFrame, k: int) -> DataFrame:
    """The k unused levels with the largest error."""
    free = level_rmse.join(used.select("level"), "level", "left_anti")
    return free.orderBy(F.desc(F.round("rmse", ROUND)), "level").limit(k)
