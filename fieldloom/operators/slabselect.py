"""Randomly pivoted Cholesky of any rank, for covariances that vanish with the distance.

The points are cut into slabs along their longest axis, each as wide as the covariance reaches, so a
point meets no pivot further away than the slab beside its own.  A factor that is grown until no
variance is left has about as many columns as there are points; here it is never formed as a whole:
a task works out the columns of three slabs, for the points of the one in the middle.

Picks follow the sequential rule.  Each point ticks as a Poisson process at the variance that it had
at the start of a window of time, and a tick is accepted with probability current/known variance.
Ticks are digests of seed, window and id.  What a slab picks depends on earlier picks beside it, so
the slabs of a window are worked out again with what their neighbours picked, until none changes:
by induction over the times that is the one outcome of all ticks taken in order.

Picks beyond the neighbouring slab are left out of a point's variance.  The covariance itself is zero
from there on; what is lost are chains over picks in between, below the rounding of the variance
before any pick (``tests/test_slabselect.py`` compares with the dense factor).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.kernelproduct import _uniform
from fieldloom.operators.selection import POOL, ROUND, CholeskyScore, Picks, Pool, RadialKernel
from fieldloom.session import cut_lineage

WHOLE = 2 * POOL  # points up to which the factor is kept in one piece
MOST = POOL  # points of a slab
LEAST = 1e-9  # variance that counts as none
LAST = 1e13  # time by which every point with variance has ticked some 10,000 times
FIRST, GROWTH = 0.125, 16.0  # end of the first window, in units of the mean waiting time; of each further one beside the last
BLOCK = 128
TASKS = 4  # per core

_LISTS = {"ids": "bigint", "xs": "double", "known": "double", "p_id": "bigint", "p_t": "double", "p_score": "double", "p_x": "double",
          "n_id": "bigint", "n_t": "double", "n_score": "double", "n_x": "double", "given": "double"}
OWN = ("ids", "xs", "known", "given")  # what a slab does not tell its neighbours
STATE = "slab bigint, " + ", ".join(f"{c} array<{t}>" for c, t in _LISTS.items()) + ", changed boolean"
_STATE = pa.schema([("slab", pa.int64()), *((c, pa.list_(pa.int64() if t == "bigint" else pa.float64())) for c, t in _LISTS.items()),
                    ("changed", pa.bool_())])


class Cut(NamedTuple):
    """Slabs of ``width`` along ``axis``, from ``origin`` on, for ``parts`` tasks."""

    axis: int
    origin: float
    width: float
    count: int
    parts: int

    def slab(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((x[:, self.axis] - self.origin) / self.width), 0, self.count - 1).astype("i8")

    def column(self) -> Column:
        at = F.floor((F.col("x")[self.axis] - self.origin) / self.width)
        return F.greatest(F.lit(0), F.least(at, F.lit(self.count - 1))).cast("bigint")


class AxisKernel(RadialKernel):
    """Radial covariance by differences along the axes: a factor down to ``LEAST`` has no digits to lose."""

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d2 = sum((a[:, i, None] - b[None, :, i]) ** 2 for i in range(a.shape[1]))
        return self.fn(np.sqrt(d2), m=np, **self.params)


def lower_inverse(low: np.ndarray) -> np.ndarray:
    """Inverse of a lower triangle, by halves."""
    n, out = len(low), np.zeros_like(low)
    if n <= 8:
        for i in range(n):
            out[i, :i] = -(low[i, :i] @ out[:i, :i]) / low[i, i]
            out[i, i] = 1.0 / low[i, i]
        return out
    h = n // 2
    out[:h, :h], out[h:, h:] = lower_inverse(low[:h, :h]), lower_inverse(low[h:, h:])
    out[h:, :h] = -out[h:, h:] @ (low[h:, :h] @ out[:h, :h])
    return out


class Near(CholeskyScore):
    """Factor of the picks of neighbouring slabs, kept as its triangle."""

    def __init__(self, of: CholeskyScore, picked: np.ndarray):
        super().__init__(AxisKernel(of.kernel.fn, **of.kernel.params), of.noise, of.scale)
        if len(picked):
            self.picked = picked
            # the triangle stands in for its inverse, of which only the size is asked
            self.inv = np.linalg.cholesky(self.scale * self.kernel(picked, picked) + self.noise * np.eye(len(picked)))

    def features(self, x: np.ndarray) -> np.ndarray:
        if self.picked is None:
            return np.zeros((len(x), 0))
        out, low = self.scale * self.kernel(x, self.picked), self.inv
        for a in range(0, len(low), BLOCK):
            b = min(a + BLOCK, len(low))
            out[:, a:b] = (out[:, a:b] - out[:, :a] @ low[a:b, :a].T) @ lower_inverse(low[a:b, a:b]).T
        return out


class SlabScore(CholeskyScore):
    """As :class:`CholeskyScore`; with many points the factor is kept by slabs."""

    cut: Cut | None = None

    def random_picks(self, points: DataFrame, k: int, seed: int) -> Picks | None:
        tiles = self._slabs(points)
        return None if tiles is None else random_slabs(tiles, self, k, seed)

    def _slabs(self, points: DataFrame) -> DataFrame | None:
        """slab, ids, xs of the points; none where the factor stays in one piece, because the points are few or
        lie so close that a slab would hold too many."""
        reach = self.kernel.reach if isinstance(self.kernel, RadialKernel) else np.inf
        if not np.isfinite(reach):
            return None
        axes = (
            points.select(F.posexplode("x")).where(F.col("col").isNotNull() & ~F.isnan("col"))
            .groupBy("pos").agg(F.min("col").alias("low"), F.max("col").alias("high"), F.count("col").alias("n")).toPandas()
        )
        if axes.empty or axes["n"].max() <= WHOLE:
            return None
        longest = axes.loc[(axes["high"] - axes["low"]).idxmax()]
        extent = float(longest["high"] - longest["low"])
        if extent < 3 * reach:
            return None
        count = int(extent // reach)
        cut = Cut(int(longest["pos"]), float(longest["low"]), extent / count, count, 1)
        whole = ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
        rows = points.where(whole).groupBy(cut.column().alias("slab"))
        sizes = rows.agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.count("n").alias("slabs")).first()
        if sizes["most"] > MOST:
            return None
        self.cut = cut._replace(parts=min(2 * sizes["slabs"], TASKS * points.sparkSession.sparkContext.defaultParallelism))
        gathered = rows.agg(F.array_sort(F.collect_list(F.struct("id", "x"))).alias("p"))
        return gathered.select("slab", F.col("p.id").alias("ids"), F.flatten("p.x").alias("xs"))

    def near(self, x: np.ndarray, slab: int) -> tuple[Near, np.ndarray]:
        """Factor for the points of a slab, and which picks it is made of."""
        at = np.flatnonzero(np.abs(self.cut.slab(self.picked) - slab) <= 1)
        return Near(self, self.picked[at]), at

    def draw(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The factor's rows of ``x`` times ``z``, a number a pick, and the variance that is left."""
        if self.cut is None:
            return self.features(x) @ z, self.score(x)
        drawn, left = np.full(len(x), np.nan), np.full(len(x), np.nan)
        whole = np.flatnonzero(np.isfinite(x).all(1))
        slabs = self.cut.slab(x[whole])
        for slab in np.unique(slabs):
            rows = whole[slabs == slab]
            near, at = self.near(x[rows], slab)
            f = near.features(x[rows])
            drawn[rows] = f @ z[at]
            left[rows] = np.maximum(near.prior(x[rows]) - (f * f).sum(1), 0.0)
        return drawn, left

    def deal(self, points: DataFrame) -> DataFrame:
        """The points of a slab in one task, for :func:`draw`."""
        return points if self.cut is None else points.repartition(self.cut.parts, self.cut.column()).sortWithinPartitions(self.cut.column())


def ticks(ids: np.ndarray, rate: np.ndarray, low: float, high: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, indices and marks in (0, 1) of Poisson processes between ``low`` and ``high``."""
    times, where, marks = [], [], []
    at, t, turn = np.arange(len(ids)), np.full(len(ids), low), 0
    while len(at):
        u = _uniform(ids[at], seed + turn, 2)
        t = t - np.log(u[:, 0]) / rate[at]
        at, t, u = at[t < high], t[t < high], u[t < high]
        times.append(t), where.append(at), marks.append(u[:, 1])
        turn += 1
    return np.concatenate(times or [np.zeros(0)]), np.concatenate(where or [at]), np.concatenate(marks or [np.zeros(0)])


def settle(near: Near, ids, x, known, given: tuple, low: float, high: float, seed: int) -> tuple:
    """Picks (ids, times, scores, rows) among the points of a slab within a window, beside those its neighbours
    are ``given``."""
    t, at, mark = ticks(ids, known, low, high, seed)
    some = np.unique(at)
    g_id, g_t, g_x = given
    pool_x = np.vstack([x[some], g_x])
    if not len(some):
        return ids[:0], t[:0], t[:0], x[:0]
    pool = Pool(near, pool_x, len(pool_x))
    own = sorted(zip(t.tolist(), ids[at].tolist(), mark.tolist(), np.searchsorted(some, at).tolist()))
    theirs = [(a, i, -1.0, len(some) + j) for j, (a, i) in enumerate(zip(g_t.tolist(), g_id.tolist()))]
    free, picked, scores, times = np.ones(len(pool_x), bool), [], [], []
    for when, _, m, j in heapq.merge(own, theirs):
        left = pool.left[j]
        if not free[j] or left <= LEAST or (m >= 0 and m * known[some[j]] >= left):
            continue
        free[j] = False
        pool.take(j)
        if m >= 0:
            picked.append(some[j]), scores.append(left), times.append(when)
    return ids[picked], np.array(times, float), np.array(scores, float), x[picked]


def _around(states: DataFrame, parts: int, fn: Callable[[dict, list[dict]], dict]) -> DataFrame:
    """``fn`` of every slab's state beside those of its neighbours, which come without their points."""
    mine = F.col("to") == F.col("slab")
    columns = [F.when(mine, F.col(c)).otherwise(F.array().cast(f"array<{_LISTS[c]}>")).alias(c) if c in OWN else c for c in states.columns]
    sent = states.withColumn("to", F.explode(F.array(F.col("slab") - 1, F.col("slab"), F.col("slab") + 1))).select("to", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
        for to, group in groupby(rows, lambda r: r.pop("to")):
            near = list(group)
            for own in [r for r in near if r["slab"] == to]:
                yield from pa.Table.from_pylist([fn(own, near)], _STATE).to_batches()

    return sent.repartition(parts, "to").sortWithinPartitions("to", "slab").mapInArrow(run, STATE)


def _joined(rows: list[dict], prefix: str, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, times and coordinates of the picks of several slabs, in order of time."""
    ids, t = (np.concatenate([np.array(r[f"{prefix}_{c}"], d) for r in rows] or [np.zeros(0, d)]) for c, d in (("id", "i8"), ("t", "f8")))
    x = np.concatenate([np.array(r[f"{prefix}_x"], "f8").reshape(-1, dim) for r in rows] or [np.zeros((0, dim))])
    order = np.lexsort((ids, t))
    return ids[order], t[order], x[order]


def _told(states: DataFrame) -> tuple[DataFrame, dict]:
    """The states, worked out, and how many points are open, slabs changed and picks made."""
    states = cut_lineage(states)
    sums = {"open": F.size("ids"), "changed": F.col("changed").cast("int"), "picks": F.size("p_id") + F.size("n_id")}
    return states, states.agg(*(F.sum(c).alias(name) for name, c in sums.items())).first().asDict()


def random_slabs(slabs: DataFrame, scorer: SlabScore, k: int, seed: int) -> Picks:
    """Picks among ``slabs(slab, ids, xs)`` in their order, which also become the scorer's."""
    none = [F.array().cast(f"array<{t}>").alias(c) for c, t in _LISTS.items() if c not in ("ids", "xs")]
    states = cut_lineage(slabs.select("slab", "ids", "xs", *none, F.lit(True).alias("changed")))
    first = states.select(F.size("xs").alias("n"), F.size("ids").alias("m"), F.slice("xs", F.lit(1), (F.size("xs") / F.size("ids")).cast("int")).alias("x")).first()
    dim, parts = first["n"] // first["m"], scorer.cut.parts
    unit = float(scorer.prior(np.array([first["x"]]))[0])
    plain = CholeskyScore(scorer.kernel, scorer.noise, scorer.scale)
    window, low, high = 0, 0.0, FIRST / unit

    def opened(own: dict, rows: list[dict]) -> dict:
        """The last window's picks are settled; points with variance left get the rate of their ticks and tick."""
        for r in rows:
            for c in ("id", "t", "score", "x"):
                r[f"p_{c}"] = r[f"p_{c}"] + r[f"n_{c}"]
        ids, x = np.array(own["ids"], "i8"), np.array(own["xs"], "f8").reshape(-1, dim)
        free = ~np.isin(ids, np.array(own["n_id"], "i8"))
        ids, x = ids[free], x[free]
        near = Near(plain, _joined(rows, "p", dim)[2]) if len(ids) else None
        known = np.round(near.score(x), ROUND) if len(ids) else np.zeros(0)
        left = known > LEAST
        own |= {"ids": ids[left], "xs": x[left].ravel(), "known": known[left], "given": []}
        return chosen(own, near, [])

    def again(own: dict, rows: list[dict]) -> dict:
        beside = [r for r in rows if r is not own]
        given = _joined(beside, "n", dim)
        if not len(own["ids"]) or np.array_equal(given[1], np.array(own["given"], "f8")):
            return own | {"changed": False}
        return chosen(own, Near(plain, _joined(rows, "p", dim)[2]), beside)

    def chosen(own: dict, near: Near | None, beside: list[dict]) -> dict:
        given, before = _joined(beside, "n", dim), own["n_t"] if beside else []
        ids, x = np.array(own["ids"], "i8"), np.array(own["xs"], "f8").reshape(-1, dim)
        new = (ids, np.zeros(0), np.zeros(0), x)
        if len(ids):
            new = settle(near, ids, x, np.array(own["known"], "f8"), given, low, high, (seed << 20) + (window << 12))
        return own | {"n_id": new[0], "n_t": new[1], "n_score": new[2], "n_x": new[3].ravel(), "given": given[1],
                      "changed": not np.array_equal(new[1], np.array(before, "f8"))}

    told = {"open": True, "picks": 0}
    while told["open"] and told["picks"] < k and low < LAST:
        states, told = _told(_around(states, parts, opened))
        while told["changed"]:
            states, told = _told(_around(states, parts, again))
        window, low, high = window + 1, high, high * GROWTH
    every = [F.concat(f"p_{c}", f"n_{c}").alias(c) for c in ("id", "t", "score", "x")]
    rows = states.select(*every).select(F.posexplode(F.arrays_zip("id", "t", "score")), "x").select(
        "col.*", F.slice("x", F.col("pos") * dim + 1, F.lit(dim)).alias("x")).orderBy("t", "id").limit(k).toPandas()
    scorer.picked = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, dim))
    return Picks(rows["id"].to_numpy("i8"), scorer.picked, rows["score"].to_numpy("f8"))
