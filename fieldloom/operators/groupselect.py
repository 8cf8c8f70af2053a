"""Sensor selection in many groups at once: one low-rank factor per level, grown together.

The points of a level lie in tiles of bounded size; the factor of a level is one row of a state table
(picks, their coordinates, the inverse of the factor's pivot block).  A pass joins the states to the
tiles, scores every point, keeps the best ``pool`` candidates of each level, and lets every level pick
from its pool where the rows are.  Levels that are complete drop out.  The driver only counts open
levels, so neither levels nor points are limited by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.kernelproduct import _uniform
from fieldloom.operators.selection import ROUND, CholeskyScore, _pick_from, accept_ticks, linear_kernel
from fieldloom.session import cut_lineage, sized_broadcast

TILE = 1024
POOL = 256
STATE = ("level bigint, ids array<bigint>, rows array<double>, inv array<double>, scores array<double>, "
         "dim int, passes int, open boolean")
_STATE = pa.schema([("level", pa.int64()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.float64())), ("inv", pa.list_(pa.float64())),
                    ("scores", pa.list_(pa.float64())), ("dim", pa.int32()), ("passes", pa.int32()), ("open", pa.bool_())])
CANDIDATES = "level bigint, id bigint, x array<double>, score double, key double"

Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Rule:
    """``greedy`` takes the largest residual variance, ties to the lowest id; ``random`` takes points with
    probability proportional to it, by clocks that are functions of id, seed and pass."""

    kernel: Callable
    mode: str = "greedy"
    seed: int = 0
    pool: int = POOL


def tiles_of(points: DataFrame, tile: int = TILE) -> DataFrame:
    """level, tile, ids, xs (flattened), dim of ``points(level, id, x)``."""
    counts = points.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 1
    part = F.pmod(F.xxhash64("id"), F.lit(-(-most // tile))).alias("tile")
    rows = points.groupBy("level", part).agg(F.collect_list(F.struct("id", "x")).alias("p"))
    return cut_lineage(rows.select("level", "tile", F.col("p.id").alias("ids"), F.flatten("p.x").alias("xs"),
                                   F.size(F.col("p.x")[0]).alias("dim")))


def _array(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


def _scorer(kernel: Callable, rows: np.ndarray, inv: np.ndarray, dim: int) -> CholeskyScore:
    """The score of a level as its state tells it."""
    scorer = CholeskyScore(kernel)
    if len(rows):
        scorer.picked = rows.reshape(-1, dim).copy()
        scorer.inv = inv.reshape(len(scorer.picked), -1).copy()
    return scorer


def _per_tile(tiles: DataFrame, states: DataFrame, n_levels: int, row_bytes: int, columns: list[str], schema: str,
              fn: Callable[[pa.RecordBatch, int], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``fn`` over every tile beside the state of its level."""
    beside = states.select("level", *columns)
    joined = tiles.withColumnRenamed("dim", "width").join(sized_broadcast(beside, n_levels, row_bytes), "level")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from fn(batch, i)

    return joined.mapInArrow(run, schema)


def _candidates(tiles: DataFrame, states: DataFrame, rule: Rule, turn: int, n_levels: int, row_bytes: int) -> DataFrame:
    def best(batch: pa.RecordBatch, i: int) -> Iterator[pa.RecordBatch]:
        level, ids, width = batch.column("level")[i].as_py(), _array(batch, "ids", i), batch.column("width")[i].as_py()
        x = _array(batch, "xs", i).reshape(len(ids), width)
        scorer = _scorer(rule.kernel, _array(batch, "rows", i), _array(batch, "inv", i), width)
        score = np.round(scorer.score(x), ROUND) if rule.mode == "greedy" else scorer.score(x)
        some = np.flatnonzero((score > (0 if rule.mode == "greedy" else 1e-9)) & ~np.isin(ids, _array(batch, "picked", i)))
        key = -score[some]
        if rule.mode == "random":
            key = -np.log(_uniform(ids[some], rule.seed * 1000 + turn, 1)[:, 0]) / score[some]
        order = np.lexsort((ids[some], key))[: rule.pool]
        at = some[order]
        if len(at):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), pa.array(x[at].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), level)), pa.array(ids[at]), lists, pa.array(score[at]), pa.array(key[order])],
                                             ["level", "id", "x", "score", "key"])

    states = states.withColumnRenamed("ids", "picked")
    found = _per_tile(tiles, states, n_levels, row_bytes, ["picked", "rows", "inv"], CANDIDATES, best)
    rank = F.row_number().over(Window.partitionBy("level").orderBy("key", "id"))
    return found.withColumn("_rn", rank).where(F.col("_rn") <= rule.pool).drop("_rn")


def pick_from_pool(level: int, turn: int, state: dict, cand: np.ndarray, x: np.ndarray, score: np.ndarray, key: np.ndarray, rule: Rule, k: int) -> dict:
    """A level's state after its picks from one pool, which is sorted by key and id."""
    dim = x.shape[1] if len(cand) else state["dim"]
    scorer = _scorer(rule.kernel, np.array(state["rows"]), np.array(state["inv"]), dim)
    ids, scores = list(state["ids"]), list(state["scores"])
    rows = [] if scorer.picked is None else list(scorer.picked)
    full = len(cand) == rule.pool
    going = bool(len(cand))
    if going and rule.mode == "greedy":
        going = _pick_from(cand, x, score[-1] if full else -np.inf, scorer, k, ids, rows, scores)[0] and full
    elif going:
        before = len(ids)
        accept_ticks(cand, x, score, key, key[-1] if full else np.inf, scorer, k, ids, rows, scores, np.random.default_rng([rule.seed, level, turn]))
        going = full or len(ids) > before
    return {"level": level, "ids": ids, "rows": np.array(rows).ravel().tolist(), "inv": scorer.inv.ravel().tolist(), "scores": [float(v) for v in scores],
            "dim": dim, "passes": turn, "open": going and len(ids) < k}


def select_by(tiles: DataFrame, k: int, rule: Rule) -> DataFrame:
    """States of all levels with up to ``k`` picks each; fewer where no residual variance is left."""
    none = F.array().cast("array<double>")
    states = cut_lineage(tiles.groupBy("level").agg(F.max("dim").alias("dim")).select(
        "level", F.array().cast("array<bigint>").alias("ids"), none.alias("rows"), none.alias("inv"), none.alias("scores"), "dim",
        F.lit(0).alias("passes"), F.lit(True).alias("open")))
    n_levels, turn = states.count(), 0
    dim = states.agg(F.max("dim")).first()[0] or 1
    row_bytes = 8 * (k * dim + k * k + 2 * k)

    def step(key: tuple, pool: pa.Table, state: pa.Table) -> pa.Table:
        pool = pool.sort_by([("key", "ascending"), ("id", "ascending")]).combine_chunks()
        old = state.to_pylist()[0]
        cand = pool.column("id").to_numpy()
        x = np.array(pool.column("x").to_pylist()).reshape(len(cand), old["dim"])
        new = pick_from_pool(old["level"], turn, old, cand, x, pool.column("score").to_numpy(), pool.column("key").to_numpy(), rule, k)
        return pa.Table.from_pylist([new], _STATE)

    while not states.where("open").isEmpty():
        turn += 1
        live = states.where("open")
        pool = _candidates(tiles, live, rule, turn, n_levels, row_bytes)
        new = pool.groupBy("level").cogroup(live.groupBy("level")).applyInArrow(step, STATE)
        states = cut_lineage(states.where("NOT open").unionByName(new))
    return states


def _factor_modes(tiles: DataFrame, states: DataFrame, kernel: Callable, k: int, n_levels: int, row_bytes: int) -> DataFrame:
    """Tiles of mode rows: leading left singular vectors of each level's factor, at most ``k``."""

    def features(batch: pa.RecordBatch, i: int) -> np.ndarray:
        ids, width = _array(batch, "ids", i), batch.column("width")[i].as_py()
        scorer = _scorer(kernel, _array(batch, "rows", i), _array(batch, "inv", i), width)
        return scorer.features(_array(batch, "xs", i).reshape(len(ids), width))

    def square(batch: pa.RecordBatch, i: int) -> Iterator[pa.RecordBatch]:
        f = features(batch, i)
        yield pa.RecordBatch.from_arrays([pa.array([batch.column("level")[i].as_py()]), pa.array([(f.T @ f).ravel()])], ["level", "g"])

    def rotation(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in groups:
            part = batch.column("g").flatten().to_numpy().reshape(batch.num_rows, -1).sum(0)
            total = part if total is None else total + part
        r = int(round(np.sqrt(total.size)))
        lam, v = np.linalg.eigh(total.reshape(r, r))
        top = np.argsort(lam)[::-1][:k]
        top = top[lam[top] > lam.max() * 1e-12]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([(v[:, top] / np.sqrt(lam[top])).ravel()]), pa.array([len(top)], pa.int32())],
                                         ["level", "turn", "r"])

    parts = _per_tile(tiles, states, n_levels, row_bytes, ["rows", "inv"], "level bigint, g array<double>", square)
    turns = parts.groupBy("level").applyInArrow(rotation, "level bigint, turn array<double>, r int")
    states = cut_lineage(states.join(turns, "level"))

    def rows(batch: pa.RecordBatch, i: int) -> Iterator[pa.RecordBatch]:
        r = batch.column("r")[i].as_py()
        x = features(batch, i) @ _array(batch, "turn", i).reshape(-1, r)
        one = batch.slice(i, 1)
        yield pa.RecordBatch.from_arrays([one.column("level"), one.column("tile"), one.column("ids"), pa.array([x.ravel()]), pa.array([r], pa.int32())],
                                         ["level", "tile", "ids", "xs", "dim"])

    schema = "level bigint, tile bigint, ids array<bigint>, xs array<double>, dim int"
    return cut_lineage(_per_tile(tiles, states, n_levels, 2 * row_bytes, ["rows", "inv", "turn", "r"], schema, rows))


def gks_by(points: DataFrame, kernel: Callable, k: int, oversample: int = 20, seed: int = 0, pool: int = POOL, tile: int = TILE) -> DataFrame:
    """level, id: a column subset of the covariance of every level.

    ``points(level, id, x)``: a randomly pivoted factor of rank ``k + oversample`` per level, its leading
    singular vectors, then pivoted QR on their rows.  A level in which no more than ``k`` points have
    residual variance keeps those.
    """
    tiles = tiles_of(points, tile)
    pivots = select_by(tiles, k + oversample, Rule(kernel, "random", seed, pool))
    more = F.size("ids") > k
    few = pivots.where(~more).select("level", F.explode("ids").alias("id"))
    rest = pivots.where(more)
    n_levels = rest.count()
    if not n_levels:
        return few
    dim = rest.agg(F.max("dim")).first()[0]
    r = k + oversample
    modes = _factor_modes(tiles, rest, kernel, k, n_levels, 8 * (r * dim + 2 * r * r))
    picks = select_by(modes, k, Rule(linear_kernel, "greedy", seed, pool))
    return few.unionByName(picks.select("level", F.explode("ids").alias("id")))
