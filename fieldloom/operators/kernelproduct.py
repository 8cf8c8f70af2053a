"""An implicit covariance times a block of vectors, and what follows from it.

``K`` is never formed.  Points are dealt into tiles by a digest of their id, right-hand tiles (coordinates
and vectors) are sent to every left-hand tile, and each pair adds one product to the tile's
partial sum inside an executor.  Randomised eigenpairs and the column-pivoted QR of ``K`` itself are
built on that: the driver sees matrices of sketch or pool size only, whatever the number of points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.selection import ROUND, Picks
from fieldloom.session import cut_lineage
from fieldloom.sources.profiles import block, collect_matrix, list_column, map_blocks, sum_blocks

LEFT, RIGHT = 4096, 1024
ROWS = 512

Batches = Iterator[pa.RecordBatch]
Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _tile(count: int) -> object:
    return F.pmod(F.xxhash64("id"), F.lit(max(1, count))).alias("tile")


BANDS = 4  # bands of the first coordinate within the reach of a covariance


def _in_bands(rows: DataFrame, size: int, side: float) -> tuple[DataFrame, DataFrame]:
    """(rows with band and tile, band and tiles of every band): bands of the first coordinate, cut into tiles of about ``size`` rows."""
    rows = rows.withColumn("band", F.floor(F.col("x")[0] / side).cast("bigint"))
    counts = rows.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / size).cast("bigint").alias("tiles"))
    part = F.pmod(F.xxhash64("id"), F.col("tiles"))
    return rows.join(counts, "band").withColumn("tile", F.struct("band", part.alias("part"))).drop("tiles"), counts


def kernel_product(points: DataFrame, vectors: DataFrame, kernel: Kernel, n: int, left: int = LEFT, right: int = RIGHT,
                   reach: float = float("inf")) -> DataFrame:
    """id, y: ``sum_j K(i, j) v_j`` of every point, for ``points(id, x)`` and ``vectors(id, x, v)``.

    ``vectors`` carries the coordinates of its points, which need not be those of ``points``; ``n`` bounds
    the number of either.  Where the covariance is zero from the distance ``reach`` on, tiles are bands of the first
    coordinate and meet only those within it, so the work grows with the points and not with their square.
    """
    if np.isfinite(reach):
        side = reach / BANDS
        rows, counts = _in_bands(points, left, side)
        lefts = rows.select(F.xxhash64("tile").alias("tile"), "id", "x").groupBy("tile").agg(F.collect_list(F.struct("id", "x")).alias("rows"))
        near = F.explode(F.sequence(F.col("tile.band") - BANDS - 1, F.col("tile.band") + BANDS + 1)).alias("band")
        rights = _in_bands(vectors, right, side)[0].groupBy("tile").agg(F.collect_list(F.struct("x", "v")).alias("columns"))
        part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("part")
        sent = rights.select("columns", near).join(counts, "band").select("columns", "band", part)
        sent = sent.select("columns", F.xxhash64(F.struct("band", "part")).alias("tile"))
        return _summed(sent.join(lefts.hint("merge"), "tile").select("tile", "rows", "columns"), kernel)
    lefts = points.groupBy(_tile(-(-n // left))).agg(F.collect_list(F.struct("id", "x")).alias("rows"))
    rights = vectors.groupBy(_tile(-(-n // right)).alias("other")).agg(F.collect_list(F.struct("x", "v")).alias("columns"))
    last = max(1, -(-n // left)) - 1
    sent = rights.select("columns", F.explode(F.sequence(F.lit(0), F.lit(last)).cast("array<bigint>")).alias("tile"))
    return _summed(sent.join(lefts.hint("merge"), "tile").select("tile", "rows", "columns"), kernel)


def _summed(pairs: DataFrame, kernel: Kernel) -> DataFrame:
    """id, y: sums over all pairs (tile, rows, columns) of one product each."""

    def run(batches: Batches) -> Batches:
        tile, ids, total = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                rows = pa.RecordBatch.from_struct_array(batch.column("rows")[i].values)
                columns = pa.RecordBatch.from_struct_array(batch.column("columns")[i].values)
                if batch.column("tile")[i].as_py() != tile:
                    if tile is not None:
                        yield told(tile, ids, total)
                    tile, ids, total = batch.column("tile")[i].as_py(), rows.column("id"), None
                a, b, v = block(rows, "x"), block(columns, "x"), block(columns, "v")
                part = np.concatenate([kernel(a[k : k + ROWS], b) @ v for k in range(0, len(a), ROWS)])
                total = part if total is None else total + part
        if tile is not None:
            yield told(tile, ids, total)

    def told(tile: int, ids: pa.Array, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), tile)), ids, list_column(total)], ["tile", "id", "y"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        batch = group.combine_chunks().to_batches()[0]
        ids, back = np.unique(batch.column("id").to_numpy(), return_inverse=True)
        total = np.zeros((len(ids), len(batch.column("y")[0])))
        np.add.at(total, back, block(batch, "y"))
        return pa.table({"id": pa.array(ids), "y": list_column(total)})

    sums = pairs.mapInArrow(run, "tile bigint, id bigint, y array<double>")
    return sums.groupBy("tile").applyInArrow(add, "id bigint, y array<double>")


def _uniform(ids: np.ndarray, seed: int, n: int) -> np.ndarray:
    """(len(ids), n) numbers in (0, 1), functions of id, seed and column."""
    h = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    h += np.uint64((seed * 0xA24BAED4963EE407 + 1) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def normals(ids: np.ndarray, seed: int, n: int) -> np.ndarray:
    """Standard normal numbers that a repeated task draws again."""
    u, w = _uniform(ids, 2 * seed, n), _uniform(ids, 2 * seed + 1, n)
    return np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * np.pi * w)


def _orthonormal(y: DataFrame, width: int) -> DataFrame:
    """id, x, v: the columns of ``y(id, x, v)`` made orthonormal, by Cholesky of the Gram matrix, twice."""
    for _ in range(2):
        g = collect_matrix(sum_blocks(y, ["v"], (width, width), lambda b: (lambda m: m.T @ m)(block(b, "v"))), (width, width))
        lam, w = np.linalg.eigh(g)
        keep = lam > lam.max() * 1e-14
        turn = w[:, keep] / np.sqrt(lam[keep])
        y = cut_lineage(map_blocks(y, ["id", "x", "v"], "id bigint, x array<double>, v array<double>",
                                   lambda b, turn=turn: [b.column("id"), b.column("x"), list_column(block(b, "v") @ turn)]))
        width = turn.shape[1]
    return y


def _applied(points: DataFrame, q: DataFrame, kernel: Kernel, n: int, left: int, right: int) -> DataFrame:
    """id, x, v: ``K q``."""
    y = kernel_product(points, q, kernel, n, left, right, getattr(kernel, "reach", float("inf")))
    return cut_lineage(points.join(y, "id").select("id", "x", F.col("y").alias("v")))


def randomised_eigen(points: DataFrame, kernel: Kernel, k: int, oversample: int = 10, power: int = 1, seed: int = 42,
                     left: int = LEFT, right: int = RIGHT) -> tuple[np.ndarray, DataFrame]:
    """(leading eigenvalues, id, x = mode row) of the covariance of ``points(id, x)``.

    A random sketch of ``k + oversample`` columns, ``power`` subspace iterations, then the small
    eigenproblem of the projected covariance.
    """
    points = cut_lineage(points.select("id", "x"))
    n = points.count()
    width = min(k + oversample, n)
    q = map_blocks(points, ["id", "x"], "id bigint, x array<double>, v array<double>",
                   lambda b: [b.column("id"), b.column("x"), list_column(normals(b.column("id").to_numpy(), seed, width))])
    for _ in range(power + 1):
        q = _orthonormal(_applied(points, q, kernel, n, left, right), width)
    width = len(q.select("v").first()["v"])
    both = cut_lineage(q.join(_applied(points, q, kernel, n, left, right).select("id", F.col("v").alias("w")), "id"))
    small = collect_matrix(sum_blocks(both, ["v", "w"], (width, width), lambda b: block(b, "v").T @ block(b, "w")), (width, width))
    lam, turn = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(lam)[::-1][:k]
    modes = map_blocks(q, ["id", "v"], "id bigint, x array<double>",
                       lambda b: [b.column("id"), list_column(block(b, "v") @ turn[:, top])])
    return lam[top], modes


def direct_qr(points: DataFrame, kernel: Kernel, k: int, pool: int = 64, left: int = LEFT, right: int = RIGHT) -> Picks:
    """Column-pivoted QR of the covariance itself, ties to the lowest id.

    Squared column norms are row sums of the squared covariance.  A pass takes the ``pool`` columns of
    largest residual, forms their products with all columns, and picks among them while the best
    is above every residual outside; residuals never rise, so these are the picks of one pass
    per pivot.  The factor's entries stay with their points.
    """
    points = cut_lineage(points.select("id", "x"))
    n = points.count()
    reach = getattr(kernel, "reach", float("inf"))
    ones = points.withColumn("v", F.array(F.lit(1.0)))
    norms = kernel_product(points, ones, lambda a, b: kernel(a, b) ** 2, n, left, right, reach)
    state = cut_lineage(points.join(norms, "id").select("id", "x", F.col("y")[0].alias("res"), F.array().cast("array<double>").alias("l")))
    ids: list[int] = []
    rows: list[np.ndarray] = []
    scores: list[float] = []
    while len(ids) < k:
        free = state.where(~F.col("id").isin(ids)) if ids else state
        top = free.orderBy(F.desc(F.round("res", ROUND)), "id").limit(pool + 1).toPandas()
        if top.empty:
            break
        outside = round(float(top["res"].iloc[pool]), ROUND) if len(top) > pool else -np.inf
        top = top.iloc[:pool]
        cand, x = top["id"].to_numpy(), np.stack(top["x"].to_numpy())
        columns = map_blocks(points, ["id", "x"], "id bigint, x array<double>, v array<double>",
                             lambda b, x=x: [b.column("id"), b.column("x"), list_column(kernel(block(b, "x"), x))])
        products = cut_lineage(kernel_product(points, columns, kernel, n, left, right, reach))
        mine = products.where(F.col("id").isin(cand.tolist())).toPandas().set_index("id")["y"]
        g = np.stack([mine[i] for i in cand])
        factor = np.stack(top["l"].to_numpy()).astype(float).reshape(len(cand), -1)
        picked = _picked_columns(cand, g, factor, top["res"].to_numpy(), outside, k - len(ids))
        if not picked:
            break
        for at, score in picked:
            ids.append(int(cand[at])), rows.append(x[at]), scores.append(score)
        state = _grown(state, products, factor, [at for at, _ in picked], g)
    return Picks(np.array(ids, "i8"), np.array(rows), np.array(scores))


def _column(g: np.ndarray, factor: np.ndarray, pivot_row: np.ndarray, square: float) -> np.ndarray:
    """Next column of the factor from products with the pivot and the factor so far."""
    return (g - factor @ pivot_row) / np.sqrt(square)


def _picked_columns(cand, g, factor, res, outside: float, k: int) -> list[tuple[int, float]]:
    res, out, free = res.astype(float).copy(), [], np.ones(len(cand), bool)
    while len(out) < k and free.any():
        s = np.where(free, np.round(res, ROUND), -np.inf)
        at = int(np.lexsort((cand, -s))[0])
        if (out and s[at] <= outside) or s[at] <= 0:
            break
        new = _column(g[:, at], factor, factor[at], res[at])
        factor = np.column_stack([factor, new])
        out.append((at, float(s[at])))
        res, free[at] = res - new**2, False
    return out


def _grown(state: DataFrame, products: DataFrame, factor: np.ndarray, picked: list[int], g: np.ndarray) -> DataFrame:
    """``state`` with the factor's new entries and the residuals that are left."""
    chain, f = [], factor
    for at in picked:  # pivot rows as they were at the time of picking
        square = g[at, at] - f[at] @ f[at]
        chain.append((at, f[at].copy(), square))
        f = np.column_stack([f, _column(g[:, at], f, f[at], square)])

    def run(batches: Batches) -> Batches:
        for b in batches:
            if not b.num_rows:
                continue
            y, l, res = block(b, "y"), block(b, "l"), b.column("res").to_numpy(zero_copy_only=False).copy()
            for at, row, square in chain:
                new = _column(y[:, at], l, row, square)
                l = np.column_stack([l, new])
                res = res - new**2
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(np.maximum(res, 0.0)), list_column(l)], ["id", "x", "res", "l"])

    joined = state.join(products, "id").select("id", "x", "res", "l", "y")
    return cut_lineage(joined.mapInArrow(run, "id bigint, x array<double>, res double, l array<double>"))
