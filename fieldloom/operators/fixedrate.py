"""Fixed-rate coding: blocks of 4 x 4 cells in exactly so many bits each.

A block is transformed by an orthonormal cosine transform in both directions and its coefficients are
scaled to whole numbers under the block's common exponent.  Coefficients of equal sequency (row plus
column frequency) are a group.  A block's bits are its exponent, the top bit plane of every group,
and then bit planes from the highest down, the groups of low sequency first, until the budget is used:
the rate is met whatever the data, and a reader needs the bits alone.  Signs stand with a group's top
plane.  Absent cells take the mean of their block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.grid import NX
from fieldloom.sources.profiles import list_column

SIDE = 4
CELLS = SIDE * SIDE
PLANES = 30  # bits of the largest coefficient
EXPONENT_BITS, TOP_BITS = 12, 5
_F = np.array([[np.sqrt((1 if k == 0 else 2) / SIDE) * np.cos(np.pi * (2 * i + 1) * k / (2 * SIDE)) for i in range(SIDE)] for k in range(SIDE)])
_SEQUENCY = np.add.outer(np.arange(SIDE), np.arange(SIDE)).ravel()
GROUPS = [np.flatnonzero(_SEQUENCY == s) for s in range(2 * SIDE - 1)]
HEADER = EXPONENT_BITS + TOP_BITS * len(GROUPS)
LEAST = -(-(HEADER + 1) // 8) * 8  # bits of the smallest block

Batches = Iterator[pa.RecordBatch]


def block_bits(rate: float) -> int:
    """Bits of a block at ``rate`` bits a value: whole bytes, at least a header and a sign."""
    return max(LEAST, int(rate * CELLS) // 8 * 8)


def _put(bits: np.ndarray, rows: np.ndarray, at: np.ndarray, values: np.ndarray, n: int) -> None:
    """Writes the ``n`` low bits of ``values``, high bit first, at place ``at`` of each row."""
    for k in range(n):
        bits[rows, at + k] = values >> (n - 1 - k) & 1


def _get(bits: np.ndarray, rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(rows.size, np.int64)
    for k in range(n):
        out = out << 1 | bits[rows, at + k]
    return out


def encode_blocks(values: np.ndarray, budget: int) -> np.ndarray:
    """(blocks, budget / 8) bytes of (blocks, 16) values."""
    n = len(values)
    coef = np.einsum("ki,bij,lj->bkl", _F, values.reshape(n, SIDE, SIDE), _F).reshape(n, CELLS)
    most = np.abs(coef).max(1)
    exponent = np.where(most > 0, np.frexp(np.maximum(most, 1e-300))[1], -(1 << EXPONENT_BITS - 1) + 1)
    scaled = np.rint(np.ldexp(coef, np.where(most > 0, PLANES - exponent, 0)[:, None])).astype(np.int64)
    size, sign = np.abs(scaled), (scaled < 0).astype(np.int64)
    bits = np.zeros((n, budget), np.int64)
    every = np.arange(n)
    _put(bits, every, np.zeros(n, np.int64), exponent + (1 << EXPONENT_BITS - 1), EXPONENT_BITS)
    tops = np.stack([np.frexp(size[:, g].max(1).astype(float))[1] for g in GROUPS], 1)  # planes in use
    for k in range(len(GROUPS)):
        _put(bits, every, np.full(n, EXPONENT_BITS + k * TOP_BITS), tops[:, k], TOP_BITS)
    for rows, at, group, plane, lead in _schedule(tops, budget):
        for c in GROUPS[group]:
            bits[rows, at] = size[rows, c] >> plane & 1
            at = at + 1
            if lead:
                bits[rows, at] = sign[rows, c]
                at = at + 1
    return np.packbits(bits.astype(np.uint8), axis=1)


def _schedule(tops: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int, bool]]:
    """(blocks, place, group, plane, whether signs follow), in the order of a block's bits: a group's
    plane is there as a whole or not at all, and nothing comes after the first that does not fit."""
    at = np.full(len(tops), HEADER)
    open_ = np.ones(len(tops), bool)
    for plane in range(PLANES, -1, -1):
        for k, group in enumerate(GROUPS):
            for lead in (True, False):
                due = open_ & ((tops[:, k] - 1 == plane) if lead else (tops[:, k] - 1 > plane))
                need = group.size * (2 if lead else 1)
                fits = at + need <= budget
                open_ &= ~(due & ~fits)
                rows = np.flatnonzero(due & fits)
                if rows.size:
                    yield rows, at[rows], k, plane, lead
                    at[rows] += need


def decode_blocks(data: np.ndarray) -> np.ndarray:
    """(blocks, 16) values from their bytes alone."""
    bits = np.unpackbits(data, axis=1).astype(np.int64)
    n, budget = bits.shape
    every = np.arange(n)
    exponent = _get(bits, every, np.zeros(n, np.int64), EXPONENT_BITS) - (1 << EXPONENT_BITS - 1)
    tops = np.stack([_get(bits, every, np.full(n, EXPONENT_BITS + k * TOP_BITS), TOP_BITS) for k in range(len(GROUPS))], 1)
    size, sign, last = np.zeros((n, CELLS), np.int64), np.zeros((n, CELLS), np.int64), np.zeros((n, CELLS), np.int64)
    for rows, at, group, plane, lead in _schedule(tops, budget):
        for c in GROUPS[group]:
            size[rows, c] |= bits[rows, at] << plane
            last[rows, c] = plane
            at = at + 1
            if lead:
                sign[rows, c] = bits[rows, at]
                at = at + 1
    middle = np.where(size > 0, np.where(last > 0, 1 << np.maximum(last - 1, 0), 0), 0)  # half of what was cut off
    coef = np.ldexp((size + middle) * np.where(sign == 1, -1.0, 1.0), (exponent - PLANES)[:, None])
    return np.einsum("ki,bkl,lj->bij", _F, coef.reshape(n, SIDE, SIDE), _F).reshape(n, CELLS)


def encode(cells: DataFrame, value: str, rate: float, nx: int = NX) -> DataFrame:
    """level, by, bx, data: the blocks of ``cells(level, loc, value)``, ``block_bits(rate)`` bits each."""
    budget = block_bits(rate)
    y, x = F.expr(f"loc div {nx}"), F.expr(f"loc % {nx}")
    place = (y % SIDE * SIDE + x % SIDE).cast("int")
    at = cells.where(F.col(value).isNotNull()).select("level", F.expr(f"loc div {nx} div {SIDE}").alias("by"), F.expr(f"loc % {nx} div {SIDE}").alias("bx"),
                                                      F.struct(place.alias("p"), F.col(value).cast("double").alias("v")).alias("c"))
    gathered = at.groupBy("level", "by", "bx").agg(F.collect_list("c").alias("c"))

    def run(batches: Batches) -> Batches:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("c")
            count = pa.compute.list_value_length(lists).to_numpy()
            of, flat = np.repeat(np.arange(b.num_rows), count), lists.flatten()
            p, v = flat.field("p").to_numpy(), flat.field("v").to_numpy()
            dense = np.repeat((np.bincount(of, weights=v) / count)[:, None], CELLS, 1)
            dense[of, p] = v
            data = encode_blocks(dense, budget)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("level", "by", "bx")), pa.array([r.tobytes() for r in data], pa.binary())],
                                             ["level", "by", "bx", "data"])

    return gathered.mapInArrow(run, "level bigint, by bigint, bx bigint, data binary")


def decode(blocks: DataFrame, nx: int = NX, ny: int | None = None) -> DataFrame:
    """level, loc, value of every cell of the blocks that lies on the grid."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            if b.num_rows:
                data = np.stack([np.frombuffer(r, np.uint8) for r in b.column("data").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("level", "by", "bx")), list_column(decode_blocks(data))], ["level", "by", "bx", "v"])

    wide = blocks.mapInArrow(run, "level bigint, by bigint, bx bigint, v array<double>")
    cells = wide.select("level", "by", "bx", F.posexplode("v").alias("p", "value"))
    y, x = F.expr(f"by * {SIDE} + p DIV {SIDE}"), F.expr(f"bx * {SIDE} + p % {SIDE}")
    on = cells.select("level", y.alias("_y"), x.alias("_x"), "value").where(F.col("_x") < nx)
    on = on.where(F.col("_y") < ny) if ny is not None else on
    return on.select("level", (F.col("_y") * nx + F.col("_x")).alias("loc"), "value")
