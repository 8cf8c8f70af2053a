"""Profile layout: one row per location holding its values over all levels.

With few levels and many locations this turns every dense step (Gram matrix, basis
projection, reconstruction, Kriging weights) into a narrow pass over rows.
"""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.grid import NX


def profiles(cells: DataFrame, n_levels: int, value: str = "value") -> DataFrame:
    """loc, y, x, n_obs_levels, mu, sd, vec, seen.

    ``vec`` is centred by the location mean ``mu``; absent levels hold 0, which is the
    mean, and are false in ``seen``, so that scores can leave them out.  ``sd`` is the population deviation with the 1e-10 guard set to 1.
    A location has at most one entry per level, so the gathered group is bounded.
    """
    g = cells.groupBy("loc").agg(
        F.count(value).alias("n_obs_levels"),
        F.avg(value).alias("mu"),
        F.stddev_pop(value).alias("_sd"),
        F.array_sort(F.collect_list(F.struct("level", F.col(value).alias("v")))).alias("_e"),
    )
    # complete profiles are read off in order; only gappy ones look levels up
    dense = F.transform("_e", lambda e: e["v"] - F.col("mu"))
    gappy = F.transform(
        F.sequence(F.lit(0), F.lit(n_levels - 1)),
        lambda l: F.coalesce(F.try_element_at("_m", l.cast("bigint")) - F.col("mu"), F.lit(0.0)),
    )
    g = g.withColumn("_m", F.when(F.size("_e") < n_levels, F.map_from_entries("_e")))
    return g.select(
        "loc", F.expr(f"loc div {NX}").alias("y"), (F.col("loc") % NX).alias("x"), "n_obs_levels", "mu",
        F.when(F.col("_sd") < 1e-10, 1.0).otherwise(F.col("_sd")).alias("sd"),
        F.when(F.size("_e") == n_levels, dense).otherwise(gappy).alias("vec"),
        F.when(F.size("_e") == n_levels, F.array_repeat(F.lit(True), n_levels)).otherwise(
            F.transform(F.sequence(F.lit(0), F.lit(n_levels - 1)), lambda l: F.map_contains_key("_m", l.cast("bigint")))
        ).alias("seen"),
    )


def block(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """Fixed-length list column as a 2-D array."""
    col = batch.column(name)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 0)


def scalar(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def list_column(matrix: np.ndarray) -> pa.Array:
    """2-D array as a list column."""
    m = np.ascontiguousarray(matrix, dtype=np.float64)
    offsets = np.arange(0, m.size + 1, max(m.shape[1], 1), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel()))


def map_blocks(
    df: DataFrame, columns: Sequence[str], schema: str,
    fn: Callable[[pa.RecordBatch], Sequence[pa.Array]],
) -> DataFrame:
    """Narrow per-batch numpy map: ``fn`` gets the named columns, returns output arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in out],
                                                 names=names)

    names = [part.strip().split()[0] for part in schema.split(",")]
    return df.select(*columns).mapInArrow(run, schema)


def add_block_column(
    df: DataFrame, name: str, fn: Callable[[pa.RecordBatch], np.ndarray]
) -> DataFrame:
    """``df`` with one more DOUBLE column computed per Arrow batch."""
    keep = df.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{name}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in keep), pa.array(fn(b))], names=[*keep, name]
                )

    return df.mapInArrow(run, schema)


def sum_blocks(
    df: DataFrame, columns: Sequence[str], shape: tuple[int, int],
    fn: Callable[[pa.RecordBatch], np.ndarray], least: float | None = None,
) -> DataFrame:
    """Element-wise sum over all rows of small matrices ``fn(batch)``: ``i, j, v``.

    Each task adds up its own batches first and ships one matrix, with ``least`` only its entries of a
    larger magnitude.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += fn(b)
        if least is not None:
            i, j = np.nonzero(np.abs(total) > least)
            total = total[i, j]
        else:
            i, j = np.indices(shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel().astype("i8")), pa.array(j.ravel().astype("i8")), pa.array(total.ravel())],
            names=["i", "j", "v"],
        )

    partial = df.select(*columns).mapInArrow(run, "i bigint, j bigint, v double")
    return partial.groupBy("i", "j").agg(F.sum("v").alias("v"))


def collect_matrix(ijv: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Bring a small ``i, j, v`` matrix to the driver."""
    out = np.zeros(shape)
    pdf = ijv.toPandas()
    out[pdf["i"], pdf["j"]] = pdf["v"]
    return out
