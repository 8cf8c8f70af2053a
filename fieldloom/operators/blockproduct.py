"""Products of a location table with coefficient rows, both of any length.

Every decoder ends in ``features(location) @ coefficients(item)`` for all locations and all items
(snapshots or volumes).  Locations are gathered into tiles, items into blocks, and each (tile, block)
pair is one product inside an executor: nothing passes through the driver.  Blocks are sent
to the tiles, or, where the location table is of a checked small size, tiles are broadcast to
the blocks; either way a pair makes at most ``CELLS`` values at a time, and pairs are dealt to tasks by
their number, ``PAIRS`` to a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import sized_broadcast
from fieldloom.sources.profiles import block

TILE = 1024
CELLS = 1 << 20
PAIRS = 4

Finish = Callable[[pa.RecordBatch, np.ndarray], np.ndarray]


def tiles_of(table: DataFrame, columns: Sequence[str], tile: int) -> DataFrame:
    """tile, cells: the rows of a location table, ``tile`` neighbouring locations at a time."""
    row = F.struct("loc", *[c for c in columns if c != "loc"])
    return table.groupBy(F.expr(f"loc div {tile}").alias("tile")).agg(F.collect_list(row).alias("cells"))


def blocks_of(coefs: DataFrame, n_items: int, size: int) -> DataFrame:
    """block, items: coefficient rows (item, c) dealt evenly over blocks of about ``size`` items."""
    count = max(1, -(-n_items // size))
    block_ = F.pmod(F.xxhash64("item"), F.lit(count)).alias("block")
    return coefs.groupBy(block_).agg(F.collect_list(F.struct("item", "c")).alias("items"))


def block_product(
    table: DataFrame, columns: Sequence[str], n_locs: int, features: Callable[[pa.RecordBatch], np.ndarray],
    coefs: DataFrame, n_items: int, parts: int = 1, finish: Finish | None = None, row_bytes: int = 1024,
    tile: int = TILE, cells: int = CELLS, names: Sequence[str] | None = None,
) -> DataFrame:
    """item, part, loc, value; with ``names`` item, loc and one column per part.

    ``coefs`` has (item bigint, c array<double>), where ``c`` holds ``parts`` runs of as many numbers as
    ``features`` gives columns.  ``finish`` turns a product of (locations, parts, items) into values, given
    the tile's rows.
    """
    size = max(1, cells // (tile * parts))
    blocks = blocks_of(coefs, n_items, size)
    last, count = max(0, n_locs - 1) // tile, max(1, -(-n_items // size))
    sent = blocks.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(last)).cast("array<bigint>")))
    tasks = -(-(last + 1) * count // PAIRS)
    sent = sent.repartitionById(tasks, ((F.col("tile") * count + F.col("block")) % tasks).cast("int"))
    pairs = sent.join(sized_broadcast(tiles_of(table, columns, tile), n_locs, row_bytes), "tile").select("cells", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = pa.RecordBatch.from_struct_array(batch.column("cells")[i].values)
                items = pa.RecordBatch.from_struct_array(batch.column("items")[i].values)
                left, loc = features(rows), rows.column("loc").to_numpy()
                step = max(1, cells // (len(loc) * parts))
                for low in range(0, items.num_rows, step):
                    part = items.slice(low, step)
                    right = block(part, "c").reshape(part.num_rows, parts, -1)
                    value = np.einsum("mr,lpr->mpl", left, right, optimize=True)
                    value = finish(rows, value) if finish else value
                    m, p, n = value.shape
                    if names:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.tile(part.column("item").to_numpy(), m)), pa.array(np.repeat(loc, n)),
                             *(pa.array(value[:, i].ravel()) for i in range(p))], ["item", "loc", *names])
                        continue
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(part.column("item").to_numpy(), m * p)), pa.array(np.tile(np.repeat(np.arange(p), n), m)),
                         pa.array(np.repeat(loc, p * n)), pa.array(value.ravel())], ["item", "part", "loc", "value"])

    wide = names and ", ".join(["item bigint", "loc bigint", *(f"`{c}` double" for c in names)])
    return pairs.mapInArrow(run, wide or "item bigint, part bigint, loc bigint, value double")
