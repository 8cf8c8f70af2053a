"""A distributed count-min sketch of digests that tells which may occur twice.

Two rows of counters that saturate at two.  Tasks send the counters they touched, compressed and
cut into segments; every segment is merged as a stream by one task in bounded memory; the merged
bitmaps (counters at two) have at most ``MAX_COUNTERS`` bits a row, the proven bound of the
broadcast.  An estimate never falls short, so nothing that occurs twice is missed; beyond the
bound the filter lets more through and the exact pass after it does more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame

from fieldloom.llm.shared import Batches
from fieldloom.llm.text import mix

SEGMENT_BITS = 16  # counters of a segment, as a power of two
MAX_COUNTERS = 1 << 29  # 128 MB for both rows in every task; raise it with the executors' memory
CELLS = {"row": "int", "segment": "long", "cells": "binary"}


def counters_for(expected: float) -> int:
    """Number of counters, the power of two next to five for each of so many digests."""
    return min(MAX_COUNTERS, 1 << max(10, round(math.log2(max(1.0, 5 * expected)))))


def _cells(digest: np.ndarray, counters: int) -> list[np.ndarray]:
    mask = np.uint64(counters - 1)
    return [digest & mask, mix(digest) & mask]


def counted(digest: np.ndarray, counters: int) -> dict:
    """Columns of ``CELLS``: the counters that these digests touch, per row and segment."""
    size = min(counters, 1 << SEGMENT_BITS)
    out: dict[str, list] = {"row": [], "segment": [], "cells": []}
    pack = zstandard.ZstdCompressor(level=1)
    for row, cell in enumerate(_cells(digest, counters)):
        cell = np.sort(cell)
        first = np.append(True, cell[1:] != cell[:-1])[: cell.size]
        twice = np.append(~first[1:], False)[: cell.size][first]
        cell = cell[first]
        segment = (cell // np.uint64(size)).astype(np.int64)
        border = np.append(np.flatnonzero(np.diff(segment, prepend=-1)), segment.size)
        place = (cell % np.uint64(size)).astype(np.int64)
        for a, b in zip(border, border[1:]):
            raw = np.diff(place[a:b], prepend=0).astype("<u2").tobytes() + np.packbits(twice[a:b]).tobytes()
            out["row"].append(row)
            out["segment"].append(int(segment[a]))
            out["cells"].append(pack.compress(np.uint32(b - a).tobytes() + raw))
    return {"row": pa.array(out["row"], pa.int32()), "segment": pa.array(out["segment"], pa.int64()),
            "cells": pa.array(out["cells"], pa.binary())}


def merged(cells: DataFrame, counters: int) -> Broadcast:
    """Bitmaps of the counters that reach two, for both rows."""
    size = min(counters, 1 << SEGMENT_BITS)

    def merge(key: tuple[pa.Scalar, ...], batches: Batches) -> Batches:
        tally = np.zeros(size, np.uint8)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for packed in batch.column("cells").to_pylist():
                raw = unpack.decompress(packed)
                n = int(np.frombuffer(raw, "<u4", 1)[0])
                place = np.cumsum(np.frombuffer(raw, "<u2", n, 4).astype(np.int64))
                twice = np.unpackbits(np.frombuffer(raw, np.uint8, -1, 4 + 2 * n), count=n)
                tally[place] = np.minimum(tally[place] + 1 + twice, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()),
             pa.array([np.packbits(tally > 1).tobytes()], pa.binary())], names=["row", "segment", "bits"])

    bits = cells.groupBy("row", "segment").applyInArrow(merge, "row int, segment long, bits binary")
    maps = np.zeros((2, counters // 8), np.uint8)
    for r in bits.toLocalIterator():
        maps[r["row"], r["segment"] * size // 8 : (r["segment"] + 1) * size // 8] = np.frombuffer(r["bits"], np.uint8)
    return cells.sparkSession.sparkContext.broadcast(maps)


def maybe_twice(maps: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """False where a digest was certainly met once."""
    hit = np.ones(digest.size, bool)
    for row, cell in enumerate(_cells(digest, maps.shape[1] * 8)):
        cell = cell.astype(np.int64)
        hit &= (maps[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return hit
