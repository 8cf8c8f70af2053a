"""Raw little-endian float32 volumes (level, y, x in C order, no header)."""

from __future__ import annotations

import math
import os
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "level bigint, y bigint, x bigint, value float, loc bigint"


class _Rows(InputPartition):
    def __init__(self, level: int, y_lo: int, y_hi: int):
        self.level, self.y_lo, self.y_hi = level, y_lo, y_hi


class _Reader(DataSourceReader):
    """Each task seeks to its own run of rows; levels and strided rows that are not
    wanted are never read."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.shape = tuple(int(v) for v in options["shape"].split(","))
        self.stride = int(options.get("stride", "1"))
        self.skip = int(options.get("skip_levels", "0"))
        self.level = options.get("level")
        self.rows_per_task = int(options.get("rows_per_task", "1000"))
        expected = 4 * math.prod(self.shape)
        if os.path.getsize(self.path) != expected:
            raise ValueError(f"{self.path}: size does not match shape {self.shape}")

    def partitions(self):
        nl, ny, _ = self.shape
        levels = [int(self.level)] if self.level is not None else range(self.skip, nl)
        step = self.rows_per_task
        return [_Rows(l, y, min(y + step, ny)) for l in levels for y in range(0, ny, step)]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        _, ny, nx = self.shape
        first = -(-part.y_lo // self.stride) * self.stride
        with open(self.path, "rb") as f:
            for y in range(first, part.y_hi, self.stride):
                f.seek(4 * nx * (part.level * ny + y))
                row = np.frombuffer(f.read(4 * nx), "<f4")[:: self.stride]
                n = len(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part.level, "i8")), pa.array(np.full(n, y // self.stride, "i8")),
                     pa.array(np.arange(n, dtype="i8")), pa.array(row.astype("f4")),
                     pa.array(np.arange(n, dtype="i8") + (y // self.stride) * n)],
                    names=["level", "y", "x", "value", "loc"],
                )


class RawVolumeSource(DataSource):
    """``spark.read.format("rawf32")`` with options shape, stride, skip_levels, level."""

    @classmethod
    def name(cls) -> str:
        return "rawf32"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_volume(
    spark: SparkSession, path: str, shape: tuple[int, int, int], stride: int = 1,
    skip_levels: int = 0, level: int | None = None,
) -> DataFrame:
    """Scan one raw volume; the file must sit on storage every executor can read."""
    spark.dataSource.register(RawVolumeSource)
    reader = spark.read.format("rawf32").option("shape", ",".join(map(str, shape)))
    reader = reader.option("stride", stride).option("skip_levels", skip_levels)
    if level is not None:
        reader = reader.option("level", level)
    return reader.load(path)


def read_variables(
    spark: SparkSession, paths: dict[str, str], shape: tuple[int, int, int], **kw
) -> DataFrame:
    """Several volumes in long form, tagged with the variable name."""
    frames = [
        read_volume(spark, p, shape, **kw).withColumn("var", F.lit(v)) for v, p in paths.items()
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def pack_f32(values: Column, *header: Column) -> Column:
    """Little-endian int32 header words followed by float32 payload."""

    @F.pandas_udf("binary")
    def pack(head: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([
            np.asarray(h, "<i4").tobytes() + np.asarray(b, "<f4").tobytes()
            for h, b in zip(head, body)
        ])

    return pack(F.array(*[h.cast("int") for h in header]) if header else F.array().cast("array<int>"), values)


def unpack_f32(blob: Column, header_words: int) -> Column:
    """Inverse of :func:`pack_f32`: ``struct(header array<int>, payload array<float>)``."""

    @F.pandas_udf("header array<int>, payload array<float>")
    def unpack(blobs: pd.Series) -> pd.DataFrame:
        cut = 4 * header_words
        return pd.DataFrame({
            "header": [np.frombuffer(b[:cut], "<i4") for b in blobs],
            "payload": [np.frombuffer(b[cut:], "<f4") for b in blobs],
        })

    return unpack(blob)
