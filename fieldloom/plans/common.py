"""Inputs shared by several query areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.sources.grid import residual_field

SENSORS = 5


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def energetic_locations(spark: SparkSession, sf: str, k: int = SENSORS) -> DataFrame:
    """The k locations with the largest residual energy: rank, loc, y, x, mu."""
    top = (
        residual_field(spark, sf)
        .groupBy("loc", "y", "x", "mu")
        .agg(F.round(F.sum(F.col("resid") * F.col("resid")), 3).alias("_e"))
        .orderBy(F.desc("_e"), "loc")
        .limit(k)
    )
    # k rows only
    rank = (F.row_number().over(Window.orderBy(F.desc("_e"), "loc")) - 1).cast("bigint")
    return top.select(rank.alias("rank"), "loc", "y", "x", "mu")
