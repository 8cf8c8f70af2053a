"""Gridded field derived from the order lines.

One cell per (ship month, supplier): ``level`` is the vertical axis, ``loc`` the
flat horizontal index with ``y = loc div NX`` and ``x = loc % NX``.  Cell means are
integer cent sums over counts, so they do not depend on summation order.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.sources.tables import table

NX = 10
FIRST_YEAR = 1995
FIELDS = ("value", "f_quantity", "f_discount")


class GridShape(NamedTuple):
    n_levels: int
    n_locs: int

    @property
    def ny(self) -> int:
        return -(-self.n_locs // NX)


def month_index(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts) - (FIRST_YEAR * 12 + 1)).cast("bigint")


def grid_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """level, loc, y, x, value, f_quantity, f_discount, n_obs."""
    lines = table(spark, sf_dir, "lineitem")

    def exact_mean(name: str, scale: int) -> Column:
        # nearest hundredth or unit; rint stays a primitive operation in generated code
        total = F.sum(F.rint(F.col(name) * scale).cast("bigint")).cast("double")
        mean = total / F.count(F.lit(1))
        return mean / scale if scale != 1 else mean

    cells = lines.groupBy(
        month_index(F.col("l_shipdate")).alias("level"), F.col("l_suppkey").alias("loc")
    ).agg(
        exact_mean("l_extendedprice", 100).alias("value"),
        exact_mean("l_quantity", 1).alias("f_quantity"),
        exact_mean("l_discount", 100).alias("f_discount"),
        F.count(F.lit(1)).alias("n_obs"),
    )
    return cells.select(
        "level", "loc",
        F.expr(f"loc div {NX}").alias("y"),
        (F.col("loc") % NX).alias("x"),
        *FIELDS, "n_obs",
    )


@lru_cache(maxsize=64)
def _shape(_app: str, spark: SparkSession, sf_dir: str) -> GridShape:
    row = (
        table(spark, sf_dir, "lineitem")
        .agg(
            F.max(month_index(F.col("l_shipdate"))).alias("l"),
            F.max("l_suppkey").alias("s"),
        )
        .first()
    )
    return GridShape(int(row["l"]) + 1, int(row["s"]) + 1)


def grid_shape(spark: SparkSession, sf_dir: str) -> GridShape:
    """Extent of the grid: one narrow two-column aggregate, remembered per session."""
    return _shape(spark.sparkContext.applicationId, spark, sf_dir)


def with_location_mean(cells: DataFrame, value: str = "value") -> DataFrame:
    """Add ``mu`` (mean over levels at a location) and ``resid = value - mu``.

    A location holds at most one cell per level, so the window partitions stay small
    however the raw rows are distributed.  The sum runs in level order: locations of equal
    values have equal means, to the last digit, and so have repeated runs.
    """
    here = Window.partitionBy("loc").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return cells.withColumn("mu", F.avg(value).over(here)).withColumn(
        "resid", F.col(value) - F.col("mu")
    )


def residual_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_location_mean(grid_field(spark, sf_dir))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as one long 1-D signal: idx, level, loc, kind, value."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("idx"),
        (F.dayofyear("ts") - 1).cast("bigint").alias("level"),
        F.col("user_id").alias("loc"),
        F.col("event_type").alias("kind"),
        "value",
    )
