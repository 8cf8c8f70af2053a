"""Order-dependent operators over one very long sequence.

A global ``lag`` would order everything in a single task.  The order key is cut into
ranges instead: each range is handled on its own and hands the last value to the next
non-empty one.  The hand-over is itself such a sequence, one row per range, and is
treated the same way, so what is finally ordered globally is smaller by the square of
the range width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE = 100_000


def previous_in_order(
    df: DataFrame, order: str, value: str, out: str, width: int = RANGE, levels: int = 2
) -> DataFrame:
    """Add the value preceding each row in ``order`` (unique integer key, gaps allowed)."""
    if levels == 0:
        return df.withColumn(out, F.lag(value).over(Window.orderBy(order)))
    r, first = f"_r{levels}", f"_first{levels}"
    cut = df.withColumn(r, F.floor(F.col(order) / width))
    within = Window.partitionBy(r).orderBy(order)
    tails = cut.groupBy(r).agg(F.max_by(value, order).alias("_tail"))
    # already partitioned by the range, so the join adds no shuffle of the long side
    carry = previous_in_order(tails, r, "_tail", f"_carry{levels}", width, levels - 1).drop("_tail")
    return (
        cut.withColumn(first, F.row_number().over(within) == 1)
        .withColumn(out, F.lag(value).over(within))
        .join(carry, r)
        .withColumn(out, F.when(F.col(first), F.col(f"_carry{levels}")).otherwise(F.col(out)))
        .drop(r, first, f"_carry{levels}")
    )
