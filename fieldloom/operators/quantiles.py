"""Exact quantiles that never gather a group into one task.

Spark's exact ``percentile`` merges every distinct value of a group into one buffer,
which a level or a whole field outgrows.  Here a mergeable sketch brackets each
requested rank, one aggregate counts what lies below the bracket and in each of ``BINS``
equal ranges inside it, and only the values of the range that holds the rank are ordered.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.session import sized_broadcast

ACCURACY = 10_000
SLACK = 4.0 / ACCURACY
BINS = 4096  # equal value ranges of a bracket, so that no task orders a whole bracket


def exact_quantiles(
    df: DataFrame, value: Column | str, probs: Sequence[float], by: Sequence[str] = (),
    groups: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles: ``*by, p, q``.

    ``groups`` is the caller's bound on the number of groups; where it keeps the brackets
    small they are joined back by broadcast, otherwise by a shuffle.
    """
    by = list(by)
    v = F.col(value) if isinstance(value, str) else value
    base = df.select(F.lit(0).alias("_g"), *by, v.cast("double").alias("_v")).where(
        F.col("_v").isNotNull()
    )
    keys = ["_g", *by]
    wanted = sorted(set(probs))
    lo = [max(p - SLACK, 0.0) for p in wanted]
    hi = [min(p + SLACK, 1.0) for p in wanted]
    # below this size neighbouring ranks are further apart than the slack
    small = F.col("_n") <= 2 * ACCURACY

    brackets = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", lo, ACCURACY).alias("_lo"),
        F.percentile_approx("_v", hi, ACCURACY).alias("_hi"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    ).select(
        *keys, "_n",
        F.array(*[
            F.struct(
                F.lit(p).alias("p"),
                F.when(small | F.lit(l == 0.0), F.col("_min")).otherwise(F.col("_lo")[i]).alias("lo"),
                F.when(small | F.lit(h == 1.0), F.col("_max")).otherwise(F.col("_hi")[i]).alias("hi"),
            )
            for i, (p, l, h) in enumerate(zip(wanted, lo, hi))
        ]).alias("_b"),
    )

    bound = groups if by else 1
    joined = base.join(sized_broadcast(brackets, bound, 64 * (len(wanted) + 1)), keys)
    # Per row only the brackets it lies in survive; rows below one are counted.
    tagged = joined.select(
        *keys, "_n", "_v", F.explode("_b").alias("_t")
    ).select(
        *keys, "_n", F.col("_t.p").alias("p"),
        F.when(F.col("_v") >= F.col("_t.lo"), F.col("_v")).alias("_v"),
        (F.col("_v") > F.col("_t.hi")).alias("_above"), F.col("_t.lo").alias("_low"),
        (F.col("_t.hi") - F.col("_t.lo")).alias("_width"),
    ).where(~F.col("_above"))
    spread = (F.col("_width") > 0) & (F.col("_width") < float("inf"))
    place = F.least(F.floor((F.col("_v") - F.col("_low")) / F.col("_width") * BINS), F.lit(BINS - 1))
    # Rows below the bracket are bin -1, so they open the running count.
    bin_ = F.when(F.col("_v").isNull(), -1).when(spread, place).otherwise(0).cast("int")
    counted = tagged.withColumn("_bin", bin_).groupBy(*keys, "p", "_n", "_bin", "_v").agg(F.count(F.lit(1)).alias("_c"))
    pos = F.col("p") * (F.col("_n") - 1)
    lo_rank, hi_rank = F.floor(pos), F.ceil(pos)

    def running(*parts: str, by: str) -> Window:
        return Window.partitionBy(*keys, "p", *parts).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    bins = counted.groupBy(*keys, "p", "_n", "_bin").agg(F.sum("_c").alias("_c"))
    bins = bins.withColumn("_before", F.sum("_c").over(running(by="_bin")) - F.col("_c"))
    bins = bins.where((F.col("_before") <= hi_rank) & (lo_rank < F.col("_before") + F.col("_c")))
    ranked = counted.join(bins.select(*keys, "p", "_bin", "_before"), [*keys, "p", "_bin"])
    ranked = ranked.withColumn("_end", F.col("_before") + F.sum("_c").over(running("_bin", by="_v"))).withColumn(
        "_start", F.col("_end") - F.col("_c")
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v")))

    return (
        ranked.where((F.col("_start") <= hi_rank) & (lo_rank < F.col("_end")))
        .groupBy(*keys, "p")
        .agg(at(lo_rank).alias("_a"), at(hi_rank).alias("_z"), F.max(pos - lo_rank).alias("_f"))
        .select(*by, "p", (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f")).alias("q"))
    )


def quantile_row(df: DataFrame, value: Column | str, **named: float) -> DataFrame:
    """One-row frame with a named exact quantile per keyword."""
    q = exact_quantiles(df, value, list(named.values()))
    return q.agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for n, p in named.items()])
