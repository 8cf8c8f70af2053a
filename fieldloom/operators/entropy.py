"""Entropy and coded-size accounting over quantised bins."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_counts(df: DataFrame, by: Sequence[str], bin_: str = "bin") -> DataFrame:
    return df.groupBy(*by, bin_).agg(F.count(F.lit(1)).alias("n"))


def entropy_of(count: Column) -> Column:
    """Shannon entropy (bits per symbol) from per-bin counts, as one aggregate.

    ``log2(N) - sum(c*log2 c)/N`` needs no second look at the total, so no join or
    window is planned.
    """
    total = F.sum(count)
    h = F.log2(total) - F.sum(count * F.log2(count)) / total
    return F.greatest(h, F.lit(0.0))


def entropy_by(df: DataFrame, by: Sequence[str], bin_: str = "bin") -> DataFrame:
    """n, n_unique and entropy of ``bin_`` per group."""
    return (
        bin_counts(df, by, bin_)
        .groupBy(*by)
        .agg(
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("n_unique"),
            entropy_of(F.col("n")).alias("entropy"),
        )
    )


def huffman_bytes_codebook(n: Column, entropy: Column, n_unique: Column) -> Column:
    """Whole bytes of the entropy-coded stream plus 3 bytes per symbol and a 10-byte header."""
    stream = F.floor((F.ceil(F.round(entropy * n, 6)) + 7) / 8)
    return (stream + n_unique * 3 + 10).cast("bigint")


def huffman_bytes_flat(n: Column, entropy: Column) -> Column:
    """Entropy-coded stream plus a flat 64-byte overhead."""
    return (F.ceil(F.round(n * entropy / 8, 6)) + 64).cast("bigint")
