"""Residual quantisers as Column expressions.

Two contracts, never mixed:

* range quantiser: bin width ``2*ab/num_bins``; values whose bin reaches ``num_bins/2``
  are outliers, stored as float32;
* error quantiser: bin width ``2*eb``, unbounded, error at most ``eb``.

Bins are BIGINT, so large residuals never wrap and ``-0.0`` cannot appear.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_bin_raw(v: Column, ab: float, num_bins: int) -> Column:
    return F.rint(v / F.lit(2.0 * ab / num_bins)).cast("bigint")


def range_is_outlier(v: Column, ab: float, num_bins: int) -> Column:
    return F.abs(range_bin_raw(v, ab, num_bins)) >= num_bins // 2


def range_bin(v: Column, ab: float, num_bins: int, outlier: str = "zero") -> Column:
    """Stored bin; outliers become 0 (``zero``) or are clipped (``clip``)."""
    raw, half = range_bin_raw(v, ab, num_bins), num_bins // 2
    if outlier == "zero":
        return F.when(F.abs(raw) >= half, F.lit(0).cast("bigint")).otherwise(raw)
    if outlier == "clip":
        limit = F.lit(half - 1).cast("bigint")
        return F.greatest(-limit, F.least(limit, raw))
    raise ValueError(outlier)


def range_dequantise(v: Column, ab: float, num_bins: int) -> Column:
    kept = v.cast("float").cast("double")
    width = F.lit(2.0 * ab / num_bins)
    return F.when(range_is_outlier(v, ab, num_bins), kept).otherwise(
        range_bin_raw(v, ab, num_bins) * width
    )


def error_bin(v: Column, eb) -> Column:
    return F.rint(F.coalesce(v, F.lit(0.0)) / (eb * 2.0)).cast("bigint")


def error_dequantise(bin_: Column, eb) -> Column:
    return bin_ * (eb * 2.0)


def laplacian_bin(v: Column, scale: Column, ab: float, num_bins: int) -> Column:
    """Equal-probability bins under a Laplacian of the given scale; outliers become 0."""
    p = F.signum(v) * (1.0 - F.exp(-F.abs(v) / scale)) * 0.5
    limit = F.lit(num_bins // 2 - 1).cast("bigint")
    idx = F.rint(p * num_bins).cast("bigint")
    clipped = F.greatest(-limit, F.least(limit, idx))
    return F.when(F.abs(v) > ab, F.lit(0).cast("bigint")).otherwise(clipped)


def laplacian_dequantise(v: Column, bin_: Column, scale: Column, ab: float, num_bins: int) -> Column:
    tiny = 1e-15
    p = F.greatest(F.lit(tiny), F.least(F.lit(1 - tiny), bin_ / num_bins + 0.5))
    d = F.least(F.abs(p - 0.5), F.lit(0.5 - tiny))
    x = F.signum(p - 0.5) * (-scale * F.log1p(d * -2.0))
    return F.when(F.abs(v) > ab, v).otherwise(x).cast("float").cast("double")
