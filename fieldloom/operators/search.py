"""Search of the error bound that meets a compression ratio."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from fieldloom.operators.ratedist import Predictor, sweep


def fixed_rate_bits(target: float) -> float:
    """Fixed-rate codec: bits per value that give the ratio exactly."""
    return 32.0 / target


def search_bound(
    cells: DataFrame, value: str, predictor: Predictor, target: float,
    lo: float, hi: float, probes: int = 9, passes: int = 3,
) -> DataFrame:
    """Log-spaced probes in one sweep per pass; each pass narrows to the bracket around
    ``target``, so three scans replace a few dozen bisection runs."""
    best = None
    for _ in range(passes):
        step = (math.log(hi) - math.log(lo)) / (probes - 1)
        grid = [math.exp(math.log(lo) + i * step) for i in range(probes)]
        rows = sweep(cells, value, [predictor], grid).select("abs_bound", "cr", "psnr").collect()
        rows.sort(key=lambda r: r["abs_bound"])
        for r in rows:
            if best is None or abs(r["cr"] - target) < abs(best["cr"] - target):
                best = r
        below = [r["abs_bound"] for r in rows if r["cr"] < target]
        above = [r["abs_bound"] for r in rows if r["cr"] >= target]
        if not below or not above:
            break
        lo, hi = max(below), min(above)
        if lo >= hi:
            break
    return cells.sparkSession.createDataFrame(
        [(float(target), best["abs_bound"], best["cr"], best["psnr"])],
        "target double, abs_bound double, cr double, psnr double",
    )
