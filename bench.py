"""Headline timings: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the input and
the local parallelism.  A query's time covers planning and writing its full result to
the no-op sink; one small query warms the session first.
"""

from __future__ import annotations

import json
import os
import sys
import time

from fieldloom.plans import registry
from fieldloom.session import build_session

HEADLINE = [
    "rd_mean_predictor", "rd_sweep", "q08_entropy", "q24_lorenzo_codec", "l03_lorenzo_cube", "m05_ssim_windows",
    "m13_autocorrelation", "mq_exact_quantiles", "a03_pareto_front", "f01_gram", "f01_singular_values",
    "n01_qdeim_basis", "n03_gks_greedy", "n12_top_residual", "r07_deim_operator", "r09_batched_kriging",
    "r11_local_kriging", "g02_level_rounds", "g01_volume_rounds", "e07_deim_hybrid",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    registry.load_all()
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("p08_centre", "c10_matvec_sensors"):
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
