"""A stored factor of sensors that grows without being computed again.

Sensors are greedy pivots, so those of a smaller model are the first of a larger one.  A request is
served in one of three ways: a stored factor of enough sensors gives its leading part, one of too few
is extended by new rows, and otherwise a fresh one is made.  What was computed is stored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import selection as sl


@dataclass(frozen=True)
class SensorFactor:
    """Sensors in order of selection and the lower Cholesky factor of their covariance plus noise;
    ``scores`` and ``inverse`` carry the selection on."""

    ids: np.ndarray
    coords: np.ndarray
    low: np.ndarray
    scores: np.ndarray
    inverse: np.ndarray
    kernel: sl.RadialKernel
    noise: float

    @property
    def k(self) -> int:
        return len(self.ids)

    def prefix(self, k: int) -> "SensorFactor":
        return SensorFactor(self.ids[:k], self.coords[:k], self.low[:k, :k], self.scores[:k], self.inverse[:k, :k], self.kernel, self.noise)

    def solve(self, readings: np.ndarray) -> np.ndarray:
        """Weights of readings: two triangular systems."""
        return np.linalg.solve(self.low.T, np.linalg.solve(self.low, readings))


def _empty(kernel: sl.RadialKernel, noise: float, dim: int) -> SensorFactor:
    none = np.zeros((0, 0))
    return SensorFactor(np.zeros(0, "i8"), np.zeros((0, dim)), none, np.zeros(0), none, kernel, noise)


def extend(factor: SensorFactor, points: DataFrame, k: int) -> SensorFactor:
    """``factor`` with up to ``k`` sensors: the selection goes on where it stopped, and only the new rows of
    the factor are formed.  Fewer where no point has residual variance left."""
    scorer = sl.CholeskyScore(factor.kernel)
    if factor.k:
        scorer.picked, scorer.inv = factor.coords.copy(), factor.inverse.copy()
    new = sl.greedy_select(points, scorer, k - factor.k)
    if not len(new.ids):
        return factor
    kernel, n = factor.kernel, factor.k
    cross = kernel(new.rows, factor.coords) if n else np.zeros((len(new.ids), 0))
    left = np.linalg.solve(factor.low, cross.T).T if n else cross
    inner = kernel(new.rows, new.rows) + factor.noise * np.eye(len(new.ids))
    low = np.zeros((n + len(new.ids),) * 2)
    low[:n, :n], low[n:, :n] = factor.low, left
    low[n:, n:] = np.linalg.cholesky(inner - left @ left.T)
    coords = np.vstack([factor.coords, new.rows]) if n else new.rows
    return SensorFactor(np.concatenate([factor.ids, new.ids]), coords, low, np.concatenate([factor.scores, new.scores]),
                        scorer.inv, kernel, factor.noise)


def fresh(points: DataFrame, kernel: sl.RadialKernel, noise: float, k: int) -> SensorFactor:
    return extend(_empty(kernel, noise, 2), points, k)


def save(spark: SparkSession, factor: SensorFactor, path: str) -> None:
    """A new version below ``path``: readers meet a whole factor or none of it."""
    name, numbers = sl.described(factor.kernel)
    rows = [(i, int(s), [float(v) for v in c], [float(v) for v in lo[: i + 1]], float(w), [float(v) for v in inv[: i + 1]], name, numbers, float(factor.noise))
            for i, (s, c, lo, w, inv) in enumerate(zip(factor.ids, factor.coords, factor.low, factor.scores, factor.inverse))]
    spark.createDataFrame(rows, "rank bigint, id bigint, coords array<double>, low array<double>, score double, inverse array<double>, "
                          "kernel string, kernel_parameters map<string,double>, noise double").write.parquet(f"{path}/k={factor.k}/{uuid.uuid4().hex}")


def load(spark: SparkSession, path: str) -> SensorFactor | None:
    """The largest factor stored below ``path``; None where there is none."""
    try:
        table = spark.read.option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    files = table.select("*", F.input_file_name().alias("_file"))
    version = F.regexp_extract("_file", "(k=[0-9]+/[0-9a-f]{32})", 1)
    size = F.regexp_extract("_file", "k=([0-9]+)/", 1).cast("long")
    tagged = files.select("*", version.alias("_version"), size.alias("_size"))
    whole = tagged.groupBy("_version", "_size").agg(F.count(F.lit(1)).alias("n")).where("n = _size").orderBy(F.desc("_size"), "_version").first()
    if whole is None:
        return None
    rows = tagged.where(F.col("_version") == whole["_version"]).orderBy("rank").collect()
    k = len(rows)

    def lower(name: str) -> np.ndarray:
        out = np.zeros((k, k))
        for i, r in enumerate(rows):
            out[i, : i + 1] = r[name]
        return out

    kernel = sl.restored(rows[0]["kernel"], rows[0]["kernel_parameters"])
    return SensorFactor(np.array([r["id"] for r in rows]), np.array([r["coords"] for r in rows]), lower("low"),
                        np.array([r["score"] for r in rows]), lower("inverse"), kernel, rows[0]["noise"])


def factor_at(spark: SparkSession, path: str, points: DataFrame, kernel: sl.RadialKernel, noise: float, k: int,
              report: Callable[[str], None] | None = None) -> SensorFactor:
    """The factor of ``k`` sensors, from the store as far as it reaches.  ``report`` hears which way it came."""
    known = load(spark, path)
    if known is not None and (sl.described(known.kernel) != sl.described(kernel) or known.noise != noise):
        known = None
    way = "fresh" if known is None else "prefix" if known.k >= k else "extended"
    if report:
        report(way)
    if way == "prefix":
        return known.prefix(k)
    factor = extend(known, points, k) if known else fresh(points, kernel, noise, k)
    save(spark, factor, path)
    return factor
