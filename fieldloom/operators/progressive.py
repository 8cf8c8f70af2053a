"""Progressive rounds: sense, predict, settle what is within the bound, repeat.

The state is a table of cells; a round is a handful of narrow passes over it plus a
top-k, and its outcome is written to the shared checkpoint folder, so a lost executor
costs at most the current round.  Only sensors, a budgeted few, reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import kernels as kn
from fieldloom.functions.quantisers import error_bin
from fieldloom.operators import selection as sl
from fieldloom.operators.entropy import entropy_of
from fieldloom.operators.groupselect import gks_by
from fieldloom.operators.predict import check_model, local_mean, solve_spd
from fieldloom.operators.quantiles import exact_quantiles
from fieldloom.operators.ratedist import psnr
from fieldloom.operators.sizing import sensor_bits
from fieldloom.session import cut_lineage, sized_broadcast
from fieldloom.sources.profiles import add_block_column, scalar

MAX_BUDGET = 4_000_000
AXES = {"level": ("y", "x"), "volume": ("level", "y", "x")}


@dataclass(frozen=True)
class RoundConfig:
    """``scope`` is ``level`` (every level its own process) or ``volume`` (one 3-D process).

    ``strategy``: ``max_residual`` takes the largest errors; ``rpgks`` selects columns of
    the covariance over the pool, of each level or of the volume, by a randomly pivoted factor and
    QR; ``worst_fraction`` does so within the worst share of errors; ``hybrid`` is ``rpgks`` for ``hybrid_rounds`` rounds, then ``worst_fraction``.
    """

    accept: float
    eb: float
    k_per_round: int
    max_rounds: int
    scope: str = "level"
    strategy: str = "max_residual"
    worst_share: float = 0.25
    hybrid_rounds: int = 1
    kernel: Callable = field(default_factory=lambda: sl.RadialKernel(kn.matern, nu=2.5, ls=2.0))
    scales: tuple[float, ...] = (1.0, 1.0, 1.0)
    noise: float = 1e-3
    n_local: int | None = None
    accumulate: bool = True
    storage: str = "exact"
    seed: int = 0
    target_cr: float | None = None
    target_psnr: float | None = None
    target_bit_rate: float | None = None


@dataclass
class RoundResult:
    state: DataFrame
    history: list[DataFrame]
    records: list[dict]
    stopped: str


def initial_state(cells: DataFrame, value: str) -> DataFrame:
    """level, loc, y, x, v, err, sensed, settled, settled_err; nothing sensed or settled.
    The first prediction is 0, the mean of a centred field."""
    return cells.select(
        "level", "loc", "y", "x", F.col(value).cast("double").alias("v"), F.col(value).cast("double").alias("err"),
        F.lit(None).cast("bigint").alias("sensed"), F.lit(None).cast("bigint").alias("settled"),
        F.lit(None).cast("double").alias("settled_err"),
    )


def in_pool() -> Column:
    return F.col("sensed").isNull() & F.col("settled").isNull()


def accepted(bound: float) -> Column:
    """Strictly inside the bound, and not a sensor."""
    return in_pool() & (F.abs("err") < bound)


def full_error() -> Column:
    """Sensors 0, settled cells their locked error, the rest the current error."""
    return F.when(F.col("sensed").isNotNull(), 0.0).otherwise(F.coalesce("settled_err", "err"))


def _coords(config: RoundConfig) -> Column:
    axes = AXES[config.scope]
    scale = config.scales[-len(axes):]
    return F.array(*[F.col(a).cast("double") / s for a, s in zip(axes, scale)])


def _flat(df: DataFrame) -> DataFrame:
    """One id per cell: levels share the locations, so pair them."""
    return df.withColumn("id", F.col("loc") * sl.LEVEL_SPAN + F.col("level"))


def choose(state: DataFrame, config: RoundConfig, r: int, n_levels: int | None = None) -> DataFrame:
    """Sensors of round ``r``: level, loc (at most k per level, or k in all)."""
    pool = state.where(in_pool())
    strategy = config.strategy
    if strategy == "hybrid":
        strategy = "rpgks" if r <= config.hybrid_rounds else "worst_fraction"
    size = F.desc(F.round(F.abs("err"), 6))
    by_level = config.scope == "level"
    k = config.k_per_round
    if strategy == "max_residual":
        if not by_level:
            return pool.orderBy(size, "level", "loc").limit(k).select("level", "loc")
        rank = F.row_number().over(Window.partitionBy("level").orderBy(size, "loc"))
        return pool.withColumn("_rn", rank).where(F.col("_rn") <= k).select("level", "loc")
    if strategy == "worst_fraction":
        p = 1.0 - config.worst_share
        keys = ["level"] if by_level else []
        cut = exact_quantiles(pool, F.abs("err"), [p], keys, n_levels)
        counts = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        if by_level:
            lim = cut.join(counts, "level").select("level", "q", "_n")
            tagged = pool.join(sized_broadcast(lim, n_levels), "level")
        else:
            tagged = pool.withColumn("q", cut.select("q").scalar()).withColumn("_n", counts.select("_n").scalar())
        # groups too small for the share keep all their candidates
        pool = tagged.where((F.abs("err") >= F.col("q")) | (F.col("_n") * config.worst_share < k)).drop("q", "_n")
    elif strategy != "rpgks":
        raise ValueError(f"unknown strategy {config.strategy!r}")
    points = cut_lineage(_flat(pool).select("level", "loc", "id", _coords(config).alias("x")))
    if by_level:
        ids = gks_by(points.select("level", "id", "x"), config.kernel, k, 20, config.seed + r).select("id")
    else:
        ids = sl.gks(points, config.kernel, k, 20, "random", config.seed + r).to_frame(state.sparkSession).select("id")
    return ids.select(F.expr(f"id % {sl.LEVEL_SPAN}").alias("level"), F.expr(f"id div {sl.LEVEL_SPAN}").alias("loc"))


def _stored(values: np.ndarray, config: RoundConfig) -> np.ndarray:
    if config.storage == "exact":
        return values
    if config.storage in ("float32", "float16"):
        return values.astype(config.storage).astype(float)
    if config.storage == "eb_quant":
        return np.rint(values / config.eb) * config.eb
    raise ValueError(config.storage)


def _noise(config: RoundConfig) -> float:
    return max(config.noise, (config.eb / 2) ** 2) if config.storage == "eb_quant" else config.noise


class _Process:
    """Weights of the sensors known so far, per level or for the volume."""

    def __init__(self, sensors, config: RoundConfig):
        self.kernel, self.local, self.noise = config.kernel, config.n_local, _noise(config)
        self.groups = {}
        frames = sensors.groupby("level") if config.scope == "level" else [(None, sensors)]
        for g, s in frames:
            x = np.stack(s["x"].to_numpy())
            y = _stored(s["v"].to_numpy(), config)
            local = self.local is not None and len(x) > self.local
            alpha = y if local else solve_spd(self.kernel(x, x) + self.noise * np.eye(len(x)), y)
            self.groups[g] = (x, alpha, local)
        check_model(*[a for g in self.groups.values() for a in g[:2]])

    def mean(self, level: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for g, (s, alpha, local) in self.groups.items():
            hit = slice(None) if g is None else np.flatnonzero(level == g)
            part = x[hit]
            if len(part):
                out[hit] = local_mean(part, s, alpha, self.kernel, self.noise, self.local) if local else self.kernel(part, s) @ alpha
        return out


def predict_with(state: DataFrame, sensors, config: RoundConfig, out: str = "pred") -> DataFrame:
    """Prediction of every cell from collected ``sensors`` (level, x, v)."""
    process = _Process(sensors, config)
    axes, scale = AXES[config.scope], np.array(config.scales[-len(AXES[config.scope]):])

    def mean(b):
        x = np.column_stack([scalar(b, a) for a in axes]).astype(float) / scale
        return process.mean(scalar(b, "level"), x)

    return add_block_column(state, out, mean)


def run_rounds(
    cells: DataFrame, value: str, config: RoundConfig, start: DataFrame | None = None, first_round: int = 1
) -> RoundResult:
    """Run until the pool is empty, a target is met or ``max_rounds`` is reached.

    ``start`` resumes from a saved state whose sensors and settled cells are kept.
    """
    state = cut_lineage(start if start is not None else initial_state(cells, value))
    history, records, reason = [], [], "max_rounds"
    n_levels = state.agg(F.max("level") + 1).first()[0]
    per_round = config.k_per_round * (n_levels if config.scope == "level" else 1)
    if per_round * config.max_rounds > MAX_BUDGET:
        raise ValueError("sensor budget too large to hold as a model")
    for r in range(first_round, first_round + config.max_rounds):
        new = sized_broadcast(choose(state, config, r, n_levels).withColumn("_new", F.lit(True)), per_round, 64)
        state = state.join(new, ["level", "loc"], "left").withColumn(
            "sensed", F.coalesce("sensed", F.when(F.col("_new"), F.lit(r).cast("bigint")))
        ).drop("_new")
        state = cut_lineage(state)
        known = state.where(F.col("sensed").isNotNull() if config.accumulate else F.col("sensed") == r)
        sensors = known.select("level", _coords(config).alias("x"), "v").toPandas()
        if not len(sensors):
            reason = "pool empty"
            break
        state = predict_with(state, sensors, config).withColumn("err", F.col("v") - F.col("pred")).drop("pred")
        ok = accepted(config.accept)
        state = cut_lineage(
            state.withColumn("_ok", ok)
            .withColumn("settled_err", F.when(F.col("_ok"), F.col("err")).otherwise(F.col("settled_err")))
            .withColumn("settled", F.when(F.col("_ok"), F.lit(r).cast("bigint")).otherwise(F.col("settled")))
            .drop("_ok")
        )
        history.append(state.select(F.lit(r).cast("bigint").alias("round"), "*", full_error().alias("full_err")))
        got = state.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("sensed") == r).alias("n_sensed"),
            F.count_if(F.col("settled") == r).alias("n_settled"), F.count_if(in_pool()).alias("n_left"),
        ).first()
        records.append({"round": r, **got.asDict()})
        if config.target_cr or config.target_psnr or config.target_bit_rate:
            est = rd_point(state, config.eb).first()
            if config.target_cr and est["cr"] >= config.target_cr:
                reason = "ratio reached"
            elif config.target_psnr and est["psnr"] >= config.target_psnr:
                reason = "quality reached"
            elif config.target_bit_rate and est["bit_rate"] <= config.target_bit_rate:
                reason = "bit rate reached"
            if reason != "max_rounds":
                break
        if not got["n_left"]:
            reason = "pool empty"
            break
    return RoundResult(state, history, records, reason)


def decode(state: DataFrame, config: RoundConfig) -> DataFrame:
    """Final prediction of every cell from all stored readings: ``decoded``, ``decode_err``."""
    sensors = state.where(F.col("sensed").isNotNull()).select("level", _coords(config).alias("x"), "v").toPandas()
    out = predict_with(state, sensors, config, "decoded")
    return out.withColumn("decode_err", F.col("v") - F.col("decoded"))


def rd_curve(state: DataFrame, bounds: list[float], include_sensors: bool = False) -> DataFrame:
    """eb, n, n_resid, entropy, rmse, range of a finished run re-quantised at each bound.
    Entropy covers non-sensor cells only unless asked otherwise; errors cover all."""
    e = state.select(
        "v", F.col("sensed").isNotNull().alias("is_sensor"), full_error().alias("e"),
        F.explode(F.array(*[F.lit(float(b)) for b in bounds])).alias("eb"),
    ).withColumn("bin", error_bin(F.col("e"), F.col("eb")))
    q = F.col("e") - F.col("bin") * (F.col("eb") * 2)
    counted = F.lit(True) if include_sensors else ~F.col("is_sensor")
    bins = e.groupBy("eb", "bin").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(counted).alias("_c"), F.sum(q * q).alias("_se"),
        F.min("v").alias("_lo"), F.max("v").alias("_hi"),
    )
    some = F.when(F.col("_c") > 0, F.col("_c"))
    return bins.groupBy("eb").agg(
        F.sum("_all").alias("n"), F.sum("_c").alias("n_resid"), entropy_of(some).alias("entropy"),
        F.sqrt(F.sum("_se") / F.sum("_all")).alias("rmse"), (F.max("_hi") - F.min("_lo")).alias("range"),
    )


def rd_point(state: DataFrame, eb: float, storage: str = "eb_quant") -> DataFrame:
    """Bit rate (sensors plus residual stream), ratio and PSNR of a state at ``eb``."""
    width = state.agg(F.max("loc") + 1).first()[0]
    sensors = state.where(F.col("sensed").isNotNull()).withColumn("flat", F.col("level") * width + F.col("loc"))
    bits = sensor_bits(sensors, "flat", "v", eb, storage)
    c = rd_curve(state, [eb])
    k, ib, vb = (bits.select(n).scalar() for n in ("k", "index_bits", "value_bits"))
    rate = (ib + vb + F.col("entropy") * F.col("n_resid")) / F.col("n")
    return c.select(
        "eb", "n", k.alias("k_total"), "entropy", ib.alias("index_bits"), vb.alias("value_bits"),
        rate.alias("bit_rate"), (F.lit(32.0) / rate).alias("cr"), "rmse",
        psnr(F.col("range"), F.col("rmse")).alias("psnr"),
    )


def union_history(history: list[DataFrame]) -> DataFrame:
    out = history[0]
    for h in history[1:]:
        out = out.unionAll(h)
    return out


def replay(round_points: DataFrame) -> DataFrame:
    """State rebuilt from round tables (round, level, loc, role, err): the last word on a
    cell wins."""
    last = F.struct("round", "role", "err")
    return round_points.groupBy("level", "loc").agg(F.max_by(last, "round").alias("s")).select("level", "loc", "s.*")
