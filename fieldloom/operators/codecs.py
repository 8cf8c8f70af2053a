"""Train / encode / decode codecs over profile rows.

A model is a location table (mean, deviation, basis row) plus a few sensors; an encoded
level is a packed float32 blob of readings.  Decoding is ``row features @ coefficients``
for every codec, so it is one narrow pass whatever produced the model.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import kernels as kn
from fieldloom.operators import decompose as dc
from fieldloom.operators import selection as sl
from fieldloom.operators.blockproduct import CELLS, block_product
from fieldloom.operators.predict import check_model, readings_at, solve_spd
from fieldloom.session import sized_broadcast
from fieldloom.sources.profiles import block, list_column, map_blocks, scalar
from fieldloom.sources.rawf32 import pack_f32, unpack_f32

DEFAULT_KERNEL = sl.RadialKernel(kn.matern, nu=1.5, ls=3.0)


@dataclass
class Model:
    """``table``: loc, y, x, mu, sd, vec and, for basis codecs, mode."""

    kind: str
    table: DataFrame
    sensors: np.ndarray
    coords: np.ndarray
    rows: np.ndarray | None
    n_levels: int
    n_locs: int
    kernel: Callable | None = None
    noise: float = 1e-3

    @property
    def k(self) -> int:
        return len(self.sensors)


def sensor_cap(n: int, divisor: int = 66) -> int:
    return max(1, n // divisor)


def training_levels(k_pilot: int, n_levels: int, factor: int = 3) -> int:
    """Levels to train on: factor times the pilot rank, at most all but ten, at least two
    more than the rank (the lower limit has the last word)."""
    return max(k_pilot + 2, min(factor * k_pilot, n_levels - 10))


def _only_levels(profiles: DataFrame, levels: np.ndarray) -> DataFrame:
    """Profiles restricted to training levels (positions of ``vec``)."""
    picked = F.array(*[F.col("vec")[int(i)] for i in levels])
    return profiles.withColumn("vec", picked)


def _recentred(profiles: DataFrame, levels: np.ndarray) -> DataFrame:
    """Profiles centred by the mean of the training levels alone."""
    shift = sum((F.col("vec")[int(i)] for i in levels), F.lit(0.0)) / len(levels)
    shifted = profiles.withColumn("_shift", shift)
    return shifted.withColumns({
        "mu": F.col("mu") + F.col("_shift"), "vec": F.transform("vec", lambda v: v - F.col("_shift")),
    }).drop("_shift")


def fit_deim(profiles: DataFrame, n_levels: int, n_locs: int, k: int, train: np.ndarray | None = None) -> Model:
    """SVD basis of the training levels, centred by their mean, with Q-DEIM sensors."""
    if train is not None:
        profiles = _recentred(profiles, train)
    rows = profiles if train is None else _only_levels(profiles, train)
    basis = dc.svd_basis(rows, n_levels if train is None else len(train), k)
    turn = basis.v / np.maximum(basis.s, 1e-300)
    check_model(turn)
    levels = slice(None) if train is None else np.asarray(train)
    keep = ["loc", "y", "x", "mu", "sd", "vec"]
    table = map_blocks(
        profiles, keep, "loc bigint, y bigint, x bigint, mu double, sd double, vec array<double>, mode array<double>",
        lambda b: [*(b.column(c) for c in keep), list_column(block(b, "vec")[:, levels] @ turn)],
    )
    picks = sl.qdeim(table.select(F.col("loc").alias("id"), F.col("mode").alias("x")), k)
    return Model("deim", table, picks.ids, np.zeros((k, 2)), picks.rows, n_levels, n_locs)


def fit_kriging(
    profiles: DataFrame, n_levels: int, n_locs: int, k: int, kernel: Callable = DEFAULT_KERNEL,
    noise: float = 1e-3, seed: int = 42, kind: str = "kriging",
) -> Model:
    """Column-subset sensors of the location covariance."""
    points = profiles.select(
        F.col("loc").alias("id"), F.array(F.col("y").cast("double"), F.col("x").cast("double")).alias("x")
    )
    picks = sl.gks(points, kernel, k, min(20, k), "random", seed)
    return Model(kind, profiles, picks.ids, picks.rows, None, n_levels, n_locs, kernel, noise)


def _rank_of(model: Model):
    pairs = [F.lit(v) for i, s in enumerate(model.sensors) for v in (int(s), i)]
    return F.create_map(*pairs)[F.col("loc")]


def _packed(model: Model, readings: DataFrame) -> DataFrame:
    """level, blob from (level, rank, v): k readings per level, k being the model's.  A sensor
    without a reading stands with 0, the mean, so that every other keeps its place."""
    by_rank = F.map_from_entries(F.collect_list(F.struct("rank", "v")))
    places = F.sequence(F.lit(0), F.lit(model.k - 1))
    r = readings.groupBy("level").agg(by_rank.alias("m")).select(
        "level", F.transform(places, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("r")
    )
    blob = pack_f32(F.col("r"), F.size("r"), F.lit(model.n_locs))
    return r.select(F.col("level").cast("bigint").alias("level"), blob.alias("blob"))


def encode(model: Model, profiles: DataFrame) -> DataFrame:
    """level, blob: header (k, n) and the readings of one level in sensor order; centred
    for the basis codec, standardised for Kriging."""
    value = F.col("v") / F.col("sd") if model.kind == "kriging" else F.col("v")
    at = profiles.where(F.col("loc").isin(model.sensors.tolist())).select(
        _rank_of(model).alias("rank"), "sd", F.posexplode("vec").alias("level", "v")
    )
    return _packed(model, at.select("level", "rank", value.alias("v")))


def encode_cells(model: Model, cells: DataFrame) -> DataFrame:
    """As :func:`encode` for new snapshots in long form (level, loc, value): readings are
    centred with the model's means."""
    at_sensor = F.col("loc").isin(model.sensors.tolist())
    means = model.table.where(at_sensor).select("loc", "mu", "sd")
    v = F.col("value") - F.col("mu")
    value = v / F.col("sd") if model.kind == "kriging" else v
    rows = cells.where(at_sensor).join(sized_broadcast(means, model.k), "loc")
    return _packed(model, rows.select("level", _rank_of(model).alias("rank"), value.alias("v")))


def _decoded_readings(encoded: DataFrame, n_levels: int) -> np.ndarray:
    """Sensors x levels; the readings of all levels together are a checked small model."""
    pdf = encoded.select("level", unpack_f32(F.col("blob"), 2)["payload"].alias("p")).toPandas()
    out = np.zeros((len(pdf["p"].iloc[0]), n_levels))
    out[:, pdf["level"]] = np.stack(pdf["p"].to_numpy()).T
    check_model(out)
    return out


def decode(model: Model, encoded: DataFrame) -> DataFrame:
    """loc, mu, vec (truth, centred), pred (decoded, centred): one narrow pass."""
    y = _decoded_readings(encoded, model.n_levels)
    columns = ["loc", "mu", "vec"]
    schema = "loc bigint, mu double, vec array<double>, pred array<double>"
    if model.kind == "deim":
        coef = np.linalg.lstsq(model.rows, y, rcond=None)[0]

        def from_basis(b):
            return [*(b.column(c) for c in columns), list_column(block(b, "mode") @ coef)]

        return map_blocks(model.table, [*columns, "mode"], schema, from_basis)
    kernel, coords = model.kernel, model.coords
    alpha = solve_spd(kernel(coords, coords) + model.noise * np.eye(model.k), y)

    def from_sensors(b):
        x = np.column_stack([scalar(b, "y"), scalar(b, "x")]).astype(float)
        pred = sl.in_slices(lambda rows: kernel(rows, coords) @ alpha, x, len(coords))
        return [*(b.column(c) for c in columns), list_column(pred * scalar(b, "sd")[:, None])]

    return map_blocks(model.table, [*columns, "sd", "y", "x"], schema, from_sensors)


# --- volume basis ------------------------------------------------------------------------

def volume_modes(profiles: DataFrame, basis: dc.Basis, k: int) -> DataFrame:
    """id, level, loc, v, x: rows of the rank-1 volume modes u_j(level) v_j(loc)."""
    turn, levels = basis.v[:, :k] / np.maximum(basis.s[:k], 1e-300), basis.v[:, :k]

    def rows(b):
        m, nl = b.num_rows, len(levels)
        planar = block(b, "vec") @ turn
        loc = np.repeat(scalar(b, "loc"), nl)
        level = np.tile(np.arange(nl, dtype="i8"), m)
        feats = (planar[:, None, :] * levels[None]).reshape(m * nl, -1)
        return [loc * sl.LEVEL_SPAN + level, level, loc, block(b, "vec").ravel(), list_column(feats)]

    return map_blocks(
        profiles, ["loc", "vec"], "id bigint, level bigint, loc bigint, v double, x array<double>", rows
    )


def fit_volume(profiles: DataFrame, n_levels: int, k: int, oversample: int = 0) -> tuple[DataFrame, sl.Picks, np.ndarray]:
    """Volume modes, sensors anywhere in the volume, and coefficients fitted to their
    readings (square or least squares)."""
    basis = dc.svd_basis(profiles, n_levels, k)
    modes = volume_modes(profiles, basis, k)
    picks = sl.qdeim(modes.select("id", "x"), k, k + oversample)
    read = modes.where(F.col("id").isin(picks.ids.tolist())).select("id", "v").toPandas().set_index("id")["v"]
    y = np.array([read[i] for i in picks.ids], dtype="f4").astype(float)
    return modes, picks, np.linalg.lstsq(picks.rows, y, rcond=None)[0]


def decode_volume(modes: DataFrame, coef: np.ndarray) -> DataFrame:
    """level, loc, resid, pred."""
    return map_blocks(
        modes, ["level", "loc", "v", "x"], "level bigint, loc bigint, resid double, pred double",
        lambda b: [b.column("level"), b.column("loc"), b.column("v"), block(b, "x") @ coef],
    )


def train_until_bound(
    profiles: DataFrame, n_levels: int, k: int, tol: float, cap: int
) -> tuple[int, float, float]:
    """A-priori guarantee: grow the basis until amplification times truncation error is
    within ``tol`` (or the cap); returns k, amplification, bound."""
    full = dc.svd_basis(profiles, n_levels)
    energy = (full.s**2).sum()
    while True:
        picks = sl.qdeim(volume_modes(profiles, full, k).select("id", "x"), k)
        amp = sl.deim_constant(picks.rows)
        left = float(np.sqrt(max(1.0 - (full.s[:k] ** 2).sum() / energy, 0.0)))
        bound = (1.0 + amp) * left
        if bound <= tol or k >= cap:
            return k, amp, bound
        k = min(cap, k + max(1, n_levels // 10))


# --- several fields ----------------------------------------------------------------------

def standardised_stack(frames: dict[str, DataFrame]) -> DataFrame:
    """loc, y, x, seen and one standardised profile per field, joined on location; the fields of a
    cell are seen together."""
    out = None
    for f, p in frames.items():
        z = p.select("loc", "y", "x", "seen", F.transform("vec", lambda v: v / F.col("sd")).alias(f"vec_{f}"),
                     F.col("mu").alias(f"mu_{f}"), F.col("sd").alias(f"sd_{f}"))
        out = z if out is None else out.join(z.drop("y", "x", "seen"), "loc")
    return out


def stacked_readings(stack: DataFrame, fields: list[str], sensors: np.ndarray) -> np.ndarray:
    return np.stack([readings_at(stack, sensors, "loc", f"vec_{f}") for f in fields])


def save_model(model: Model, path: str) -> None:
    """Location table and a one-row parameter table, the covariance by name and parameters."""
    spark = model.table.sparkSession
    kernel, numbers = (None, {}) if model.kind == "deim" else sl.described(model.kernel)
    model.table.write.mode("overwrite").parquet(f"{path}/table")
    rows = None if model.rows is None else [r.tolist() for r in model.rows]
    spark.createDataFrame(
        [(model.kind, model.sensors.tolist(), [c.tolist() for c in model.coords], rows,
          model.n_levels, model.n_locs, model.noise, kernel, numbers)],
        "kind string, sensors array<bigint>, coords array<array<double>>, rows array<array<double>>, "
        "n_levels bigint, n_locs bigint, noise double, kernel string, kernel_parameters map<string,double>",
    ).write.mode("overwrite").parquet(f"{path}/params")


def load_model(spark: SparkSession, path: str) -> Model:
    """The stored model with the covariance it was fitted with."""
    p = spark.read.parquet(f"{path}/params").first()
    kernel = None if p["kernel"] is None else sl.restored(p["kernel"], p["kernel_parameters"])
    if kernel is None and p["kind"] != "deim":
        raise ValueError(f"{path}: the model has no covariance stored")
    rows = None if p["rows"] is None else np.array(p["rows"])
    return Model(p["kind"], spark.read.parquet(f"{path}/table"), np.array(p["sensors"]), np.array(p["coords"]),
                 rows, p["n_levels"], p["n_locs"], kernel, p["noise"])


# --- snapshots by level number -----------------------------------------------------------

def _row_map(model: Model) -> Callable:
    """Basis row or covariance row of a batch of locations, in the unit of the field."""
    if model.kind == "deim":
        inv = np.linalg.pinv(model.rows)
        return lambda b: block(b, "mode") @ inv
    kernel, coords = model.kernel, model.coords
    inv = solve_spd(kernel(coords, coords) + model.noise * np.eye(model.k), np.eye(model.k))

    def rows(b):
        x = np.column_stack([scalar(b, "y"), scalar(b, "x")]).astype(float)
        return (kernel(x, coords) @ inv) * scalar(b, "sd")[:, None]

    return rows


def decode_snapshots(model: Model, encoded: DataFrame, cells: int = CELLS) -> DataFrame:
    """level, loc, value of every encoded snapshot, whatever its level number.

    Blocks of readings meet tiles of locations in the executors, ``cells`` values at a time, so the
    number of snapshots and of locations is free.
    """
    extra = ["mode"] if model.kind == "deim" else ["sd", "y", "x"]
    payload = F.transform(unpack_f32(F.col("blob"), 2)["payload"], lambda v: v.cast("double"))
    coefs = encoded.select(F.col("level").cast("bigint").alias("item"), payload.alias("c"))
    long = block_product(model.table, ["loc", "mu", *extra], model.n_locs, _row_map(model), coefs, encoded.count(), 1,
                         lambda b, v: v + scalar(b, "mu")[:, None, None], 64 + 8 * model.k, cells=cells)
    return long.select(F.col("item").alias("level"), "loc", "value")
