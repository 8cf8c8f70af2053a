"""Codecs of several fields and of whole volumes: packed blobs and distributed decoding.

*Several fields* share sensors and a linear model of coregionalisation: covariance of fields ``B``
times covariance of locations.  A level of ``d`` fields is a blob of three int32 words (sensors,
fields, locations) and the standardised readings, sensor by sensor, as float32.

*A volume* is coded in rank-1 modes ``u_j(level) v_j(loc)`` with sensors anywhere in it.  Its blob has four
int32 words (modes, sensors, cells, readings that lie inside the volume) and those readings.
A volume with fewer levels than the model lacks the sensors beyond it; levels beyond the model
decode to the location mean.

Decoding solves for each blob's coefficients where the blob is and joins them with the location
table block by block, so the number of blobs and of locations is free.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import decompose as dc
from fieldloom.operators import selection as sl
from fieldloom.operators.blockproduct import block_product
from fieldloom.operators.codecs import sensor_cap, training_levels, volume_modes
from fieldloom.operators.predict import check_model, solve_spd
from fieldloom.session import cut_lineage, sized_broadcast
from fieldloom.sources.profiles import block, collect_matrix, list_column, scalar
from fieldloom.sources.rawf32 import pack_f32, unpack_f32

JITTER = 1e-6
DEFAULT_KERNEL = sl.RadialKernel(sl.kn.matern, nu=1.5, ls=3.0)


@dataclass
class FieldsModel:
    """``table``: loc, y, x, mu and sd (arrays over fields) of the training levels."""

    fields: list[str]
    table: DataFrame
    sensors: np.ndarray
    coords: np.ndarray
    b_matrix: np.ndarray
    n_locs: int
    kernel: sl.RadialKernel
    noise: float

    @property
    def k(self) -> int:
        return len(self.sensors)

    @property
    def d(self) -> int:
        return len(self.fields)

    def system(self) -> np.ndarray:
        """Joint covariance of all readings, field by field."""
        k_ss = self.kernel(self.coords, self.coords) + JITTER * np.eye(self.k)
        return np.kron(self.b_matrix, k_ss) + self.noise**2 * np.eye(self.k * self.d)


def stacked(frames: dict[str, DataFrame], levels: np.ndarray | None = None) -> DataFrame:
    """loc, y, x, raw: the values of all fields (fields x levels, flattened) at a location.

    ``frames`` are profiles; absent levels hold the location's mean.  A location has to be in all.
    """
    out = None
    for i, p in enumerate(frames.values()):
        vec = F.col("vec") if levels is None else F.array(*[F.col("vec")[int(v)] for v in levels])
        mine = p.select("loc", "y", "x", F.transform(vec, lambda v: v + F.col("mu")).alias(f"_{i}"))
        out = mine if out is None else out.join(mine.drop("y", "x"), "loc")
    return out.select("loc", "y", "x", F.concat(*[f"_{i}" for i in range(len(frames))]).alias("raw"))


def joint_rank(stack: DataFrame, d: int, n_levels: int, tol: float, cap: int) -> int:
    """Rank by the energy criterion over the fields' values, stacked as rows of one matrix."""
    rows = stack.select(F.explode(F.expr(f"transform(sequence(0, {d - 1}), f -> slice(raw, f * {n_levels} + 1, {n_levels}))")).alias("vec"))
    lam = np.linalg.eigvalsh(collect_matrix(dc.gram(rows, n_levels), (n_levels, n_levels)))
    return dc.choose_rank(np.sqrt(np.maximum(lam[::-1], 0.0)), tol, cap)


def standardised(stack: DataFrame, d: int, n_train: int) -> DataFrame:
    """loc, y, x, mu, sd, z: moments per field and the standardised values (fields x levels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = block(b, "raw").reshape(b.num_rows, d, n_train)
            mu, sd = raw.mean(2), raw.std(2)
            sd = np.where(sd < 1e-10, 1.0, sd)
            z = (raw - mu[:, :, None]) / sd[:, :, None]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("loc", "y", "x")), list_column(mu), list_column(sd),
                                              list_column(z.reshape(b.num_rows, -1))], ["loc", "y", "x", "mu", "sd", "z"])

    return stack.mapInArrow(run, "loc bigint, y bigint, x bigint, mu array<double>, sd array<double>, z array<double>")


def field_covariance(standard: DataFrame, d: int, n_train: int) -> np.ndarray:
    """Covariance of the standardised fields over all locations and levels, with jitter."""

    def products(b: pa.RecordBatch) -> np.ndarray:
        z = block(b, "z").reshape(b.num_rows, d, n_train).transpose(1, 0, 2).reshape(d, -1)
        return z @ z.T

    rows = standard.select("z")
    total = collect_matrix(dc.sum_blocks(rows, ["z"], (d, d), products), (d, d))
    b = total / (standard.count() * n_train)
    return (b + b.T) / 2 + JITTER * np.eye(d)


def train_fields(
    frames: dict[str, DataFrame], n_levels: int, n_locs: int, tol: float = 0.1, cap: int | None = None, factor: int = 4,
    kernel: sl.RadialKernel = DEFAULT_KERNEL, noise: float = 0.05, seed: int = 42,
) -> tuple[FieldsModel, np.ndarray]:
    """(model, training levels) from one profile table per field.

    The rank of all fields together sets the number of training levels, and the rank of these the
    number of sensors, a column subset of the location covariance.
    """
    d, cap = len(frames), cap or sensor_cap(n_locs)
    pilot = joint_rank(stacked(frames), d, n_levels, tol, cap)
    count = max(min(training_levels(pilot, n_levels, factor), n_levels), min(d + 2, n_levels))
    levels = np.sort(np.random.default_rng(seed).choice(n_levels, count, replace=False))
    stack = cut_lineage(stacked(frames, levels))
    k = joint_rank(stack, d, count, tol, cap)
    standard = cut_lineage(standardised(stack, d, count))
    b_matrix = field_covariance(standard, d, count)
    points = standard.select(F.col("loc").alias("id"), F.array(F.col("y").cast("double"), F.col("x").cast("double")).alias("x"))
    picks = sl.gks(points, kernel, k, min(20, k), "random", seed)
    table = standard.select("loc", "y", "x", "mu", "sd")
    return FieldsModel(list(frames), table, picks.ids, picks.rows, b_matrix, n_locs, kernel, noise), levels


def _rank_of(sensors: np.ndarray, ids: Column) -> Column:
    pairs = [F.lit(v) for i, s in enumerate(sensors) for v in (int(s), i)]
    return F.create_map(*pairs)[ids] if pairs else F.lit(None).cast("int")


def _readings(cells: DataFrame, key: str, rank: Column, value: Column, k: int, absent: Column) -> DataFrame:
    """key, r: the ``k`` readings of every key in rank order; every key of ``cells`` has a row."""
    held = F.collect_list(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), value.alias("v"))))
    places = F.sequence(F.lit(0), F.lit(k - 1)) if k else F.array().cast("array<int>")
    rows = cells.groupBy(key).agg(F.map_from_entries(held).alias("m"))
    return rows.select(key, F.transform(places, lambda i: F.coalesce(F.try_element_at("m", i), absent)).alias("r"))


def compress_fields(model: FieldsModel, cells: DataFrame) -> DataFrame:
    """level, blob of cells (level, loc, one column per field); an absent reading stands with 0, the mean."""
    means = model.table.where(F.col("loc").isin(model.sensors.tolist())).select("loc", "mu", "sd")
    at = cells.select("level", "loc", *model.fields).join(sized_broadcast(means, model.k, 64 * model.d), "loc", "left")
    z = F.array(*[F.coalesce((F.col(f) - F.col("mu")[i]) / F.col("sd")[i], F.lit(0.0)) for i, f in enumerate(model.fields)])
    rows = _readings(at, "level", _rank_of(model.sensors, F.col("loc")), z, model.k, F.array_repeat(F.lit(0.0), model.d))
    blob = pack_f32(F.flatten("r"), F.lit(model.k), F.lit(model.d), F.lit(model.n_locs))
    return rows.select(F.col("level").cast("bigint").alias("level"), blob.alias("blob"))


def _solved(blobs: DataFrame, key: str, words: int, solve: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """item, c of blobs: ``solve(header, payload)`` for every one of them, where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = [solve(np.array(h), np.array(p, dtype=float)) for h, p in zip(*(b.column(x).to_pylist() for x in ("header", "payload")))]
                yield pa.RecordBatch.from_arrays([b.column("item"), list_column(np.stack(c))], ["item", "c"])

    parts = blobs.select(F.col(key).cast("bigint").alias("item"), unpack_f32(F.col("blob"), words).alias("u"))
    return parts.select("item", "u.header", "u.payload").mapInArrow(run, "item bigint, c array<double>")


def decompress_fields(model: FieldsModel, blobs: DataFrame, tile: int = 1024) -> DataFrame:
    """level, loc, and one column per field: posterior mean of every blob at every location."""
    k, d, b_matrix = model.k, model.d, model.b_matrix
    inv = solve_spd(model.system(), np.eye(k * d))
    check_model(inv)

    def solve(header: np.ndarray, payload: np.ndarray) -> np.ndarray:
        if tuple(header[:2]) != (k, d):
            raise ValueError(f"blob of {header[0]} sensors and {header[1]} fields, the model has {k} and {d}")
        alpha = inv @ payload.reshape(k, d).T.ravel()
        return (b_matrix @ alpha.reshape(d, k)).ravel()

    kernel, coords = model.kernel, model.coords

    def features(b: pa.RecordBatch) -> np.ndarray:
        return kernel(np.column_stack([scalar(b, "y"), scalar(b, "x")]).astype(float), coords)

    def finish(b: pa.RecordBatch, value: np.ndarray) -> np.ndarray:
        return value * block(b, "sd")[:, :, None] + block(b, "mu")[:, :, None]

    blobs = cut_lineage(blobs)
    coefs = _solved(blobs, "level", 3, solve)
    back = block_product(model.table, ["loc", "y", "x", "mu", "sd"], model.n_locs, features, coefs, blobs.count(), d, finish, 48 + 16 * d, tile,
                         names=model.fields)
    return back.withColumnRenamed("item", "level")


def save_fields(model: FieldsModel, path: str) -> None:
    kernel, numbers = sl.described(model.kernel)
    model.table.write.mode("overwrite").parquet(f"{path}/table")
    model.table.sparkSession.createDataFrame(
        [(model.fields, model.sensors.tolist(), [c.tolist() for c in model.coords], [r.tolist() for r in model.b_matrix],
          model.n_locs, kernel, numbers, model.noise)],
        "fields array<string>, sensors array<bigint>, coords array<array<double>>, b array<array<double>>, n_locs bigint, "
        "kernel string, kernel_parameters map<string,double>, noise double").write.mode("overwrite").parquet(f"{path}/params")


def load_fields(spark: SparkSession, path: str) -> FieldsModel:
    p = spark.read.parquet(f"{path}/params").first()
    return FieldsModel(list(p["fields"]), spark.read.parquet(f"{path}/table"), np.array(p["sensors"]), np.array(p["coords"]),
                       np.array(p["b"]), p["n_locs"], sl.restored(p["kernel"], p["kernel_parameters"]), p["noise"])


@dataclass
class VolumeModel:
    """``table``: loc, mu, mode (planar mode row); ``levels``: levels x k mode values; sensors are cell ids
    ``loc * LEVEL_SPAN + level`` with their mode rows."""

    table: DataFrame
    levels: np.ndarray
    sensors: np.ndarray
    rows: np.ndarray
    n_locs: int

    @property
    def k(self) -> int:
        return self.levels.shape[1]


def train_volume(profiles: DataFrame, n_levels: int, n_locs: int, k: int, oversample: int = 0) -> VolumeModel:
    basis = dc.svd_basis(profiles, n_levels, k)
    picks = sl.qdeim(volume_modes(profiles, basis, k).select("id", "x"), k, k + oversample)
    planar = dc.spatial_modes(profiles, basis, k).select(F.col("id").alias("loc"), F.col("x").alias("mode"))
    table = profiles.select("loc", "mu").join(planar, "loc")
    return VolumeModel(table, basis.v[:, :k], picks.ids, picks.rows, n_locs)


def compress_volumes(model: VolumeModel, cells: DataFrame, n_levels: int) -> DataFrame:
    """volume, blob of cells (volume, level, loc, value) of volumes with ``n_levels`` levels."""
    inside = model.sensors[model.sensors % sl.LEVEL_SPAN < n_levels]
    at_loc = np.unique(inside // sl.LEVEL_SPAN).tolist()
    means = model.table.where(F.col("loc").isin(at_loc)).select("loc", "mu")
    at = cells.select("volume", "level", "loc", "value").join(sized_broadcast(means, len(at_loc), 32), "loc", "left")
    rank = _rank_of(inside, F.col("loc") * sl.LEVEL_SPAN + F.col("level"))
    rows = _readings(at, "volume", rank, F.coalesce(F.col("value") - F.col("mu"), F.lit(0.0)), len(inside), F.lit(0.0))
    header = [F.lit(int(v)) for v in (model.k, len(model.sensors), model.n_locs * n_levels, len(inside))]
    return rows.select(F.col("volume").cast("bigint").alias("volume"), pack_f32(F.col("r"), *header).alias("blob"))


def decompress_volumes(model: VolumeModel, blobs: DataFrame, tile: int = 1024) -> DataFrame:
    """volume, level, loc, value: as many levels as the blob's volume had."""
    k, sensors, rows, levels, n_locs = model.k, model.sensors, model.rows, model.levels, model.n_locs
    at_level = sensors % sl.LEVEL_SPAN
    check_model(levels, rows)
    sizes = blobs.select("volume", unpack_f32(F.col("blob"), 4)["header"].alias("h")).select(
        "volume", (F.col("h")[2] / n_locs).cast("bigint").alias("n"))
    blobs = cut_lineage(blobs)

    def solve(header: np.ndarray, payload: np.ndarray) -> np.ndarray:
        use = rows[at_level < header[2] // n_locs]
        if len(use) != header[3] or header[0] != k:
            raise ValueError("the blob is of another model")
        c = np.linalg.lstsq(use, payload, rcond=None)[0] if len(use) else np.zeros(k)
        return (levels * c).ravel()

    def finish(b: pa.RecordBatch, value: np.ndarray) -> np.ndarray:
        return value + scalar(b, "mu")[:, None, None]

    coefs = _solved(blobs, "volume", 4, solve)
    n_train = len(levels)
    known = block_product(model.table, ["loc", "mu", "mode"], n_locs, lambda b: block(b, "mode"), coefs, blobs.count(), n_train, finish,
                          32 + 8 * k, tile).withColumnsRenamed({"item": "volume", "part": "level"})
    sizes = sized_broadcast(cut_lineage(sizes), blobs.count(), 16)
    known = known.join(sizes, "volume").where("level < n").select("volume", "level", "loc", "value")
    more = sizes.where(F.col("n") > n_train).select("volume", F.explode(F.sequence(F.lit(n_train).cast("bigint"), F.col("n") - 1)).alias("level"))
    if more.isEmpty():
        return known
    # Beyond the model: the mean, one row per location and level.
    wanted = more.groupBy("volume").agg(F.collect_list("level").alias("levels")).withColumn("tile", F.explode(
        F.sequence(F.lit(0), F.lit(max(0, n_locs - 1) // tile)).cast("array<bigint>")))
    means = model.table.select(F.expr(f"loc div {tile}").alias("tile"), "loc", F.col("mu").alias("value"))
    rest = wanted.join(means, "tile").select("volume", F.explode("levels").alias("level"), "loc", "value")
    return known.unionByName(rest)
