"""Spatial autocorrelation at every lag by a separable, zero-padded Fourier transform.

Rows of a level are transformed along x in one pass, a transpose shuffle gathers blocks of
frequencies over all rows, columns are transformed, squared and transformed back, and a second
transpose returns to rows.  A task holds one grid row or one block of ``BLOCK`` complex numbers,
and the cost is n log n in the cells whatever the number of lags.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import sized_broadcast
from fieldloom.sources.grid import NX
from fieldloom.sources.profiles import list_column

BLOCK = 1 << 20

Batches = Iterator[pa.RecordBatch]


def _ragged(batch: pa.RecordBatch, i: int, name: str) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


def _row_spectra(rows: DataFrame, nx: int, width: int) -> DataFrame:
    """level, part, y, re, im: frequencies along x of zero-padded rows, ``width`` at a time."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = pa.compute.list_value_length(batch.column("x")).to_numpy()
            level, y = (batch.column(c).to_numpy() for c in ("level", "y"))
            xs, fs = (batch.column(c).flatten().to_numpy() for c in ("x", "f"))
            step, ends = max(1, BLOCK // (2 * nx)), np.cumsum(lengths)
            for low in range(0, batch.num_rows, step):
                high = min(low + step, batch.num_rows)
                a, b = ends[low] - lengths[low], ends[high - 1]
                dense = np.zeros((high - low, nx))
                dense[np.repeat(np.arange(high - low), lengths[low:high]), xs[a:b]] = fs[a:b]
                spectrum = np.fft.rfft(dense, 2 * nx, axis=1)
                for part, at in enumerate(range(0, nx + 1, width)):
                    cut = spectrum[:, at : at + width]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(level[low:high]), pa.array(np.full(high - low, part)), pa.array(y[low:high]),
                         list_column(cut.real), list_column(cut.imag)], ["level", "part", "y", "re", "im"])

    return rows.mapInArrow(run, "level bigint, part bigint, y bigint, re array<double>, im array<double>")


def _column_powers(spectra: DataFrame, ny: int, most: int) -> DataFrame:
    """level, dy, part, re, im: lag products along y, still frequencies along x, for dy of 0 to ``most``."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        batch = group.combine_chunks().to_batches()[0]
        parts = [batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("re", "im")]
        padded = np.zeros((2 * ny, parts[0].shape[1]), complex)
        padded[batch.column("y").to_numpy()] = parts[0] + 1j * parts[1]
        full = np.fft.fft(padded, axis=0)
        back = np.fft.ifft(full.real**2 + full.imag**2, axis=0)[: most + 1]
        n = back.shape[0]
        return pa.table({"level": pa.repeat(key[0], n), "dy": pa.array(np.arange(n)), "part": pa.repeat(key[1], n),
                         "re": list_column(back.real), "im": list_column(back.imag)})

    return spectra.groupBy("level", "part").applyInArrow(
        run, "level bigint, dy bigint, part bigint, re array<double>, im array<double>")


def _lag_rows(powers: DataFrame, nx: int, most: int) -> DataFrame:
    """level, dy, lags: sums of products for dx of -``most`` to ``most``."""
    wide = powers.groupBy("level", "dy").agg(F.array_sort(F.collect_list(F.struct("part", "re", "im"))).alias("p"))
    wide = wide.select("level", "dy", F.flatten("p.re").alias("re"), F.flatten("p.im").alias("im"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                sums = np.fft.irfft(_ragged(batch, i, "re") + 1j * _ragged(batch, i, "im"), 2 * nx)
                lags = np.concatenate([sums[2 * nx - most :] if most else sums[:0], sums[: most + 1]])
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([row.column("level"), row.column("dy"), list_column(lags[None, :])], ["level", "dy", "lags"])

    return wide.mapInArrow(run, "level bigint, dy bigint, lags array<double>")


def autocorrelation(
    df: DataFrame, value: str, max_lag: int | None = None, n_levels: int | None = None, nx: int = NX, ny: int | None = None,
) -> DataFrame:
    """level, dy, dx, ac: spatial autocorrelation of the level-demeaned field, lag 0 = 1.

    Every lag of the grid, or those up to ``max_lag`` in either direction; absent cells count as the
    level's mean.  NULL where a level does not vary.  Lags with negative dy mirror the others.
    """
    if ny is None:
        ny = (df.agg(F.max("loc")).first()[0] or 0) // nx + 1
    most_y, most_x = (n - 1 if max_lag is None else max_lag for n in (ny, nx))
    means = df.groupBy("level").agg(F.avg(value).alias("_m"))
    f = df.join(sized_broadcast(means, n_levels), "level").select(
        "level", F.expr(f"loc div {nx}").alias("y"), F.expr(f"loc % {nx}").alias("x"), (F.col(value) - F.col("_m")).alias("f"))
    rows = f.where("f IS NOT NULL").groupBy("level", "y").agg(F.collect_list(F.struct("x", "f")).alias("e"))
    rows = rows.select("level", "y", F.col("e.x").alias("x"), F.col("e.f").alias("f"))
    width = max(1, BLOCK // (2 * ny))
    powers = _column_powers(_row_spectra(rows, nx, width), ny, min(most_y, ny - 1))
    lags = _lag_rows(powers, nx, min(most_x, nx - 1))
    half = lags.select("level", "dy", F.posexplode("lags").alias("at", "s"))
    half = half.select("level", "dy", (F.col("at") - min(most_x, nx - 1)).cast("bigint").alias("dx"), "s")
    if max_lag is not None and (max_lag >= nx or max_lag >= ny):
        half = _beyond(half, ny, nx, max_lag)
    power = f.groupBy("level").agg(F.sum(F.col("f") * F.col("f")).alias("_z"))
    half = half.join(sized_broadcast(power, n_levels), "level")
    half = half.select("level", "dy", "dx", F.when(F.col("_z") > 0, F.col("s") / F.col("_z")).alias("ac"))
    other = half.where("dy > 0").select("level", (-F.col("dy")).alias("dy"), (-F.col("dx")).alias("dx"), "ac")
    return half.unionByName(other)


def _beyond(half: DataFrame, ny: int, nx: int, max_lag: int) -> DataFrame:
    """Adds the lags up to ``max_lag`` at which a narrow grid has no pair."""
    spread = [(dy, dx) for dy in range(max_lag + 1) for dx in range(-max_lag, max_lag + 1) if dy >= ny or abs(dx) >= nx]
    rows = F.array(*[F.struct(F.lit(dy).cast("bigint").alias("dy"), F.lit(dx).cast("bigint").alias("dx")) for dy, dx in spread])
    none = half.select("level").distinct().select("level", F.inline(rows)).withColumn("s", F.lit(0.0))
    return half.unionByName(none)


def radial_profile(ac: DataFrame, by: tuple[str, ...] = ("level",), r_max: int | None = None) -> DataFrame:
    """Mean autocorrelation by whole lag distance, below ``r_max`` where it is given."""
    r = F.floor(F.sqrt((F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).cast("double"))).alias("r")
    near = ac.select(*by, r, "ac")
    if r_max is not None:
        near = near.where(F.col("r") < r_max)
    return near.groupBy(*by, "r").agg(F.avg("ac").alias("mean_ac"))


def e_folding(profile: DataFrame, by: tuple[str, ...] = ("level",)) -> DataFrame:
    """``by``, efold: the first distance whose mean autocorrelation is below 1/e; NULL when none is."""
    return profile.groupBy(*by).agg(F.min(F.when(F.col("mean_ac") < F.exp(F.lit(-1.0)), F.col("r"))).alias("efold"))
