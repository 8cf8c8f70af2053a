"""Every registered query against its oracle on the smallest tables (fast subset) and
registry hygiene."""

import duckdb
import pytest
from pathlib import Path

import __spark_entry__ as entry_mod
from tools.check_oracle import _rows

SAMPLE = [
    "rd_mean_predictor", "rd_sweep", "s06_masked_snapshots", "s13_packed_sensors", "p15_latin_hypercube",
    "p19_domain_buffer", "q05_laplacian_dequantise", "q17_sensor_bits", "q22_aligned_histogram", "l03_lorenzo_cube",
    "m13_autocorrelation", "mq_exact_quantiles", "a03_pareto_front", "a13_win_regions", "c07_multiscale",
    "f01_gram", "n01_pivoted_qr", "n08_greedy_pivots", "n09_farthest_points", "r01_simple_kriging",
    "r02_universal_kriging", "r06_deim_two_modes", "g07_error_array", "g10_rd_point", "x2_rms_residual",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, sf, con, name):
    df = entry_mod.queries()[name](spark, sf)
    cur = con.execute(entry_mod.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(cols, cur.fetchall())


def test_oracles_belong_to_queries():
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


def test_entry_runs(spark):
    assert entry_mod.entry(spark).count() == 3


@pytest.mark.parametrize("name", ["rd_sweep", "mq_exact_quantiles", "m13_autocorrelation", "g02_level_rounds", "f01_gram"])
def test_hot_keys(spark, con, sf, tmp_path, name):
    """One supplier holds a third of all rows and one month another third."""
    src = f"read_parquet('{sf}/lineitem.parquet')"
    con.execute(f"""COPY (SELECT * REPLACE (
        CASE WHEN rowid % 3 = 0 THEN 4 ELSE l_suppkey END AS l_suppkey,
        CASE WHEN rowid % 3 = 1 THEN TIMESTAMP '1997-05-03' ELSE l_shipdate END AS l_shipdate)
        FROM (SELECT *, row_number() OVER () AS rowid FROM {src})) TO '{tmp_path}/lineitem.parquet'""")
    fresh = duckdb.connect()
    fresh.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    df = entry_mod.queries()[name](spark, str(tmp_path))
    cur = fresh.execute(entry_mod.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert _rows(df.columns, df.collect()) == _rows(cols, cur.fetchall())
