"""Query registry: each entry is a Spark plan plus, where SQL can say it, an oracle."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Shared leading expressions of the oracle statements.
_CTES = {
    "g": """g AS (
  SELECT (year(l_shipdate)*12 + month(l_shipdate) - 23941)::BIGINT AS level,
         l_suppkey AS loc, l_suppkey // 10 AS y, l_suppkey % 10 AS x,
         sum(round(l_extendedprice*100)::BIGINT)::DOUBLE / count(*) / 100 AS value,
         sum(round(l_quantity)::BIGINT)::DOUBLE / count(*) AS f_quantity,
         sum(round(l_discount*100)::BIGINT)::DOUBLE / count(*) / 100 AS f_discount,
         count(*) AS n_obs
  FROM lineitem GROUP BY 1, 2, 3, 4)""",
    "p": """p AS (
  SELECT *, avg(value) OVER (PARTITION BY loc) AS mu,
         value - avg(value) OVER (PARTITION BY loc) AS resid FROM g)""",
    "sh": "sh AS (SELECT max(level)+1 AS nl, max(loc)+1 AS n, (max(loc)+10)//10 AS ny FROM g)",
    "s": """s AS (
  SELECT event_id AS idx, (dayofyear(ts)-1)::BIGINT AS level, user_id AS loc,
         event_type AS kind, value FROM events)""",
    # k most energetic locations, the deterministic sensor rule of the checked queries
    "sens": """sens AS (
  SELECT loc, y, x, mu, (row_number() OVER (ORDER BY e DESC, loc) - 1) AS rank
  FROM (SELECT loc, y, x, mu, round(sum(resid*resid), 3) AS e FROM p GROUP BY loc, y, x, mu)
  QUALIFY rank < 5)""",
}


def ctes(*names: str) -> str:
    """``WITH`` clause of the named shared expressions."""
    return "WITH " + ",\n".join(_CTES[n] for n in names) + "\n"


def more(*names: str) -> str:
    """Same, open for further expressions."""
    return ctes(*names).rstrip() + ",\n"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    from importlib import import_module

    for area in AREAS:
        import_module(f"fieldloom.plans.{area}")


AREAS = [
    "ratedist", "sources", "reshape", "quantise", "metrics", "analytics", "kernels", "fitting",
    "selection", "rounds", "prediction", "codecs", "runners",
]
