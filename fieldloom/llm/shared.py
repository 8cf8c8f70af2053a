"""Helpers of this package: stored intermediates, Arrow batches, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import _ensure_checkpoint_dir

Batches = Iterator[pa.RecordBatch]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back.

    This cuts the lineage: a lost executor costs the reread of a file, never the work before it.
    The folder is the session's ``spark.checkpoint.dir``; files go when the folder is cleaned.
    """
    spark = df.sparkSession
    _ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: dict[str, str]) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns one batch into dicts of column arrays."""
    names = list(schema)
    ddl = ", ".join(f"`{name}` {kind}" for name, kind in schema.items())

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for out in fn(batch):
                yield pa.RecordBatch.from_arrays([_array(out[n]) for n in names], names=names)

    return df.mapInArrow(run, ddl)


def _array(values) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        return values.combine_chunks()
    return values if isinstance(values, pa.Array) else pa.array(values)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): one root per connected component of an undirected edge list.

    Randomised contraction: every node takes the neighbour (or itself) of least digest in this
    round, edges move to the chosen nodes, and loops vanish.  A round shrinks the graph by a
    constant factor whatever its shape, so a chain needs logarithmically many rounds.  Digests
    depend on node and round only, so a repeated task makes the same choice.  Hub nodes are
    reduced before the shuffle by the partial minimum.
    """
    edges = stored(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        salt = F.lit(len(steps))
        both = edges.union(edges.select("b", "a")).toDF("node", "to")
        order = lambda c: F.struct(F.xxhash64(salt, c).alias("h"), c.alias("v"))
        choice = both.groupBy("node").agg(F.min(order(F.col("to"))).alias("m"))
        step = stored(choice.select("node", F.least(F.col("m"), order(F.col("node")))["v"].alias("to")))
        steps.append(step)
        moved = edges.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").where("x <> y")
        edges = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not steps:
        return edges.toDF("node", "root")
    roots = steps[-1].toDF("node", "root")
    for step in reversed(steps[:-1]):
        last = step.join(roots.withColumnRenamed("node", "to"), "to", "left")
        roots = last.select("node", F.coalesce("root", "to").alias("root"))
    return stored(roots)
