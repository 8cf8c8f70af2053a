"""Snapshot encoding of arriving files with a trained model.

Encoding a snapshot needs nothing but the model, so every micro-batch of complete
snapshots is encoded on its own; a replayed batch overwrites its own output folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fieldloom.operators.codecs import Model, encode_cells

SNAPSHOT_SCHEMA = "level bigint, loc bigint, value double"


def encode_stream(spark: SparkSession, source: str, model: Model, sink: str, checkpoint: str) -> StreamingQuery:
    """Encode parquet snapshots dropped into ``source``; one sink folder per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        encode_cells(model, batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (
        spark.readStream.schema(SNAPSHOT_SCHEMA).parquet(source)
        .writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
