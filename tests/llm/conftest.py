import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).parent))

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]) rows, with columns whose names operators use inside."""

    def build(rows, clash: bool = True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, COLUMNS)
        if clash:
            for name in ("digest", "token", "node", "n", "spans", "word", "w", "h", "chunk", "runs", "host", "kept"):
                df = df.withColumn(name, df.lang)
        return df

    return build


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], T._parse_datatype_string(COLUMNS))
