"""Training-data pipeline: five stages from raw documents to checked token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of ``documents``.  ``run`` writes every stage as Parquet below the shared
checkpoint folder and rereads it, so a lost executor never costs an earlier stage.

Of each group of linked documents the one with the smallest id stays.  Rows are judged one by one by
a key: their id where it is theirs alone, else a digest of id and text above all ids.  So a row with a null
id is a copy or a leak like any other, several clean texts under one id all stay, and only rows
that agree in id and text count as one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import byte_bpe, decontaminate, ngram_join, quality_rules
from fieldloom.llm import sanitise as personal
from fieldloom.llm.shared import stored
from fieldloom.session import sized_broadcast
from fieldloom.sources.tables import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``, which depends on the row's own content and on its id alone, and ``_again`` where
    the id is null or met more than once."""
    own, digest = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(digest).alias("low"), F.max(digest).alias("high"))
    odd = stored(ids.where("doc_id IS NULL OR n > 1").select(F.col("doc_id").alias("_odd"), F.expr("doc_id IS NULL OR low <> high").alias("_mixed")))
    count = odd.count()
    if not count:
        return docs.withColumns({"_key": own, "_again": F.lit(False)})
    content = F.shiftrightunsigned(F.xxhash64(F.coalesce(own, F.lit(-1)), F.coalesce("text", F.lit(""))), 3) + F.lit(1 << 61)
    tagged = docs.join(sized_broadcast(odd, count, 24), F.col("doc_id").eqNullSafe(F.col("_odd")), "left")
    key = F.when(F.col("_mixed"), content).otherwise(own)
    return tagged.withColumns({"_key": key, "_again": F.col("_mixed").isNotNull()}).drop("_odd", "_mixed")


def _by_key(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col("_key").alias("doc_id"), "text")


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """``keyed`` without the rows of the given keys."""
    keys = stored(keys.select(F.col("doc_id").alias("_key")).distinct())
    return keyed.join(sized_broadcast(keys, keys.count(), 16), "_key", "left_anti")


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines go from the others."""
    return _counted(quality_rules.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    keyed = _keyed(docs)
    classes = stored(ngram_join.jaccard_components(_by_key(keyed)))
    left = _without(keyed, classes.where("component_id <> doc_id"))
    if not keyed.where("_again").isEmpty():
        left = left.where("NOT _again").unionByName(left.where("_again").dropDuplicates(["_key"]))
    return left.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    keyed = _keyed(docs)
    return _without(keyed, decontaminate.find_leaks(_by_key(keyed), table(spark, sf_dir, "benchmark"))).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced by their kind."""
    return _counted(personal.sanitise(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256); ids as little-endian unsigned 32-bit
    integers."""
    coded = byte_bpe.encode(docs, public_tokenizers.path(VOCABULARY), decoded=True)
    return coded.select("doc_id", F.expr("CAST(length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), "ids",
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", token_ids),
]

# Digests of token ids and the joins of window sets are beyond SQL; tests hold it to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
