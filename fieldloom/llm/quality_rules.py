"""Document quality rules with cross-document line frequency, in DataFrame functions only.

Per document: word and symbol counts, repeated lines, words in repeated three-word windows.
Across documents: lines are normalised (lower case, white space runs to one blank) and hashed;
distinct documents are counted per host and line; a line in at least ``MIN_DOCUMENTS`` and in
more than ``MAX_SHARE`` percent of its host's distinct documents is boilerplate and is removed;
a document that keeps less than ``MIN_KEPT`` percent of its words is rejected.  Documents with
the same text are one document for these counts, so copies do not condemn each other.

Counts combine before the shuffle, first per (host, line, text), then per (host, line): neither
a hot host nor a hot line gathers in one task.  The boilerplate lines are few by definition (at
most 100 / ``MAX_SHARE`` per average line count and host); they are broadcast when their counted
rows are small and joined by a shuffle otherwise.

Null or empty texts have no words and fail.  A null host is a host of its own, the same as the
empty name.  Lines without a word are never counted or removed.  Repeated rows get the same
result each.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.shared import stored
from fieldloom.session import sized_broadcast

MIN_WORDS = 50
MAX_REPEATED = 50
MIN_DOCUMENTS = 10
MAX_SHARE = 5
MIN_KEPT = 50
GAPS = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{GAPS}]+"), "")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _normal(line: Column) -> Column:
    return F.array_join(words_of(F.lower(line)), " ")


def _prepared(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"),
                       text.alias("text"), F.xxhash64(text).alias("digest"))


def document_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, host, digest, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    full = F.filter(_lines(F.col("text")), lambda x: x.rlike(f"[^{GAPS}]"))
    rows = docs.select("doc_id", "host", "digest", words_of(F.col("text")).alias("w"), full.alias("lines"),
                       F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
    rows = rows.select(
        "doc_id", "host", "digest", "n_symbols", "w",
        F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(w) < 3 THEN array() ELSE transform(sequence(0, size(w) - 3), "
               "i -> xxhash64(w[i], w[i + 1], w[i + 2])) END").alias("h"))
    # Only texts with some repeated window sort their windows to find the places.
    rows = rows.withColumn("s", F.expr(
        "CASE WHEN size(array_distinct(h)) = size(h) THEN NULL "
        "ELSE sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i))) END"))
    rows = rows.withColumn("p", F.expr(
        "transform(filter(transform(s, (x, k) -> named_struct('i', x.i, 'met', "
        "(k > 0 AND s[greatest(k - 1, 0)].h = x.h) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].h = x.h))), "
        "y -> y.met), y -> y.i)"))
    covered = F.expr("coalesce(size(array_distinct(concat(p, transform(p, x -> x + 1), transform(p, x -> x + 2)))), 0)")
    covered = F.when(F.col("p").isNull(), 0).otherwise(covered)
    return rows.select("doc_id", "host", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       covered.cast("long").alias("n_repeat_words"))


def boilerplate(docs: DataFrame) -> DataFrame:
    """(host, line): hashes of the lines above the limits of their host."""
    each = F.array_distinct(F.transform(_lines(F.col("text")), _normal))
    rows = docs.select("host", "digest", F.explode(each).alias("line")).where("line <> ''")
    rows = rows.select("host", "digest", F.xxhash64("line").alias("line")).distinct()
    counts = rows.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCUMENTS)
    hosts = docs.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("all"))
    return counts.join(hosts, "host").where(F.col("n") * 100 > F.col("all") * MAX_SHARE).select("host", "line")


def removed_lines(docs: DataFrame) -> DataFrame:
    """(host, digest, at, lost): places of boilerplate lines and the words lost, per distinct text."""
    limits = stored(boilerplate(docs))
    limits = sized_broadcast(limits, limits.count(), 64)
    rows = docs.select("host", "digest", F.posexplode(_lines(F.col("text"))).alias("at", "raw"))
    rows = rows.withColumn("normal", _normal(F.col("raw"))).where("normal <> ''")
    rows = rows.select("host", "digest", "at", F.xxhash64("normal").alias("line"),
                       (F.length("normal") - F.length(F.replace("normal", F.lit(" "))) + 1).alias("n"))
    found = rows.join(limits, ["host", "line"]).groupBy("host", "digest", "at").agg(F.max("n").alias("n"))
    return found.groupBy("host", "digest").agg(F.sort_array(F.collect_list("at")).alias("at"), F.sum("n").alias("lost"))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts of every row with ``base_failed``, ``n_removed`` (words) and the verdict ``kept``."""
    rows = _prepared(docs, id_col, text_col, host_col)
    counts = document_counts(rows).join(removed_lines(rows).select("host", "digest", "lost"), ["host", "digest"], "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    lost = F.coalesce("lost", F.lit(0)).cast("long")
    depleted = 100 * (F.col("n_words") - lost) < MIN_KEPT * F.col("n_words")
    return counts.select("doc_id", "host", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), lost.alias("n_removed"), (~failed & ~depleted).alias("kept"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of kept documents with boilerplate lines taken out of ``text_col``; same columns."""
    rows = _prepared(docs, id_col, text_col, host_col)
    # Stored, so that the filter is not pushed below the counts and their expressions copied.
    verdict = stored(apply_rules(docs, id_col, text_col, host_col).select("host", "digest", "kept"))
    verdict = verdict.where("kept").select("host", "digest").distinct()
    gone = removed_lines(rows).select(F.col("host").alias("_host"), F.col("digest").alias("_digest"), "at")
    verdict = verdict.select(F.col("host").alias("_host"), F.col("digest").alias("_digest")).join(gone, ["_host", "_digest"], "left")
    keyed = docs.withColumn("_host", F.coalesce(F.col(host_col), F.lit(""))).withColumn(
        "_digest", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("at"))
    text = F.when(F.col("at").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n"))
    joined = keyed.join(verdict, ["_host", "_digest"]).withColumn("_lines", _lines(F.col(text_col)))
    return joined.withColumn("_text", text).select(
        *(F.col("_text").alias(c) if c == text_col else F.col(c) for c in docs.columns))
