"""Benchmark decontamination with SimHash windows and multi-index Hamming search, in DataFrame
functions only.

Texts are lower-cased, characters other than letters and digits are dropped, and words are cut
at white space.  A window of a document is as long as an item and placed where one of an item's
five-word shingles falls on the same offset, cut off at the ends of the text; a window without
any such shingle has similarity 0 to all items.

The similarity of a window and an item is exact: weights of shared over weights of all distinct
shingles, where a shingle in few items weighs more (``round(1000 ln(1 + N / df))``; one in no item
counts as in one).  A pair matches at ``PERCENT`` percent.

Candidates come from fingerprints alone.  A fingerprint has ``WORDS`` words of 64 bits; a bit is the
majority of the distinct shingles' digests, each voting with the root of its weight.  Two sets of
weighted similarity t then have an angle of at most arccos(2t / (1 + t)), so each bit differs with
probability p = arccos(2t / (1 + t)) / pi at most, and ``RADIUS`` is the mean of ``BITS`` such bits
plus three deviations: about one pair in a thousand at exactly the threshold is farther apart, and
none that matter well above it.  Fingerprints are cut into ``RADIUS`` + 1 blocks; two within the radius
agree on one whole block, so windows meet the items of their own length through the blocks, and
the distance is tested before the similarity is computed.

The benchmark is broadcast when its counted shingles are small, and shuffled otherwise.  Windows
of equal words are compared once, whatever the number of documents that hold them.

Items of fewer than five words and null items are too short to identify and match nothing; items
under the same id count as separate items.  Null or empty texts match nothing.  Null document
ids stay as a null id.  Repeated rows add nothing.  Empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.quality_rules import GAPS, words_of
from fieldloom.llm.shared import stored
from fieldloom.session import sized_broadcast

WIDTH = 5
PERCENT = 80
WORDS = 2
BITS = 64 * WORDS
_P = math.acos(2 * PERCENT / (100 + PERCENT)) / math.pi  # a bit differs at the threshold
RADIUS = math.ceil(BITS * _P + 3 * math.sqrt(BITS * _P * (1 - _P)))
VOTE = 8  # votes are whole numbers of an eighth
LANES = 2  # sums of 31 bits that share one counter


def normal_words(text: Column) -> Column:
    return words_of(F.regexp_replace(F.lower(text), f"[^\\p{{L}}\\p{{N}}{GAPS}]+", ""))


def _shingles(hashes: str) -> Column:
    """Shingle digests from the digests of all words of a text."""
    five = ", ".join(f"{hashes}[i + {k}]" for k in range(WIDTH))
    return F.expr(f"CASE WHEN size({hashes}) < {WIDTH} THEN array() "
                  f"ELSE transform(sequence(0, size({hashes}) - {WIDTH}), i -> xxhash64({five})) END")


def _with_hashes(df: DataFrame, words: str) -> DataFrame:
    return df.withColumn("wh", F.transform(words, lambda x: F.xxhash64(x)))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = benchmark.select(F.col(id_col).alias("item_id"), normal_words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    rows = rows.where(F.size("w") >= WIDTH).distinct()
    return _with_hashes(rows, "w").select(
        "item_id", "w", F.size("w").alias("n"), F.xxhash64("item_id", "w").alias("item"), _shingles("wh").alias("sh"))


def _fingerprints(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with ``fp`` (array of words) of rows (keys, s, weight): weighted majority of every bit.

    Bits are summed ``LANES`` at a time: a vote is below 2**10, so a lane holds two million shingles.
    """
    step = 63 // LANES
    vote = F.round(F.sqrt("weight") * VOTE).cast("long")
    rows = shingles.select(*keys, vote.alias("vote"), *[F.xxhash64(F.lit(w), "s").alias(f"h{w}") for w in range(WORDS)])
    sums = []
    for w in range(WORDS):
        for at in range(0, 64, LANES):
            lanes = [F.shiftleft(F.shiftright(f"h{w}", at + k).bitwiseAND(F.lit(1).cast("long")) * F.col("vote"), step * k)
                     for k in range(LANES)]
            sums.append(F.sum(reduce(lambda a, b: a + b, lanes)).alias(f"c{w}_{at // LANES}"))
    counted = rows.groupBy(*keys).agg(F.sum("vote").alias("c"), *sums)
    words = []
    for w in range(WORDS):
        ones = []
        for b in range(64):
            lane = F.shiftright(f"c{w}_{b // LANES}", step * (b % LANES)).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
            ones.append(F.shiftleft((2 * lane > F.col("c")).cast("long"), b))
        words.append(reduce(lambda a, b: a.bitwiseOR(b), ones))
    return counted.select(*keys, F.array(*words).alias("fp"))


def _distance(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(a)[w].bitwiseXOR(F.col(b)[w])) for w in range(WORDS)])


def _blocks(fp: str) -> Column:
    """Values of the RADIUS + 1 blocks of a fingerprint; a block may span two words."""
    cut = []
    for k in range(RADIUS + 1):
        a, b = BITS * k // (RADIUS + 1), BITS * (k + 1) // (RADIUS + 1)
        parts, at = [], 0
        while a < b:
            w, low = divmod(a, 64)
            n = min(b - a, 64 - low)
            bits = F.shiftrightunsigned(F.col(fp)[w], low).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
            parts.append(F.shiftleft(bits, at))
            a, at = a + n, at + n
        cut.append(reduce(lambda x, y: x.bitwiseOR(y), parts))
    return F.posexplode(F.array(*cut)).alias("block", "value")


def windows(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, first_word, n, window, wid): the windows of item length n placed by shared shingles."""
    places = items.select("n", F.posexplode("sh").alias("offset", "s")).distinct()
    places = sized_broadcast(places, places.count(), 32)
    rows = docs.select(F.col(id_col).alias("doc_id"), normal_words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    rows = _with_hashes(rows, "w").select("doc_id", "w", F.posexplode(_shingles("wh")).alias("i", "s"))
    found = rows.join(places, "s").withColumn("start", F.col("i") - F.col("offset"))
    first = F.greatest(F.col("start"), F.lit(0))
    until = F.least(F.col("start") + F.col("n"), F.size("w"))
    cut = found.select("doc_id", first.alias("first_word"), "n", F.slice("w", first + 1, until - first).alias("window"))
    return cut.distinct().withColumn("wid", F.md5(F.array_join("window", " ")))


def _weighted(rows: DataFrame, weights: DataFrame, total: int) -> DataFrame:
    """Rows with a shingle ``s`` and its weight; one that is in no item counts as in one."""
    lone = F.round(1000 * F.log1p(F.lit(float(total)))).cast("long")
    return rows.join(weights, "s", "left").withColumn("weight", F.coalesce("weight", lone))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): every window that matches an item."""
    items = stored(_items(benchmark, item_id, item_text))
    total = items.count()
    found = stored(windows(docs, items, id_col, text_col))

    per_item = items.select("item", F.explode(F.array_distinct("sh")).alias("s"))
    weight = F.round(1000 * F.log1p(F.lit(total) / F.col("df"))).cast("long")
    weights = per_item.groupBy("s").agg(F.count("*").alias("df")).select("s", weight.alias("weight"))
    weights = stored(weights)
    weights = sized_broadcast(weights, weights.count(), 16)
    per_item = per_item.join(weights, "s")

    contents = found.groupBy("n", "wid").agg(F.first("window").alias("window"))
    asked = _with_hashes(contents, "window").select("n", "wid", F.explode(F.array_distinct(_shingles("wh"))).alias("s"))
    asked = stored(_weighted(asked, weights, total))
    prints = stored(_fingerprints(asked, ["n", "wid"]))
    known = items.join(_fingerprints(per_item, ["item"]), "item").select("item", "n", F.col("fp").alias("item_fp"))
    known = sized_broadcast(known.select("*", _blocks("item_fp")), total * (RADIUS + 1), 64)
    near = prints.select("*", _blocks("fp")).join(known, ["n", "block", "value"])
    near = stored(near.where(_distance("fp", "item_fp") <= RADIUS).select("n", "wid", "item").distinct())

    held = per_item.groupBy("item").agg(F.sum("weight").alias("of_item"))
    of_window = asked.groupBy("n", "wid").agg(F.sum("weight").alias("of_window"))
    common = near.join(asked, ["n", "wid"]).join(per_item.select("item", "s"), ["item", "s"])
    common = common.groupBy("n", "wid", "item").agg(F.sum("weight").alias("common"))
    scored = common.join(of_window, ["n", "wid"]).join(held, "item")
    union = F.col("of_window") + F.col("of_item") - F.col("common")
    matched = scored.where(100 * F.col("common") >= PERCENT * union).select(
        "n", "wid", "item", (F.col("common") / union).alias("similarity"))
    matched = matched.join(items.select("item", "item_id"), "item").select("n", "wid", "item_id", "similarity")
    return found.join(matched, ["n", "wid"]).select(
        "doc_id", "item_id", "first_word", F.size("window").alias("n_words"), "similarity").distinct()


def leaked_items(leaks: DataFrame) -> DataFrame:
    """One row per document and item: matching windows, the first of them, the best similarity."""
    return leaks.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_windows"), F.min("first_word").cast("long").alias("first_word"),
        F.round(F.max("similarity"), 6).alias("similarity"))
