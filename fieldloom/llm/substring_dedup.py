"""Removal of repeated word windows with a count-min prefilter and an exact second pass.

A window is ``WIDTH`` consecutive words of one text.  Its anchor is the leftmost word run of
``ANCHOR`` words with the least digest inside it.  Equal windows have equal anchors at equal
offsets, so the number of places of an anchor is an upper bound of the number of equal windows
around it, and neighbouring windows share anchors: a tenth of the places needs counting.

First pass: every task counts its anchors in a count-min sketch of two rows, saturating at two;
the sketches of all tasks are merged segment by segment, in streams, into bitmaps of anchors
estimated to occur twice or more (``sketch``), about five counters per anchor up to a bound.
Estimates never fall short.
Second pass: windows whose anchor is estimated repeated are compared exactly, by 128-bit keys.
Within a block equal windows leave one row, so a passage that all documents share costs a row
per block, whatever its number.

Equal texts are one text here: of a repeated text, one row takes part and all its windows count
as repeated.  Runs of repeated windows return to the texts by digest, as a broadcast where their
measured size allows it.

Null or empty texts have no words.  Texts of fewer than ``WIDTH`` words have no window and keep
all words.  Every input row gives one result row; null and repeated ids are kept as they are.  An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm import sketch
from fieldloom.llm.shared import arrow_map, signed, stored
from fieldloom.llm.text import Block, blocks, gather_spans, mix, span_hashes
from fieldloom.session import BROADCAST_BYTES, sized_broadcast

WIDTH = 35
ANCHOR = 18
BYTES_PER_ANCHOR = 60  # of text, about; sets the size of the sketch


def _least(values: np.ndarray, reach: int) -> np.ndarray:
    """Index of the leftmost least value among ``values[i : i + reach]`` for every full range."""
    at, span = np.arange(values.size), 1
    while 2 * span <= reach:
        at, span = _better(values, at[:-span], at[span:]), 2 * span
    rest = reach - span
    return _better(values, at[: at.size - rest], at[rest:]) if rest else at


def _better(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.where(values[right] < values[left], right, left)


def _anchors(block: Block, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words of all windows, anchor place of each, digests of all anchor runs by place)."""
    starts = block.find_words().windows(width)
    n = block.starts.size
    if starts.size == 0:
        return starts, starts, np.zeros(0, np.uint64)
    at = np.arange(n - anchor + 1)
    runs = span_hashes(block.word_hashes(), at, at + anchor)
    return starts, _least(runs, width - anchor + 1)[starts], runs


def _repeated_anchors(texts: DataFrame, width: int, anchor: int, counters: int):
    """Broadcast bitmaps of the anchors that may have two places."""

    def count(batch):
        parts = []
        for block in blocks(batch.column("text")):
            _, place, runs = _anchors(block, width, anchor)
            parts.append(runs[np.unique(place)] if place.size else runs[:0])
        yield sketch.counted(np.concatenate(parts) if parts else np.zeros(0, np.uint64), counters)

    return sketch.merged(arrow_map(texts.select("text"), count, sketch.CELLS), counters)


def _runs(places: np.ndarray) -> np.ndarray:
    """Ascending places as (first, last) pairs of their runs."""
    new = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    return np.stack([places[new], places[np.append(new[1:], places.size) - 1]], 1).astype("<i4")


def _window_rows(texts: DataFrame, width: int, anchor: int, maps) -> DataFrame:
    """One row per block and window estimated repeated, and one per text with windows met within
    its block (``runs`` set, under a key of its own)."""

    def probe(batch):
        at = 0
        for block in blocks(batch.column("text")):
            text_digest = batch.column("digest").slice(at, block.n).to_numpy()
            at += block.n
            starts, place, runs = _anchors(block, width, anchor)
            starts = starts[sketch.maybe_twice(maps.value, runs[place])]
            h0 = span_hashes(block.word_hashes(), starts, starts + width)
            h1 = span_hashes(block.word_hashes(1), starts, starts + width, 1)
            text = np.searchsorted(block.first, starts, side="right") - 1
            pos = starts - block.first[text]
            order = np.lexsort((h1, h0))
            same = (h0[order][1:] == h0[order][:-1]) & (h1[order][1:] == h1[order][:-1])
            first = np.ones(starts.size, bool)
            first[order[1:]] = ~same
            near = np.zeros(starts.size, bool)
            near[order[1:]] |= same
            near[order[:-1]] |= same
            at_near = np.flatnonzero(near)
            held = np.unique(text[at_near])
            lists = np.split(pos[at_near], np.flatnonzero(np.diff(text[at_near])) + 1) if at_near.size else []
            blob = pa.array([None] * int(first.sum()) + [_runs(x).tobytes() for x in lists], pa.binary())
            own = mix(text_digest[held].view(np.uint64))
            yield {"h0": signed(np.concatenate([h0[first], own])), "h1": signed(np.concatenate([h1[first], own])),
                   "digest": np.concatenate([text_digest[text[first]], text_digest[held]]),
                   "pos": np.concatenate([pos[first], np.zeros(held.size, np.int64)]).astype(np.int32), "runs": blob}

    return arrow_map(texts.select("digest", "text"), probe,
                     {"h0": "long", "h1": "long", "digest": "long", "pos": "int", "runs": "binary"})


def repeated_windows(rows: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """(digest, runs): runs of first words of repeated windows of every text that has some.

    ``rows`` are (digest, text), equal texts once.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    maps = _repeated_anchors(rows, width, anchor, sketch.counters_for(size / BYTES_PER_ANCHOR))
    ring = Window.partitionBy("h0", "h1").orderBy("digest", "pos")
    place = F.struct("digest", "pos")
    met = (F.lag(place).over(ring) != place) | (F.lead(place).over(ring) != place)
    found = _window_rows(rows, width, anchor, maps).withColumn("met", F.coalesce(met, F.lit(False)))
    found = found.where("met OR runs IS NOT NULL").select(
        "digest", F.when(F.col("runs").isNull(), F.col("pos")).alias("pos"), "runs")
    lists = found.groupBy("digest").agg(F.collect_list("pos").alias("pos"), F.collect_list("runs").alias("runs"))

    def union(batch):
        out = []
        for pos, runs in zip(batch.column("pos"), batch.column("runs")):
            parts = [pos.values.to_numpy()]
            for raw in runs.as_py():
                a, b = np.frombuffer(raw, "<i4").reshape(-1, 2).T
                parts.append(np.repeat(a - np.cumsum(b - a + 1) + (b - a + 1), b - a + 1) + np.arange(int((b - a + 1).sum())))
            out.append(_runs(np.unique(np.concatenate(parts))).tobytes())
        yield {"digest": batch.column("digest"), "runs": pa.array(out, pa.binary())}

    return arrow_map(lists, union, {"digest": "long", "runs": "binary"})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row with the words outside repeated windows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.xxhash64("text"))
    copies = stored(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper")).where("n > 1"))
    copies = sized_broadcast(copies.select("digest", "keeper", F.lit(True).alias("copied")), copies.count(), 32)
    rows = rows.join(copies, "digest", "left")
    unique = rows.where("copied IS NULL OR keeper IS NULL OR doc_id IS NULL OR doc_id = keeper").select("digest", "text")
    runs = stored(repeated_windows(unique, width, anchor))
    size = runs.agg(F.sum(F.length("runs") + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        runs = F.broadcast(runs)
    joined = rows.join(runs, "digest", "left").select("doc_id", "text", "copied", "runs")

    def cut(batch):
        at = 0
        for block in blocks(batch.column("text")):
            copied = batch.column("copied").slice(at, block.n).fill_null(False).to_numpy(zero_copy_only=False)
            marks = batch.column("runs").slice(at, block.n).to_pylist()
            count = np.diff(block.find_words().first)
            gone = np.zeros(block.starts.size + 1, np.int32)
            for i, raw in enumerate(marks):
                if raw:
                    a, b = np.frombuffer(raw, "<i4").reshape(-1, 2).T + block.first[i]
                    np.add.at(gone, a, 1)
                    np.add.at(gone, b + width, -1)
            kept = np.cumsum(gone[:-1]) == 0
            kept &= ~np.repeat(copied & (count >= width), count)
            text = np.repeat(np.arange(block.n), count)
            left = np.bincount(text[kept], minlength=block.n)
            lengths, data = gather_spans(np.append(block.data, np.uint8(32)), block.starts[kept], block.ends[kept] + 1)
            stops = np.cumsum(lengths)
            data[stops - 1] = 32
            ends = np.append(0, stops)[np.append(0, np.cumsum(left))]
            texts = [data[a : max(a, b - 1)].tobytes() for a, b in zip(ends, ends[1:])]
            yield {"doc_id": batch.column("doc_id").slice(at, block.n), "n_words": count.astype(np.int64),
                   "n_removed": (count - left).astype(np.int64), "kept": pa.array(texts, pa.binary()).cast(pa.string())}
            at += block.n

    return arrow_map(joined, cut, {"doc_id": "long", "n_words": "long", "n_removed": "long", "kept": "string"})
