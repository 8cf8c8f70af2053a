"""Removal of repeated byte strings with a sparse suffix array sorted deep and shallow.

Every byte is removed that a string of ``WINDOW`` bytes covers which also starts in a document
with a smaller id.  Texts count as UTF-8 bytes; strings never cross documents.

Suffixes are sampled: the anchor of a window is the leftmost ``GRAM``-byte string of least digest
in it, so equal windows have equal anchors at equal offsets, and one anchor serves a range of
windows.  A count-min sketch drops anchors that occur once.  The others are rows (gram, document,
context), where the context is the text the anchor's windows span; rows with one gram meet in one
task, which

1. leaves the smallest document of equal contexts and marks the rest removed,
2. sorts the suffixes that begin at the anchors of the remaining contexts: a multikey sort over
   whole 8-byte characters to ``SHALLOW`` bytes, then blind tries, which hold only branching places, for
   groups with a longer common prefix; the longest common prefixes of neighbours come out with it,
3. reads repeated windows off: windows at offset o before the anchor are equal when their suffixes
   lie in one run of common prefixes of ``WINDOW - o`` bytes and the o bytes before agree.

Equal texts take part once, under their smallest id; the other copies are removed from
``WINDOW`` bytes on.  Within a block equal contexts leave the row of the smallest document, so a
string that all documents share costs a row per block.  A task holds the rows of one gram at a
time beside a bounded batch; a gram that a sixteenth of the documents shows to have more than ``HOT``
different contexts (a phrase with varied surroundings) is not gathered: its windows, by 128-bit
digests, are reduced to the smallest document before any shuffle.  Which grams these are changes
how the work is dealt out, never the result.

Null or empty texts have no bytes.  A null id counts as larger than every id; rows with one id
never remove each other's bytes.  Every input row gives one result row.  An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import sketch
from fieldloom.llm.dictionary import binary_array
from fieldloom.llm.shared import Batches, arrow_map, signed, stored
from fieldloom.llm.text import Block, blocks, gather_spans, mix, span_hasher
from fieldloom.session import BROADCAST_BYTES, sized_broadcast

WINDOW = 50
GRAM = 20
SHALLOW = 8  # bytes behind the gram that the shallow sort compares
BLOCK = 1 << 20  # bytes of text that a task looks at together, more only for one text
PIECE = 4 << 20  # windows of one pass over a long text
ROWS = 1 << 15  # rows that a task sorts together, more only for one gram
BYTES_PER_ANCHOR = 15  # of text, about; sets the size of the sketch
HOT = 1 << 17  # contexts of one gram that may meet in one task
PROBED = 16  # one of so many documents tells which grams are hot
LAST_ID = (1 << 63) - 1
_LOW = np.uint64((1 << 24) - 1)


def _anchors(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, gram digest) of every anchor's range, as byte places."""
    out = []
    ends = np.repeat(block.bounds[1:], np.diff(block.bounds))
    for low in range(0, max(1, block.data.size - WINDOW + 1), PIECE):
        data = block.data[low : low + PIECE + WINDOW - 1]
        if data.size < WINDOW:
            continue
        at = np.arange(data.size - GRAM + 1)
        gram = Block(at, data, np.array([0, data.size])).hashes(at, at + GRAM)
        least, span, reach = (gram & ~_LOW) | at.astype(np.uint64), 1, WINDOW - GRAM + 1
        while 2 * span <= reach:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if reach > span:
            least = np.minimum(least[: span - reach], least[reach - span :])
        start = np.flatnonzero(np.arange(low, low + least.size) + WINDOW <= ends[low : low + least.size])
        place = (least[start] & _LOW).astype(np.int64)
        new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
        last = start[np.append(new[1:], start.size)[: new.size] - 1] if new.size else start
        out.append((start[new] + low, last + low, place[new] + low, gram[place[new]]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def _repeated_grams(texts: DataFrame, counters: int):
    def count(batch):
        parts = [np.zeros(0, np.uint64)]
        for block in blocks(batch.column("text"), size=BLOCK):
            _, _, place, gram = _anchors(block)
            parts.append(gram[np.append(True, place[1:] != place[:-1])] if place.size else gram)
        yield sketch.counted(np.concatenate(parts), counters)

    return sketch.merged(arrow_map(texts.select("text"), count, sketch.CELLS), counters)


def _led_contexts(block: Block, maps, doc: np.ndarray):
    """(first, last, place, gram, text, gone): anchors estimated repeated; ``gone`` where an equal context of
    the block has a smaller document."""
    first, last, place, gram = _anchors(block)
    hit = sketch.maybe_twice(maps.value, gram)
    first, last, place, gram = first[hit], last[hit], place[hit], gram[hit]
    text = np.searchsorted(block.bounds, first, side="right") - 1
    inside = block.hashes(first, last + WINDOW, 1)
    order = np.lexsort((doc[text], inside, gram))
    new = np.append(True, (gram[order][1:] != gram[order][:-1]) | (inside[order][1:] != inside[order][:-1]))[: order.size]
    lead = doc[text[order]][np.flatnonzero(new)][np.cumsum(new) - 1] if order.size else order
    gone = np.zeros(order.size, bool)
    gone[order] = doc[text[order]] > lead
    return first, last, place, gram, text, gone


def _hot_grams(texts: DataFrame, maps, hot: int) -> np.ndarray:
    """Ascending grams with more than about ``hot`` contexts, from one of ``PROBED`` documents."""

    def count(batch):
        at = 0
        for block in blocks(batch.column("text"), size=BLOCK):
            doc = batch.column("doc").slice(at, block.n).to_numpy()
            at += block.n
            *_, gram, _, gone = _led_contexts(block, maps, doc)
            u, n = np.unique(gram[~gone], return_counts=True)
            yield {"gram": signed(u), "n": n}

    some = texts.where(F.pmod(F.xxhash64("doc"), F.lit(PROBED)) == 0).select("doc", "text")
    counts = arrow_map(some, count, {"gram": "long", "n": "long"}).groupBy("gram").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") * PROBED > hot).select("gram").toArrow()  # at most a row for each ``hot`` contexts
    return np.sort(found.column("gram").to_numpy().view(np.uint64))


def _context_rows(texts: DataFrame, maps, hot: np.ndarray) -> DataFrame:
    """(gram, doc, digest, start, left, context); rows without a context carry byte runs already
    known to be removed, in ``runs``, or one window of a hot gram, under its digest (gram, other)."""

    def probe(batch):
        at = 0
        for block in blocks(batch.column("text"), size=BLOCK):
            doc = batch.column("doc").slice(at, block.n).to_numpy()
            digest = batch.column("digest").slice(at, block.n).to_numpy()
            at += block.n
            first, last, place, gram, text, gone = _led_contexts(block, maps, doc)
            start = first - block.bounds[text]
            held, runs = _packed_runs(text[gone], start[gone], (start + last - first + WINDOW)[gone])
            spread = np.isin(gram, hot) & ~gone
            stay = ~gone & ~spread
            lengths, data = gather_spans(block.data, first[stay], last[stay] + WINDOW)
            n, m = int(stay.sum()), held.size
            none = np.zeros(m, np.int64)
            yield {"gram": signed(np.concatenate([gram[stay], mix(digest[held].view(np.uint64))])),
                   "other": pa.nulls(n + m, pa.int64()),
                   "doc": np.concatenate([doc[text[stay]], doc[held]]),
                   "digest": np.concatenate([digest[text[stay]], digest[held]]),
                   "start": np.append(start[stay], none).astype(np.int32),
                   "left": np.append((place - first)[stay], none).astype(np.int32),
                   "context": pa.concat_arrays([binary_array(lengths, data), pa.nulls(m, pa.binary())]),
                   "runs": pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(runs, pa.binary())])}
            if spread.any():
                yield _windows(block, first[spread], last[spread], doc, digest)

    return arrow_map(texts, probe, {"gram": "long", "other": "long", "doc": "long", "digest": "long", "start": "int", "left": "int",
                                    "context": "binary", "runs": "binary"})


def _windows(block: Block, first: np.ndarray, last: np.ndarray, doc: np.ndarray, digest: np.ndarray) -> dict:
    """One row per window of the given anchors; windows of one block that are equal leave all their rows."""
    count = last - first + 1
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    at = np.unique(at)
    text = np.searchsorted(block.bounds, at, side="right") - 1
    n = at.size
    return {"gram": signed(block.hashes(at, at + WINDOW)), "other": signed(block.hashes(at, at + WINDOW, 1)), "doc": doc[text],
            "digest": digest[text], "start": (at - block.bounds[text]).astype(np.int32), "left": np.zeros(n, np.int32),
            "context": pa.nulls(n, pa.binary()), "runs": pa.nulls(n, pa.binary())}


def _hot_runs(windows: DataFrame) -> DataFrame:
    """(digest, runs) of windows (gram, other) that a smaller document has too."""
    least = windows.groupBy("gram", "other").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    gone = windows.join(least.select("gram", "other", "low"), ["gram", "other"]).where("doc > low")
    lists = gone.groupBy("digest", F.expr("start DIV 65536").alias("part")).agg(F.collect_set("start").alias("starts"))

    def pack(batch):
        out = []
        for starts in batch.column("starts"):
            a = np.sort(starts.values.to_numpy()).astype(np.int64)
            out += _packed_runs(np.zeros(a.size, np.int64), a, a + WINDOW)[1]
        yield {"digest": batch.column("digest"), "runs": pa.array(out, pa.binary())}

    return arrow_map(lists, pack, {"digest": "long", "runs": "binary"})


def _packed_runs(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Per distinct key the union of its byte runs, as (start, end) pairs of 32-bit integers."""
    if key.size == 0:
        return key, []
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    border = np.append(True, key[1:] != key[:-1])
    group = np.cumsum(border) - 1
    shift = np.int64(1) << 40  # running maximum per key
    reach = np.maximum.accumulate(end + group * shift) - group * shift
    new = border | np.append(True, start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    pairs = np.stack([start[at], reach[np.append(at[1:], key.size) - 1]], 1).astype("<i4")
    cut = np.flatnonzero(border[at])
    return key[border], [p.tobytes() for p in np.split(pairs, cut[1:])]


class _Node:
    __slots__ = ("depth", "edge")

    def __init__(self, depth: int) -> None:
        self.depth, self.edge = depth, {}


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """(order, lcp): sorted order of the strings and each one's common prefix with the one before.

    Inner nodes hold a branching depth and the branching bytes only.  A string goes down by these
    bytes without looking at what lies between, is compared once with the string it arrives at,
    and is put in where that comparison says.  A string's end sorts first (byte -1).
    """
    root: _Node | list[int] = [0]
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while isinstance(node, _Node):
            c = s[node.depth] if node.depth < len(s) else -1
            node = node.edge.get(c) or next(iter(node.edge.values()))
        t = strings[node[0]]
        same, most = 0, min(len(s), len(t))
        while same < most and s[same] == t[same]:
            same += 1
        if same == len(s) == len(t):
            node.append(i)
            continue
        above, way, node = None, -1, root
        while isinstance(node, _Node) and node.depth < same:
            above, way = node, s[node.depth]
            node = node.edge[way]
        mine = s[same] if same < len(s) else -1
        if isinstance(node, _Node) and node.depth == same:
            node.edge[mine] = [i]
            continue
        split = _Node(same)
        split.edge[t[same] if same < len(t) else -1] = node
        split.edge[mine] = [i]
        if above is None:
            root = split
        else:
            above.edge[way] = split
    order: list[int] = []
    lcp: list[int] = []
    stack: list[tuple[_Node | list[int], int]] = [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node, _Node):
            edges = sorted(node.edge.items(), reverse=True)
            stack += [(child, node.depth) for _, child in edges[:-1]]
            stack.append((edges[-1][1], shared))
        else:
            for k, i in enumerate(node):
                order.append(i)
                lcp.append(shared if k == 0 else len(strings[i]))
    return order, lcp


def _multikey(group: np.ndarray, lengths: np.ndarray, starts: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): strings of ascending groups ordered by their first ``SHALLOW`` bytes.

    Multikey quicksort with all ranges partitioned at once: a step compares one byte of every string of
    every open range with its range's pivot and deals the range into less, equal and greater; the
    equal part goes on at the next byte, the others at the same.  An end counts as -1.
    ``shared`` is the number of bytes in common with the string before in its group, and
    ``SHALLOW`` + 1 where all compared bytes and the ends agree.
    """
    n = group.size
    order = np.arange(n)
    shared = np.zeros(n, np.int64)
    new = np.append(True, group[1:] != group[:-1])[:n]  # borders of final ranges
    where = np.arange(n)  # places of open ranges, side by side
    rank = np.cumsum(new) - 1  # open range of every place in ``where``
    depth = np.zeros(rank[-1] + 1 if n else 0, np.int64)
    while where.size:
        at = order[where]
        d = depth[rank]
        byte = np.where(d < lengths[at], data[starts[at] + np.minimum(d, SHALLOW - 1)].astype(np.int16), -1)
        begin = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
        size = np.diff(np.append(begin, where.size))
        pivot = byte[begin + size // 2][rank]
        side = np.sign(byte - pivot).astype(np.int64)
        by = np.argsort(rank * 3 + side + 1, kind="stable")
        order[where] = at[by]
        byte, side, key = byte[by], side[by], (rank * 3 + side + 1)[by]
        first = np.append(True, key[1:] != key[:-1])
        part = np.cumsum(first) - 1
        head = np.flatnonzero(first)
        count = np.diff(np.append(head, where.size))
        into = depth[rank[head]]
        inner = head[~np.append(True, rank[head][1:] != rank[head][:-1])]  # not the first part of their range
        shared[where[inner]] = depth[rank[inner]]
        equal = side[head] == 0
        ended = equal & ((byte[head] < 0) | (into + 1 >= SHALLOW))
        rest = np.repeat(ended & (count > 1), count)
        rest[head] = False
        shared[where[rest]] = SHALLOW + 1
        go = ~ended & (count > 1)
        stay = np.repeat(go, count)
        depth = (into + equal)[go]
        rank = (np.cumsum(go) - 1)[part[stay]]
        where = where[stay]
    return order, shared


def sort_suffixes(group: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of strings, ordered within ascending groups, by a shallow and a deep sort.

    ``lcp`` is the common prefix with the string before in its group, 0 for the first of a group.
    """
    n = group.size
    starts = np.cumsum(lengths) - lengths
    padded = np.concatenate([data, np.zeros(SHALLOW, np.uint8)])
    order, shared = _multikey(group, lengths, starts, padded)
    g, s = group[order], np.minimum(lengths[order], SHALLOW)
    tie = np.zeros(n, bool)
    tie[1:] = (g[1:] == g[:-1]) & (shared[1:] > np.maximum(s[1:], s[:-1]))
    lcp = np.where(tie, s, shared)
    head = np.flatnonzero(~tie & np.append(tie[1:], False))
    stop = np.flatnonzero(tie & ~np.append(tie[1:], False)) + 1
    raw = data.tobytes()
    for a, b in zip(head.tolist(), stop.tolist()):
        if s[a] < SHALLOW:
            lcp[a + 1 : b] = s[a]
            continue
        members = order[a:b]
        rest = [raw[p + SHALLOW : p + m] for p, m in zip(starts[members].tolist(), lengths[members].tolist())]
        inner, common = blind_trie(rest)
        order[a:b] = members[inner]
        lcp[a + 1 : b] = np.array(common[1:]) + SHALLOW
    return order, lcp


def _removed(gram: np.ndarray, doc: np.ndarray, digest: np.ndarray, start: np.ndarray, left: np.ndarray,
             lengths: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, start, end) of removed runs of complete groups of rows with one gram each."""
    begin = np.cumsum(lengths) - lengths
    inside = Block(begin, data, np.array([0, data.size])).hashes(begin, begin + lengths)
    order = np.lexsort((doc, inside, gram))
    g, h = gram[order], inside[order]
    new = np.append(True, (g[1:] != g[:-1]) | (h[1:] != h[:-1]))
    which = np.cumsum(new) - 1
    kind = np.empty(order.size, np.int64)
    kind[order] = which
    u = order[new]  # the row of the smallest document for every distinct context
    least = doc[u]
    gone = doc > least[kind]
    out = [(digest[gone], start[gone], (start + lengths)[gone])]

    ug = gram[u]
    fresh = np.append(True, ug[1:] != ug[:-1])
    group = np.cumsum(fresh) - 1
    mixed = np.bincount(group)[group] > 1
    m = np.flatnonzero(mixed)
    if m.size:
        um, gm = u[m], group[m]
        anchor = begin[um] + left[um]
        n, suffix = gather_spans(data, anchor + GRAM, begin[um] + lengths[um])
        order, lcp = sort_suffixes(gm, n, suffix)
        lcp += GRAM
        lcp[np.append(True, gm[order][1:] != gm[order][:-1])] = 0
        right = n[order] + GRAM
        offset = left[um][order].astype(np.int64)
        anchor, low = anchor[order], least[m][order]
        flag = np.zeros((order.size, WINDOW - GRAM + 1), bool)
        left_digest = span_hasher(data.astype(np.uint64) + np.uint64(1), 1)
        for o in range(WINDOW - GRAM + 1):
            run = np.cumsum(lcp < WINDOW - o)
            has = np.flatnonzero((offset >= o) & (right >= WINDOW - o))
            if has.size < 2:
                continue
            before = left_digest(anchor[has] - o, anchor[has])
            key = mix(before ^ mix(run[has].astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)))
            by = np.argsort(key, kind="stable")
            edge = np.append(True, key[by][1:] != key[by][:-1])
            smallest = np.minimum.reduceat(low[has][by], np.flatnonzero(edge))[np.cumsum(edge) - 1]
            flag[has[by], o] = low[has][by] > smallest
        spot = np.full(u.size, -1)
        spot[m[order]] = np.arange(order.size)
        rows = np.flatnonzero(~gone & (spot[kind] >= 0))
        row, o = np.nonzero(flag[spot[kind[rows]]])
        row = rows[row]
        a = start[row] + left[row] - o
        out.append((digest[row], a, a + WINDOW))
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def _sorted_groups(batches: Batches) -> Batches:
    """Byte runs to remove, from rows that come in order of their gram."""
    held: list[pa.RecordBatch] = []
    count = 0

    def flush(table: pa.Table):
        known = table.filter(table["runs"].is_valid())
        rows = table.filter(table["runs"].is_null()).combine_chunks()
        if known.num_rows:
            yield pa.RecordBatch.from_arrays([known["digest"].combine_chunks(), known["runs"].combine_chunks()], names=["digest", "runs"])
        if rows.num_rows:
            context = pa.chunked_array(rows["context"]).combine_chunks().cast(pa.large_binary())
            bounds = np.frombuffer(context.buffers()[1], np.int64, len(context) + 1, context.offset * 8)
            data = np.frombuffer(context.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
            cols = [rows[c].to_numpy() for c in ("gram", "doc", "digest", "start", "left")]
            digest, a, b = _removed(*cols, np.diff(bounds), data)
            key, runs = _packed_runs(digest, a.astype(np.int64), b.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(runs, pa.binary())], names=["digest", "runs"])

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= ROWS:
            table = pa.Table.from_batches(held)
            gram = table["gram"].to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on
            yield from flush(table.slice(0, cut))
            held, count = table.slice(cut).to_batches(), table.num_rows - cut
    if held:
        yield from flush(pa.Table.from_batches(held))


def repeated_bytes(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """(digest, runs): byte runs to remove of every text; ``rows`` are (doc, digest, text), texts once."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    maps = _repeated_grams(rows, sketch.counters_for(size / BYTES_PER_ANCHOR))
    grams = _hot_grams(rows, maps, hot)
    found = _context_rows(rows.select("doc", "digest", "text"), maps, grams)
    if grams.size:
        found = stored(found)
    columns = ["gram", "doc", "digest", "start", "left", "context", "runs"]
    cold = found.where("other IS NULL").select(*columns) if grams.size else found.select(*columns)
    parts = cold.repartition("gram").sortWithinPartitions("gram").mapInArrow(_sorted_groups, "digest long, runs binary")
    if grams.size:
        parts = parts.unionByName(_hot_runs(found.where("other IS NOT NULL").select("gram", "other", "doc", "digest", "start")))
    lists = parts.groupBy("digest").agg(F.collect_list("runs").alias("runs"))

    def union(batch):
        out = []
        for runs in batch.column("runs").to_pylist():
            a, b = np.frombuffer(b"".join(runs), "<i4").reshape(-1, 2).T.astype(np.int64)
            out += _packed_runs(np.zeros(a.size, np.int64), a, b)[1]
        yield {"digest": batch.column("digest"), "runs": pa.array(out, pa.binary())}

    return arrow_map(lists, union, {"digest": "long", "runs": "binary"})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` are the remaining bytes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(LAST_ID))).withColumn("digest", F.xxhash64("text"))
    copies = stored(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc").alias("keeper")).where("n > 1"))
    copies = sized_broadcast(copies.select("digest", "keeper"), copies.count(), 32)
    rows = rows.join(copies, "digest", "left").withColumn("copied", F.coalesce(F.col("doc") > F.col("keeper"), F.lit(False)))
    runs = stored(repeated_bytes(rows.where("NOT copied"), hot))
    size = runs.agg(F.sum(F.length("runs") + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        runs = F.broadcast(runs)
    joined = rows.join(runs, "digest", "left").select("doc_id", "text", "copied", "runs")

    def cut(batch):
        for part in [batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)]:
            total, removed, spans, kept = [], [], [], []
            for text, copied, raw in zip(*(part.column(c).to_pylist() for c in ("text", "copied", "runs"))):
                data = text.encode()
                pairs = [(0, len(data))] if copied and len(data) >= WINDOW else np.frombuffer(raw or b"", "<i4").reshape(-1, 2).tolist()
                stay, done = [], 0
                for a, b in pairs:
                    stay.append(data[done:a])
                    done = b
                left = b"".join(stay) + data[done:]
                total.append(len(data))
                removed.append(len(data) - len(left))
                spans.append(len(pairs))
                kept.append(left)
            yield {"doc_id": part.column("doc_id"), "n_bytes": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                   "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())}

    return arrow_map(joined, cut, {"doc_id": "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary"})
