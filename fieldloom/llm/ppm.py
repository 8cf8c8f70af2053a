"""Language-model scores by prediction by partial matching over byte contexts.

The model text of a document is its words in lower case (A-Z), joined by one blank, and an end.
Its symbols are coded one by one.  The coder looks for the longest context (up to ``ORDER``
preceding symbols of the same text) in a trie of training contexts and estimates with method D:
a symbol met c times in a context with n symbols, d of them distinct, has (2c - 1) / 2n, and
d / 2n is the escape to the next shorter context, where symbols already ruled out by the longer
ones are excluded from n and d.  Below the empty context all 256 symbols left are equally
likely.  The score is the log10 probability of the model text.

Counts of symbols in contexts are taken over all training text, and every context met there is
a node, so the trie grows with the text and is held by no task.  Distinct grams (a symbol with
its longest context) leave each chunk of documents with their counts, dealt by the ``SHARED`` + 1
nearest symbols of the context: a context and its shorter ones down to ``SHARED`` + 1 symbols meet in one
task.  Shorter contexts, at most 256 ** (``SHARED`` + 1) counts, are broadcast.  Codelengths with
exclusion are worked out once per distinct gram and go back to the chunks that hold it.

Beside it stands a unigram base with add-0.1 smoothing.  Its counts are of unbounded number;
they come from one shuffle of the distinct words of all chunks and return to the chunks.

Null or empty texts consist of the end only.  A null id counts as the empty text when documents
are held out.  Every input row gives one result row; repeated ids are kept.  An empty table gives
an empty result, a table without training rows scores by uniform symbols.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.dictionary import chunks, pack_codes, unpack_codes
from fieldloom.llm.shared import Batches, stored
from fieldloom.llm.text import BLOCK_BYTES, Block, gather_spans, mix

ORDER = 6  # at most 6, so that a gram fits in 56 bits
SHARED = 2  # contexts up to this length are known to every task
END = 10  # a gap byte, so no word contains it
BLANK = 32
HELD_OUT = "crc32(coalesce(cast(doc_id AS string), '')) % 10 = 0"


def symbols(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(model text of all texts of a lower-case block, first place of each text and the end)."""
    count = np.diff(block.find_words().first)
    lengths, data = gather_spans(np.append(block.data, np.uint8(BLANK)), block.starts, block.ends + 1)
    stops = np.cumsum(lengths)
    data[stops - 1] = BLANK
    some = count > 0
    data[stops[block.first[1:][some] - 1] - 1] = END
    ends = np.append(0, stops)[block.first[1:]]
    data = np.insert(data, ends[~some], END)
    return data, np.append(0, ends + np.cumsum(~some))


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """Every symbol with its longest context: symbol in the low byte, nearer context bytes above
    it, and the context's length on top."""
    after = np.append(0, np.maximum.accumulate(np.where(data == END, np.arange(1, data.size + 1), 0))[:-1])
    length = np.minimum(np.arange(data.size) - after + 1, order)  # the end before the text counts
    one = np.concatenate([np.full(ORDER, END, np.uint8), data]).astype(np.int64)
    two = one[1:] | one[:-1] << 8
    four = two[2:] | two[:-2] << 16
    code = four[3:] | two[1:-4] << 32 | one[: data.size] << 48
    known = np.arange(order + 1)
    code &= ((1 << (8 * (known + 1))) - 1)[length]
    code |= (known << 56)[length]
    return code


class Model:
    """A small trie with the log10 probability of every symbol in every node, in one piece.

    The dense form of what :func:`score` works out by joins; tests hold one to the other."""

    def __init__(self, counts: dict[str, np.ndarray], order: int = ORDER):
        self.order = order
        seen = np.unique(np.append(counts["symbol"], END)).astype(np.int64)
        self.column = np.full(256, seen.size, np.int64)  # the last column stands for every other byte
        self.column[seen] = np.arange(seen.size)
        self.width = seen.size + 1
        keys = [np.unique(counts["context"][counts["k"] == k]) for k in range(order + 1)]
        if keys[0].size == 0:
            keys[0] = np.zeros(1, np.int64)
        base = np.cumsum([0] + [x.size for x in keys])
        self.dead = int(base[-1])
        tallies = []
        for k in range(order + 1):
            pick = counts["k"] == k
            tally = np.zeros((keys[k].size, self.width))
            np.add.at(tally, (np.searchsorted(keys[k], counts["context"][pick]), self.column[counts["symbol"][pick]]),
                      counts["n"][pick])
            tallies.append(tally)
        self.next = np.full((self.dead + 1, self.width), self.dead, np.int32)
        for k in range(1, order + 1):
            farthest = self.column[(keys[k] >> (8 * (k - 1))) & 0xFF]
            parent = np.searchsorted(keys[k - 1], keys[k] & ((1 << (8 * (k - 1))) - 1))
            self.next[base[k - 1] + parent, farthest] = base[k] + np.arange(keys[k].size)
        self.logp = np.empty((self.dead + 1, self.width), np.float32)
        for k in range(order + 1):
            for low in range(0, keys[k].size, 4096):
                some = keys[k][low : low + 4096]
                chain = [np.searchsorted(keys[j], some & ((1 << (8 * j)) - 1)) for j in range(k + 1)]
                self.logp[base[k] + low : base[k] + low + some.size] = self._estimates(tallies, chain)
        self.logp[self.dead] = self.logp[0]

    def _estimates(self, tallies: list[np.ndarray], chain: list[np.ndarray]) -> np.ndarray:
        """Method D with exclusion, from the longest context of each node down to none."""
        n = chain[0].size
        out, escape = np.zeros((n, self.width)), np.zeros((n, 1))
        left = np.ones((n, self.width), bool)
        for j in range(len(chain) - 1, -1, -1):
            c = np.where(left, tallies[j][chain[j]], 0)
            total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            hit = c > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                scale = np.log10(np.maximum(2 * total, 1))
                out = np.where(hit, escape + np.log10(2 * c - 1) - scale, out)
                escape = escape + np.where(kinds > 0, np.log10(np.maximum(kinds, 1)) - scale, 0)
            left &= ~hit
        others = 256 - (self.width - 1)
        rest = left[:, :-1].sum(1, keepdims=True) + others
        return np.where(left, escape - np.log10(np.maximum(rest, 1)), out)

    def scores(self, block: Block) -> np.ndarray:
        """log10 probability of the model text of every text of a lower-case block."""
        data, first = symbols(block)
        column = self.column[np.concatenate([np.full(self.order, END, np.uint8), data])].astype(np.int32)
        flat = self.next.reshape(-1)
        at = np.zeros(data.size, np.int32)
        best = at
        for k in range(1, self.order + 1):
            at = flat[at.astype(np.int64) * self.width + column[self.order - k : self.order - k + data.size]]
            best = np.where(at == self.dead, best, at)
        each = self.logp.reshape(-1)[best.astype(np.int64) * self.width + column[self.order :]]
        return np.add.reduceat(each.astype(np.float64), first[:-1]) if data.size else np.zeros(0)


def _words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    block.find_words()
    return block.starts, block.ends, np.diff(block.first)


def _model_texts(chunk: pa.RecordBatch | pa.Table, i: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(model texts, first place of each text and the end, number of the first text) of pieces of a
    chunk of at most ``BLOCK_BYTES`` or one text."""
    tokens = chunk.column("tokens")[i].values.cast(pa.large_binary())
    bounds = np.frombuffer(tokens.buffers()[1], np.int64, len(tokens) + 1, tokens.offset * 8) if len(tokens) else np.zeros(1, np.int64)
    raw = np.frombuffer(tokens.buffers()[2], np.uint8)[: bounds[-1]] if bounds[-1] else np.zeros(0, np.uint8)
    raw = np.append(raw, np.uint8(BLANK))
    codes = unpack_codes(chunk.column("codes")[i].as_py())
    counts = chunk.column("counts")[i].values.to_numpy().astype(np.int64)
    word = np.append(0, np.cumsum(counts))
    size = np.append(0, np.cumsum(bounds[1:][codes] - bounds[:-1][codes] + 1))[word]
    size += np.arange(size.size)
    low = 0
    while low < counts.size:
        high = max(low + 1, int(np.searchsorted(size, size[low] + BLOCK_BYTES, side="right")) - 1)
        some, count = codes[word[low] : word[high]], counts[low:high]
        lengths, data = gather_spans(raw, bounds[:-1][some], bounds[1:][some] + 1)
        stops = np.cumsum(lengths)
        data[stops - 1] = BLANK
        last = np.cumsum(count)
        data[stops[last[count > 0] - 1] - 1] = END
        ends = np.append(0, stops)[last]
        data = np.insert(data, ends[count == 0], END)
        yield data, np.append(0, ends + np.cumsum(count == 0)), low
        low = high


def _packed_grams(code: np.ndarray) -> bytes:
    """Ascending grams as compressed byte planes of their differences."""
    planes = np.diff(code, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpacked_grams(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<i8"))


def _tally(code: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and how many of each are marked; the mark is sorted along as a low bit, as no
    places are wanted back."""
    both = np.sort(code << 1 | marked)
    own = both >> 1
    border = np.flatnonzero(np.diff(own, prepend=-1))
    upto = np.append(0, np.cumsum(both & 1))
    return own[border], upto[np.append(border[1:], both.size)] - upto[border]


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their sums; a stable sort merges codes that come in ascending runs."""
    by = np.argsort(code, kind="stable")
    code = code[by]
    border = np.flatnonzero(np.diff(code, prepend=-1))
    return code[border], np.add.reduceat(n[by], border).astype(np.int64) if border.size else np.zeros(0, np.int64)


def _short(code: np.ndarray, n: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of symbols in contexts up to ``longest``, the context's length on top of the code."""
    met = np.zeros(256, bool)
    for k in range(longest + 1):
        met[code >> (8 * k) & 0xFF] = True
    byte = np.flatnonzero(met)
    rank, out = np.cumsum(met) - 1, []
    for k in range(longest + 1):
        has = (n > 0) & (code >> 56 >= k)
        at = np.zeros(int(has.sum()), np.int64)
        for j in range(k, -1, -1):
            at = at * byte.size + rank[code[has] >> (8 * j) & 0xFF]
        tally = np.bincount(at, weights=n[has])
        cell = np.flatnonzero(tally)
        short = np.full(cell.size, k << 56)
        for j in range(k + 1):
            short |= byte[cell // byte.size**j % byte.size] << (8 * j)
        out.append((short, tally[cell].astype(np.int64)))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def chunk_grams(chunked: DataFrame, parts: int, order: int) -> DataFrame:
    """(chunk, part, code, n): packed distinct grams of every chunk with their counts in training
    texts; part -1 has the counts of contexts up to ``SHARED``."""

    def count(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                marks = batch.column("figures")[i].values.to_numpy() > 0
                pieces = [_tally(_grams(data, order), np.repeat(marks[low : low + first.size - 1], np.diff(first)))
                          for data, first, low in _model_texts(batch, i)]
                code, n = _summed(*(np.concatenate(x) for x in zip(*pieces)))
                chunk = batch.column("chunk")[i].as_py()
                short = _short(code, n, min(SHARED, order))
                near = mix((code >> 8 & _mask(SHARED + 1)).astype(np.uint64)) % np.uint64(parts)
                near = near.astype(np.min_scalar_type(parts))
                by = np.argsort(near, kind="stable")
                border = np.searchsorted(near[by], np.arange(parts + 1, dtype=near.dtype))
                rows = [(-1, *short)] + [(p, code[by[a:b]], n[by[a:b]]) for p, (a, b) in enumerate(zip(border, border[1:])) if a < b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
                     pa.array([_packed_grams(r[1]) for r in rows], pa.binary()),
                     pa.array([zstandard.compress(r[2].astype("<u4").tobytes(), 1) for r in rows], pa.binary())],
                    names=["chunk", "part", "code", "n"])

    return chunked.select("chunk", "counts", "codes", "tokens", "figures").mapInArrow(
        count, "chunk long, part long, code binary, n binary")


def short_counts(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the symbols in contexts up to ``SHARED``: (code with the context's length on top, n)."""

    def opened(batches: Batches) -> Batches:
        for batch in batches:
            for code, n in zip(batch.column("code").to_pylist(), batch.column("n").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(_unpacked_grams(code)), pa.array(_counts(n))], names=["code", "n"])

    rows = grams.where("part = -1").select("code", "n").mapInArrow(opened, "code long, n long")
    table = rows.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return table["code"].to_numpy(), table["n"].to_numpy()


def _counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), "<u4").astype(np.int64)


def _mask(k: int) -> int:
    return (1 << (8 * k)) - 1


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, place) of every wanted value."""
    at = np.searchsorted(sorted_, wanted)
    at[at == sorted_.size] = 0
    return (sorted_[at] == wanted) if sorted_.size else np.zeros(wanted.size, bool), at


class _Level:
    """Contexts of one length with their symbols, and the costs of the next shorter context once the
    symbols met here are ruled out."""

    def __init__(self, k: int, code: np.ndarray, n: np.ndarray, above: _Level | None, least: int):
        pairs, n = _summed(code, n)
        border = np.flatnonzero(np.diff(pairs >> 8, prepend=-1))
        kinds = np.diff(np.append(border, pairs.size))
        keep = np.add.reduceat(n, border) >= least if border.size else np.zeros(0, bool)
        inside = np.repeat(keep, kinds)
        self.pairs, self.n, self.kinds = pairs[inside], n[inside], kinds[keep]
        border = np.cumsum(self.kinds) - self.kinds
        self.contexts = self.pairs[border] >> 8
        self.total = np.add.reduceat(self.n, border) if border.size else np.zeros(0, np.int64)
        if above is not None:
            met = above.n[np.searchsorted(above.pairs, self.pairs & _mask(k))]
            at = np.searchsorted(above.contexts, self.contexts & _mask(k - 1))
            left = above.total[at] - (np.add.reduceat(met, border) if border.size else 0)
            others = above.kinds[at] - self.kinds
            self.scale = np.log10(np.maximum(2 * left, 1))
            self.escape = np.where(others > 0, np.log10(np.maximum(others, 1)) - self.scale, 0.0)


def _levels(code: np.ndarray, n: np.ndarray, lengths: range, above: _Level | None, least: int) -> list[_Level]:
    out = []
    for k in lengths:
        has = (n > 0) & (code >> 56 >= k)
        above = _Level(k, code[has] & _mask(k + 1), n[has], above, least)
        out.append(above)
    return out


def gram_logs(code: np.ndarray, levels: list[_Level]) -> np.ndarray:
    """log10 probability of every gram by method D with exclusion."""
    out = np.zeros(code.size)
    open_ = np.arange(code.size)
    child = np.full(code.size, -1)  # the context one symbol longer, if it is a node
    for k in range(len(levels) - 1, -1, -1):
        level, longer = levels[k], levels[k + 1] if k + 1 < len(levels) else None
        some = open_[code[open_] >> 56 >= k]
        node, at = _find(level.contexts, code[some] >> 8 & _mask(k))
        some, at = some[node], at[node]
        hit, pair = _find(level.pairs, code[some] & _mask(k + 1))
        scale = np.log10(2 * level.total[at])
        escape = np.log10(level.kinds[at]) - scale
        if longer is not None:
            deep = child[some] >= 0
            scale[deep], escape[deep] = longer.scale[child[some[deep]]], longer.escape[child[some[deep]]]
        met = np.zeros(some.size)
        met[hit] = np.log10(2 * level.n[pair[hit]] - 1)
        out[some] += np.where(hit, met - scale, escape)
        child[some] = at
        child[some[hit]] = -2  # done
        open_ = open_[child[open_] != -2]
    seen = int(levels[0].kinds[0]) if levels[0].kinds.size else 0
    out[open_] -= np.log10(max(256 - seen, 1))
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: str = HELD_OUT,
          order: int = ORDER, share: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``share`` asks for a smaller trie, of the contexts with 1 / ``share`` of the training symbols.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("train", ~F.expr(held_out))
    chunked = stored(chunks(rows, _words, lower=True, mark_col="train", figure=lambda block, mark: mark.astype(float)))
    grams = stored(chunk_grams(chunked, max(12, chunked.count()), order))
    code, n = short_counts(grams)
    total = int(n[code >> 56 == 0].sum())
    least = 1 if share is None else max(1, -(-total // share))
    base: list[_Level] = []
    for k in range(min(SHARED, order) + 1):
        own = code >> 56 == k
        base.append(_Level(k, code[own] & _mask(k + 1), n[own], base[-1] if base else None, least))
    known = rows.sparkSession.sparkContext.broadcast(base)

    def logs(table: pa.Table) -> pa.Table:
        """Codelengths of all grams whose contexts end in the same symbols, per chunk."""
        parts = [_unpacked_grams(x) for x in table["code"].to_pylist()]
        u, m = _summed(np.concatenate(parts), np.concatenate([_counts(x) for x in table["n"].to_pylist()]))
        levels = known.value + _levels(u, m, range(len(known.value), order + 1), known.value[-1], least)
        each = gram_logs(u, levels).astype("<f4")
        packed = [zstandard.compress(each[np.searchsorted(u, p)].tobytes(), 1) for p in parts]
        return pa.table({"chunk": table["chunk"], "grams": table["code"], "logs": pa.array(packed, pa.binary())})

    priced = grams.where("part >= 0").groupBy("part").applyInArrow(logs, "chunk long, grams binary, logs binary")

    same = Window.partitionBy("token")
    words = chunked.select("chunk", F.posexplode(F.arrays_zip("tokens", "marked")).alias("code", "x")).select(
        "chunk", "code", F.col("x.tokens").alias("token"), F.col("x.marked").alias("n"))
    words = words.select("chunk", "code", "n", F.sum("n").over(same).alias("c"),
                         (F.row_number().over(same.orderBy("chunk", "code")) == 1).alias("lead"))
    coded = stored(words.mapInArrow(_packed, "chunk long, code binary, c binary, kinds long, n long"))
    totals = coded.agg(F.sum("kinds"), F.sum("n")).first()
    texts = rows.where("train").count()
    n_train = (totals[1] or 0) + texts
    kinds = (totals[0] or 0) + (texts > 0)

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        """Word sums of the documents of one chunk."""
        words = right.filter(right["code"].is_valid())
        code = np.concatenate([unpack_codes(x.as_py()) for x in words["code"]] or [np.zeros(0, "<u4")])
        back = np.frombuffer(b"".join(zstandard.decompress(x.as_py()) for x in words["c"]), "<i8")
        c = np.empty(code.size, np.int64)
        c[code] = back
        used, counts = unpack_codes(left["codes"][0].as_py()), left["counts"][0].values.to_numpy().astype(np.int64)
        text = np.repeat(np.arange(counts.size), counts)
        known = np.bincount(text, weights=(c > 0)[used], minlength=counts.size)
        logs = np.bincount(text, weights=np.log10(c + 0.1)[used], minlength=counts.size)
        priced = right.filter(right["grams"].is_valid())
        gram = np.concatenate([_unpacked_grams(x.as_py()) for x in priced["grams"]])
        price = np.frombuffer(b"".join(zstandard.decompress(x.as_py()) for x in priced["logs"]), "<f4")
        by = np.argsort(gram, kind="stable")  # the parts are ascending runs
        gram, price = gram[by], price[by]
        scores = []
        for data, first, _ in _model_texts(left, 0):
            own = _grams(data, order)
            by = np.argsort(own)
            own = own[by]
            border = np.flatnonzero(np.diff(own, prepend=-1))
            found, at = _find(gram, own[border])
            if not found.all():
                raise RuntimeError("the grams of a chunk changed between two passes")
            each = np.empty(own.size)
            each[by] = np.repeat(price[at], np.diff(np.append(border, own.size)))
            scores.append(np.add.reduceat(each, first[:-1]))
        return pa.table({"doc_id": left["rows"][0].values.cast(pa.int64()), "n": pa.array(counts), "known": pa.array(known.astype(np.int64)),
                         "logs": pa.array(logs), "score": pa.array(np.concatenate(scores))})

    parts = max(12, chunked.count())  # a task of the last step holds a chunk or a few
    left = chunked.select("chunk", "rows", "counts", "codes", "tokens").repartition(parts, "chunk").groupBy("chunk")
    right = coded.select("chunk", "code", "c").unionByName(priced, allowMissingColumns=True)
    out = left.cogroup(right.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(sums, "doc_id long, n long, known long, logs double, score double")
    tokens = F.col("n") + 1
    scale = float(np.log10(n_train + 0.1 * (kinds + 1)))
    return out.select(
        "doc_id", F.expr(held_out).alias("held_out"), tokens.alias("n_tokens"),
        (F.col("known") + int(texts > 0)).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs") + float(np.log10(texts + 0.1)) - tokens * scale).alias("base_score"), "score")


def _packed(batches: Batches) -> Batches:
    """Counts of words on their way back, one row per chunk and batch."""
    for batch in batches:
        chunk, code, n, c, lead = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("chunk", "code", "n", "c", "lead"))
        order = np.argsort(chunk, kind="stable")
        border = np.append(0, np.flatnonzero(np.diff(chunk[order])) + 1)
        parts = np.split(order, border[1:]) if order.size else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk[order[border]] if order.size else chunk),
             pa.array([pack_codes(code[p].astype(np.int64)) for p in parts], pa.binary()),
             pa.array([zstandard.compress(c[p].astype("<i8").tobytes(), 1) for p in parts], pa.binary()),
             pa.array([int((lead[p] & (c[p] > 0)).sum()) for p in parts], pa.int64()),
             pa.array([int(n[p].sum()) for p in parts], pa.int64())], names=["chunk", "code", "c", "kinds", "n"])
