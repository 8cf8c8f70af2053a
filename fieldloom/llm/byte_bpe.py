"""Byte-level BPE encoding and decoding through one global shuffle of distinct pre-tokens.

Documents are split into pre-tokens and coded per chunk; distinct pre-tokens of all chunks meet
in one shuffle ordered by content, where each is encoded once by ranked merges over arrays of words
(``bpe_merge``); the ids return to their chunks and are laid out by position.  Decoding looks ids up in the token-byte table, which is as large
as the vocabulary file (a fixed size), so that table and the ranks travel as broadcasts.

Null or empty texts give no ids and decode to no bytes.  Rows keep their ids, null and repeated
ids included: one result row per input row.  An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.bpe_merge import encoded, merges_of
from fieldloom.llm.dictionary import CHUNK_BYTES, chunks, pack_codes, token_rows, unpack_codes
from fieldloom.llm.shared import Batches
from fieldloom.llm.text import Block, gather_spans

SPACE, LETTER, NUMBER, OTHER = range(4)
# The Unicode white space characters.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_class: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of every code point, made once per process."""
    if not _class:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[WHITE_SPACE] = SPACE
        _class.append(table)
    return _class[0]


def pretokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens of a block, and their number per text.

    These are the successive matches of
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``,
    which tile a text, found from the borders of runs of one character class.
    """
    if block.data.size == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(block.n, np.int64)
    at = np.flatnonzero((block.data & 0xC0) != 0x80)  # first byte of every character
    chars = np.frombuffer(block.data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _classes()[chars]
    text = np.zeros(chars.size + 1, bool)  # a text begins (or all end) before this character
    text[np.searchsorted(at, block.bounds)] = True
    text[-1] = True
    new = text.copy()
    new[1:-1] |= kind[1:] != kind[:-1]
    s = np.flatnonzero(new)[:-1]
    e = np.append(s[1:], chars.size)
    k = kind[s]
    gap = k == SPACE
    inner = ~text[e]  # the text goes on after the run
    last_is_blank = chars[e - 1] == 32
    cut = np.zeros(chars.size + 1, bool)
    cut[s[gap]] = True
    cut[e[gap & inner] - 1] = True
    joined = np.zeros(s.size, bool)  # takes a blank from the gap before it
    joined[1:] = ~gap[1:] & (gap & last_is_blank)[:-1] & ~text[s[1:]]
    cut[s[~gap & ~joined]] = True
    # Contractions: an apostrophe that forms a run and a token start of its own, then letters.
    quote = np.flatnonzero((k == OTHER) & (e - s == 1) & (chars[s] == 39) & ~joined & inner)
    quote = quote[k[quote + 1] == LETTER] if quote.size else quote
    if quote.size:
        a = s[quote + 1]
        one = chars[a]
        more = e[quote + 1] - a > 1
        two = np.where(more, chars[np.minimum(a + 1, chars.size - 1)], 0)
        length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for pair in ("re", "ve", "ll"):
            length[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
        hit = length > 0
        cut[a[hit]] = False
        cut[(a + length)[hit]] = True
    cut[text] = True
    marks = np.flatnonzero(cut)
    marks = marks[marks < chars.size]
    starts = at[marks]
    ends = np.append(starts[1:], block.data.size)
    return starts, ends, np.diff(np.searchsorted(starts, block.bounds))


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one ``base64 rank`` pair per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, bytes) of all tokens by id; ids without a token are empty."""
    by_id = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    bounds = np.append(0, np.cumsum([len(t) for t in by_id])).astype(np.int64)
    return bounds, np.frombuffer(b"".join(by_id), np.uint8)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers.

    With ``decoded`` also what ``decode`` makes of the ids, in the same tasks.
    """
    spark = docs.sparkSession
    loaded = load_ranks(path)
    merges = spark.sparkContext.broadcast(merges_of(loaded))
    table = spark.sparkContext.broadcast(token_bytes(loaded)) if decoded else None
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunked = chunks(rows, pretokens)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(12, -(-size // (2 * CHUNK_BYTES)))  # a task of the last step holds a few chunks

    def encode_distinct(batches: Batches) -> Batches:
        last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, "<u4"))
        for batch in batches:
            tokens = batch.column("token").to_pylist()
            new = [t for k, t in enumerate(tokens) if t != (tokens[k - 1] if k else last[0])]  # equal tokens are neighbours
            known = dict(zip(new, encoded(merges.value, new)))
            known.setdefault(*last)
            parts = [known[t] for t in tokens]
            last = (tokens[-1], parts[-1]) if tokens else last
            lengths = np.array([p.size for p in parts], np.int64)
            flat = np.concatenate([np.zeros(0, np.int32), *parts]).astype("<u4")
            chunk = batch.column("chunk").to_numpy()
            code = batch.column("code").to_numpy().astype(np.int64)
            order = np.argsort(chunk, kind="stable")
            border = np.append(0, np.flatnonzero(np.diff(chunk[order])) + 1)
            stop = np.cumsum(lengths)
            out = []
            for part in np.split(order, border[1:]):
                n, data = gather_spans(flat, (stop - lengths)[part], stop[part])
                out.append((pack_codes(code[part]), pack_codes(n), pack_codes(data)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk[order[border]]), *(pa.array([o[i] for o in out], pa.binary()) for i in range(3))],
                names=["chunk", "code", "n", "ids"])

    words = token_rows(chunked).repartition("token").sortWithinPartitions("token")
    coded = words.mapInArrow(encode_distinct, "chunk long, code binary, n binary, ids binary")

    def lay_out(left: pa.Table, right: pa.Table) -> pa.Table:
        """All documents of one chunk; both sides are bounded by the chunk's size."""
        parts = [tuple(unpack_codes(x.as_py()) for x in row) for row in zip(*(right[c] for c in ("code", "n", "ids")))]
        codes, n, flat = (np.concatenate([p[k] for p in parts] or [np.zeros(0, "<u4")]) for k in range(3))
        del parts
        length, start = np.zeros(codes.size, np.int64), np.zeros(codes.size, np.int64)
        length[codes], start[codes] = n, np.cumsum(n, dtype=np.int64) - n
        row = left.select(["rows", "counts", "codes"]).to_pylist()
        used = unpack_codes(row[0]["codes"]) if len(row) == 1 else np.zeros(0, "<u4")
        if len(row) != 1 or (int(used.max()) + 1 if used.size else 0) != codes.size:
            raise RuntimeError("the rows of the input changed their order between two reads")
        stop = np.cumsum(row[0]["counts"])
        lists = []
        for a, b in zip(np.append(0, stop), stop):
            use = used[a:b]
            lists.append(gather_spans(flat, start[use], start[use] + length[use])[1].tobytes())
        ids = row[0]["rows"]
        out = {"doc_id": pa.array(ids, pa.int64()), "ids": pa.array(lists, pa.binary())}
        if table is not None:
            out["decoded"] = pa.array([_decoded(x, *table.value) for x in lists], pa.binary())
        return pa.table(out)

    left = chunked.select("chunk", "rows", "counts", "codes").repartition(parts, "chunk").groupBy("chunk")
    return left.cogroup(coded.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(
        lay_out, "doc_id long, ids binary" + ", decoded binary" * decoded)


def _decoded(raw: bytes, bounds: np.ndarray, data: np.ndarray) -> bytes:
    ids = np.frombuffer(raw, "<u4").astype(np.int64)
    return gather_spans(data, bounds[ids], bounds[ids + 1])[1].tobytes()


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``: the bytes of ``ids``."""
    table = encoded.sparkSession.sparkContext.broadcast(token_bytes(load_ranks(path)))

    def run(batches: Batches) -> Batches:
        bounds, data = table.value
        for batch in batches:
            texts = [_decoded(raw or b"", bounds, data) for raw in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary"
    return encoded.mapInArrow(run, schema)
