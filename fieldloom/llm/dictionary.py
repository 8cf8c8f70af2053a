"""Dictionary-coded chunks: tokens of many documents as codes into a list of distinct tokens.

A chunk holds consecutive documents of one partition up to a byte budget.  It is one row
``(chunk, rows, counts, codes, tokens)``: document ids, tokens per document, the code of every
token (compressed byte planes, frequent tokens first) and the distinct tokens themselves.
Only distinct tokens leave a chunk for a global shuffle; what they are given there comes back
to the chunk once and is spread over the documents by code.

Chunks are numbered by partition and place, so the rows of the input must come in the same order
whenever a task is repeated, as rows of files do; users check that codes and tokens agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.shared import Batches
from fieldloom.llm.text import Block, blocks, gather_spans

CHUNK_BYTES = 16 << 20
FREQUENT = 1 << 16
SCHEMA = ("chunk long, rows array<long>, counts array<int>, codes binary, tokens array<binary>, marked array<long>, "
          "figures array<double>")
_TYPE = pa.schema([("chunk", pa.int64()), ("rows", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
                   ("codes", pa.binary()), ("tokens", pa.list_(pa.binary())), ("marked", pa.list_(pa.int64())),
                   ("figures", pa.list_(pa.float64()))])


def pack_codes(codes: np.ndarray) -> bytes:
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_codes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


class _Chunk:
    def __init__(self) -> None:
        self.size, self.rows, self.parts, self.figures = 0, [], [], []

    def add(self, block: Block, ids: pa.Array, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray,
            mark: np.ndarray, figures: np.ndarray) -> None:
        """Counts the block's tokens; ``hashes`` stand for tokens, whose bytes are kept once."""
        h = block.hashes(starts, ends)
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        lengths, data = gather_spans(block.data, starts[first], ends[first])
        self.parts.append((u, lengths, data, back.astype(np.int32), counts, np.bincount(back[np.repeat(mark, counts)], minlength=u.size)))
        self.rows.append(ids)
        self.figures.append(figures)
        self.size += block.data.size

    def emit(self, number: int) -> pa.RecordBatch:
        u = np.concatenate([p[0] for p in self.parts])
        _, first, back = np.unique(u, return_index=True, return_inverse=True)
        at = np.cumsum([0] + [p[0].size for p in self.parts])
        local = [back[at[i] : at[i + 1]] for i in range(len(self.parts))]
        tally = sum((np.bincount(b[p[3]], minlength=first.size) for b, p in zip(local, self.parts)),
                    np.zeros(first.size, np.int64))
        marked = sum((np.bincount(b, weights=p[5], minlength=first.size) for b, p in zip(local, self.parts)),
                     np.zeros(first.size)).astype(np.int64)
        lengths = np.concatenate([p[1] for p in self.parts])
        data = np.concatenate([p[2] for p in self.parts])
        ends = np.cumsum(lengths)
        tokens = binary_array(*gather_spans(data, (ends - lengths)[first], ends[first]))
        # Frequent tokens get the small codes; the others follow in byte order, which compresses.
        order = np.argsort(-tally, kind="stable")
        rest = order[FREQUENT:]
        if rest.size:
            order[FREQUENT:] = rest[pc.sort_indices(tokens.take(pa.array(rest))).to_numpy()]
        rank = np.empty(first.size, np.uint32)
        rank[order] = np.arange(first.size, dtype=np.uint32)
        codes = np.concatenate([rank[b][p[3]] for b, p in zip(local, self.parts)])
        counts = np.concatenate([p[4] for p in self.parts]).astype(np.int32)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        chunk = (TaskContext.get().partitionId() << 32) + number
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk]), one(pa.concat_arrays(self.rows)), one(pa.array(counts)),
             pa.array([pack_codes(codes)], pa.binary()), one(tokens.take(pa.array(order))),
             one(pa.array(marked[order])), one(pa.array(np.concatenate(self.figures)))], schema=_TYPE)


def binary_array(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    bounds = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), lengths.size, [None, pa.py_buffer(bounds), pa.py_buffer(data)])


def chunks(docs: DataFrame, tokenize: Callable[[Block], tuple[np.ndarray, np.ndarray, np.ndarray]],
           lower: bool = False, size: int = CHUNK_BYTES, mark_col: str | None = None,
           figure: Callable[[Block, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Chunk rows of ``docs`` (doc_id, text).

    ``tokenize`` gives byte starts and ends of all tokens of a block, and tokens per text.
    ``marked`` counts each token in the texts where the boolean ``mark_col`` is true, and
    ``figures`` has what ``figure`` gives for every text, from the block and its marks.
    """
    def run(batches: Batches) -> Batches:
        number, chunk = 0, _Chunk()
        for batch in batches:
            at, ids = 0, batch.column("doc_id")
            marks = np.zeros(batch.num_rows, bool)
            if mark_col:
                marks = batch.column(mark_col).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column("text"), lower):
                starts, ends, counts = tokenize(block)
                mark = marks[at : at + block.n]
                figures = figure(block, mark) if figure else np.zeros(0)
                chunk.add(block, ids.slice(at, block.n), starts, ends, counts, mark, figures)
                at += block.n
                if chunk.size >= size:
                    yield chunk.emit(number)
                    number, chunk = number + 1, _Chunk()
        if chunk.rows:
            yield chunk.emit(number)

    return docs.select("doc_id", "text", *[mark_col][: bool(mark_col)]).mapInArrow(run, SCHEMA)


def token_rows(chunked: DataFrame) -> DataFrame:
    """(token, chunk, code): the distinct tokens of every chunk."""
    return chunked.select("chunk", F.posexplode("tokens").alias("code", "token")).select("token", "chunk", "code")
