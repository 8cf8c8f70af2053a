"""Whole Arrow batches of text as numpy byte, word and window arrays.

Everything here is a bounded helper for the inside of one task: a batch is cut into blocks
of some megabytes (a longer single text forms a block of its own), and no function looks at
text character by character in Python.

Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return.  These bytes never occur inside a multi-byte UTF-8 character, so byte words
equal code-point words.  Hashes are 64-bit polynomials over random byte values with a final
mix; two of them (different seeds) make the 128-bit keys that stand for exact equality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
ROW_BITS = 12  # a block has at most 2**ROW_BITS texts
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, size=(2, 256), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    if seed not in _powers or _powers[seed][0].size < n:
        size = max(n, BLOCK_BYTES + 1)
        inverse = np.uint64(pow(int(_ODD[seed]), -1, 1 << 64))
        both = []
        for base in (_ODD[seed], inverse):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            both.append(np.cumprod(run, dtype=np.uint64))
        if size > 4 * BLOCK_BYTES:
            return both[0], both[1]
        _powers[seed] = (both[0], both[1])
    return _powers[seed]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hasher(values: np.ndarray, seed: int = 0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Function (starts, ends) that hashes spans of ``values``."""
    power, inverse = _power(seed, values.size + 1)
    run = np.empty(values.size + 1, np.uint64)
    run[0] = 0
    np.cumsum(values * power[: values.size], out=run[1:])

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = run[ends] - run[starts]
        h *= inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64))

    return hashes


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of ``values[start:end]`` for every span, equal for equal contents at any place."""
    return span_hasher(values, seed)(starts, ends)


class Block:
    """Some texts of a batch: UTF-8 bytes, text bounds, and words on request."""

    def __init__(self, rows: np.ndarray, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        self.rows, self.bounds = rows, bounds
        self.data = _LOWER[data] if lower else data

    @property
    def n(self) -> int:
        return self.bounds.size - 1

    def find_words(self) -> "Block":
        """Sets ``starts`` and ``ends`` of all words and ``first``: word index where text i begins."""
        n = self.data.size
        if n == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
        else:
            gap = _GAP[self.data]
            edge = np.empty(n + 1, bool)  # a text border or a gap before position i
            edge[0] = edge[n] = True
            edge[1:n] = gap[:-1]
            edge[self.bounds] = True
            self.starts = np.flatnonzero(~gap & edge[:n])
            edge[1:n] = gap[1:]
            edge[self.bounds] = True
            self.ends = np.flatnonzero(~gap & edge[1:]) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        return self

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """Hashes of byte spans."""
        return span_hashes(_BYTES[seed][self.data], starts, ends, seed)

    def word_hashes(self, seed: int = 0) -> np.ndarray:
        return self.hashes(self.starts, self.ends, seed)

    def windows(self, width: int) -> np.ndarray:
        """Indices of the words that start a window of ``width`` words inside their text."""
        last = np.repeat(self.first[1:], np.diff(self.first))
        at = np.arange(self.starts.size)
        return at[at + width <= last]

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def blocks(texts: pa.Array, lower: bool = False, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts in order as blocks of at most ``size`` bytes or one text; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, side="right")) - 1)
        j = min(j, i + (1 << ROW_BITS), len(texts))
        cut = bounds[i : j + 1]
        yield Block(np.arange(i, j), data[cut[0] : cut[-1]], cut - cut[0], lower)
        i = j


def gather_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, bytes) of the spans, one after another."""
    lengths = ends - starts
    shift = starts - (np.cumsum(lengths) - lengths)
    at = np.repeat(shift, lengths) + np.arange(int(lengths.sum()))
    return lengths, data[at]


def shingle_sets(block: Block, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed ``width``-word shingles of every text, ascending, as (hashes, bounds).

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    Hashes have 64 - ``ROW_BITS`` bits, so that one sort of plain integers orders all texts.
    """
    words = block.word_hashes(seed)
    count = np.diff(block.first)
    full = block.windows(width)
    short = np.flatnonzero((count > 0) & (count < width))
    starts = np.concatenate([full, block.first[short]])
    ends = np.concatenate([full + width, block.first[short + 1]])
    text = np.concatenate([np.repeat(np.arange(block.n), np.maximum(count - width + 1, 0)), short])
    key = span_hashes(words, starts, ends, seed) >> np.uint64(ROW_BITS)
    key |= text.astype(np.uint64) << np.uint64(64 - ROW_BITS)
    key.sort()
    new = np.ones(key.size, bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    bounds = np.searchsorted(key, np.arange(block.n, dtype=np.uint64) << np.uint64(64 - ROW_BITS))
    return key & np.uint64((1 << (64 - ROW_BITS)) - 1), np.append(bounds, key.size)
