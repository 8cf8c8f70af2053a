"""Ranked byte-pair merges over arrays of distinct words.

A word is encoded by merging, again and again, its adjacent pair of least rank, the leftmost of equals,
until no pair is a token; a word that is a token itself is that token.  Words of one length are a
matrix: every step finds the least pair of each row at once, merges it, closes the gap and looks up the
two new pairs, so all rows that go on stay of one length.  Long words take a heap instead.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np

LONG = 256  # bytes beyond which a word takes the heap
ROWS = 1 << 16  # words of one matrix
NONE = np.int32(2**31 - 1)


class Merges(NamedTuple):
    """``single``: token of every byte; ``pairs``: ascending (left << 32 | right) with the token they form."""

    single: np.ndarray
    pairs: np.ndarray
    token: np.ndarray
    whole: dict[bytes, int]


def merges_of(ranks: dict[bytes, int]) -> Merges:
    """All pairs of tokens whose bytes together are a token; a token's id is its rank."""
    single = np.full(256, -1, np.int32)
    keys, to = [], []
    for token, rank in ranks.items():
        if len(token) == 1:
            single[token[0]] = rank
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                to.append(rank)
    pairs = np.array(keys, np.int64)
    order = np.argsort(pairs)
    return Merges(single, pairs[order], np.array(to, np.int32)[order], ranks)


def _formed(merges: Merges, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Token of every pair, ``NONE`` where they form none."""
    if merges.pairs.size == 0:
        return np.full(left.shape, NONE)
    key = left.astype(np.int64) << 32 | right
    at = np.searchsorted(merges.pairs, key)
    at[at == merges.pairs.size] = 0
    return np.where(merges.pairs[at] == key, merges.token[at], NONE)


def _matrix(merges: Merges, ids: np.ndarray, rows: np.ndarray, out: list[np.ndarray | None]) -> None:
    """Encodes the words ``rows`` whose byte tokens are the rows of ``ids``, all of one length."""
    rank = _formed(merges, ids[:, :-1], ids[:, 1:])
    while rows.size:
        at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(rows.size, np.int64)
        best = rank[np.arange(rows.size), at] if rank.shape[1] else np.full(rows.size, NONE)
        done = best == NONE
        for row, word in zip(rows[done].tolist(), ids[done]):
            out[row] = word
        on = ~done
        rows, at, best = rows[on], at[on], best[on]
        if not rows.size:
            return
        each = np.arange(rows.size)
        width = ids.shape[1] - 1
        take = np.arange(width) + (np.arange(width) > at[:, None])
        ids = np.take_along_axis(ids[on], take, 1)
        ids[each, at] = best
        if width == 1:
            rank = np.zeros((rows.size, 0), np.int32)
            continue
        take = np.arange(width - 1) + (np.arange(width - 1) >= at[:, None])
        rank = np.take_along_axis(rank[on], np.minimum(take, width - 1), 1)
        has = at > 0
        rank[each[has], at[has] - 1] = _formed(merges, ids[each[has], at[has] - 1], best[has])
        has = at < width - 1
        rank[each[has], at[has]] = _formed(merges, best[has], ids[each[has], at[has] + 1])


def _heap(merges: Merges, word: bytes) -> np.ndarray:
    """One long word: pairs by (rank, place) in a heap over a linked list."""
    ids = merges.single[np.frombuffer(word, np.uint8)].tolist()
    n = len(ids)
    after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
    first = _formed(merges, np.array(ids[:-1]), np.array(ids[1:]))
    queue = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
    heapq.heapify(queue)

    def push(i: int) -> None:
        j = after[i]
        if j < n:
            r = _formed(merges, np.array([ids[i]]), np.array([ids[j]]))[0]
            if r != NONE:
                heapq.heappush(queue, (int(r), i, ids[i], ids[j]))

    while queue:
        rank, i, left, right = heapq.heappop(queue)
        j = after[i] if not gone[i] else n
        if j >= n or ids[i] != left or ids[j] != right:
            continue
        ids[i], gone[j], after[i] = rank, 1, after[j]
        if after[j] < n:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return np.array([t for t, dead in zip(ids, gone) if not dead], np.int32)


def encoded(merges: Merges, words: list[bytes]) -> list[np.ndarray]:
    """Token ids of every word."""
    out: list[np.ndarray | None] = [None] * len(words)
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        known = merges.whole.get(word)
        if known is not None:
            out[i] = np.array([known], np.int32)
        elif len(word) > LONG:
            out[i] = _heap(merges, word)
        elif word:
            by_length.setdefault(len(word), []).append(i)
        else:
            out[i] = np.zeros(0, np.int32)
    for length, members in by_length.items():
        for low in range(0, len(members), ROWS):
            rows = np.array(members[low : low + ROWS])
            data = np.frombuffer(b"".join([words[i] for i in members[low : low + ROWS]]), np.uint8).reshape(-1, length)
            _matrix(merges, merges.single[data], rows, out)
    missing = [i for i, ids in enumerate(out) if ids.size and ids.min() < 0]
    if missing:
        raise ValueError("the vocabulary lacks a byte of the text")
    return out
