"""Vectorised text primitives on Arrow string buffers: word bounds, word and n-gram hashes.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; UTF-8 never puts those bytes inside a character.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(0x5EED_0B5B)
BYTE_MIX = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
GRAM_BASE = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@functools.cache
def _c_library():
    return ctypes.CDLL(None)


def trim() -> None:
    """Give freed memory back: a Python worker lives on after its task, beside those of later operators."""
    pa.default_memory_pool().release_unused()
    if hasattr(_c_library(), "malloc_trim"):
        _c_library().malloc_trim(0)


def trimmed(rows):
    """``rows``, a function of batches, that leaves no freed memory behind when it ends."""

    def out(batches):
        yield from rows(batches)
        trim()

    return out


class Words:
    """Word bounds of many documents: ``start``/``end`` byte positions and ``doc`` of each word, ``first`` word of each document."""

    def __init__(self, texts: pa.Array, lower: bool = False, table: np.ndarray | None = None):
        """``table`` maps each byte before words are cut; ``lower`` is short for the one that lower-cases A-Z."""
        data, self.offsets = string_buffers(texts)
        table = LOWER if lower else table
        self.data = data = data if table is None else table[data]
        n, docs = len(data), len(self.offsets) - 1
        space = SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.empty(n, bool)
        before[:1] = True
        before[1:] = space[:-1]
        self.start = np.flatnonzero(~space & (before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1:] = True
        after[:-1] = space[1:]
        self.end = np.flatnonzero(~space & (after | edge[1:])) + 1
        self.space = space
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(docs), np.diff(self.first))

    def hashes(self, run: int = 1 << 15) -> np.ndarray:
        """A 64-bit hash of each word, made ``run`` words at a time so that the bytes' terms stay in cache."""
        out, length = np.empty(len(self.start), np.uint64), self.end - self.start
        power = powers(WORD_BASE, int(length.max(initial=0)))
        for a in range(0, len(out), run):
            n = length[a : a + run]
            low, high = self.start[a], self.end[a + len(n) - 1]
            where = np.flatnonzero(~self.space[low:high])
            head = np.cumsum(n) - n
            terms = BYTE_MIX[self.data[low:high][where]] * power[np.arange(len(where)) - np.repeat(head, n)]
            out[a : a + run] = mix(np.add.reduceat(terms, head) + n.astype(np.uint64))
        return out

    def windows(self, word_hash: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hashes of every ``size`` consecutive words of one document, and the words where they start."""
        n = len(word_hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        h = word_hash[:n].copy()
        for k in range(1, size):
            h *= GRAM_BASE
            h += word_hash[k : k + n]
        return mix(h[at]), at


def gathered(batches: Iterator[pa.RecordBatch], text: int, least: int) -> Iterator[pa.RecordBatch]:
    """Small record batches put together until their text column has ``least`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def chunks(batches: Iterator[pa.RecordBatch], text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the text column of each holds about ``most`` bytes (one long document may exceed it)."""
    for batch in batches:
        column = batch.column(text)
        if not batch.num_rows:
            continue
        _, offsets = string_buffers(column)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
