"""Words, word hashes and window hashes of whole blocks of texts, as numpy arrays.

A block is a run of texts of about ``BLOCK_BYTES`` (one text if it alone is longer), cut from an Arrow
batch without copying, so a task's memory follows the block and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21

def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 byte values lie in one of the (first, last) ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes of ``[^\x20\x09-\x0D]+`` in UTF-8.
PLAIN = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in UTF-8, once A-Z are lower case.
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them (two rounds of multiply and shift)."""
    x = x.astype(np.uint64, copy=True)
    for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x ^= x >> np.uint64(31)
        x *= np.uint64(by)
    return x ^ (x >> np.uint64(29))


#: Keys of two independent hashes of bytes, and of the levels at which hashes of words are joined.
_KEYS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_JOIN = 0xD6E8FEB86659FD93


def bytes_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hashes of ``data[start:end]`` for every pair: eight bytes at a time are mixed into the keyed length.

    Spans of one length up to eight bytes never share a hash, as every step is a bijection of what it takes in.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) * np.uint64(_KEYS[key]) + np.uint64(_KEYS[1 - key]))
    if not len(starts):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from every place on
    todo, at, left = np.arange(len(starts)), starts, size
    while len(todo):
        part = eight[at]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[todo] = mix(out[todo] ^ part)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return out


def joined(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Hashes of sequences from those of their two parts."""
    return mix(a * np.uint64(_JOIN) + (b ^ np.uint64(_KEYS[0] * (2 * level + 1) & 0xFFFFFFFFFFFFFFFF)))


class KeyTable:
    """An open hash table from 64-bit keys to entries 0, 1, ... in the order they were added, all by array steps."""

    def __init__(self, most: int):
        self.slots = 1 << max(10, int(2 * most).bit_length())
        self.keys, self.entry, self.size = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(self.slots - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of every key, -1 where it is unknown. (0 marks a free slot; that key counts as 1.)"""
        keys = np.maximum(keys, np.uint64(1))
        out, todo, slot = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self._slot(keys)
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.entry[slot[hit]]
            more = ~hit & (there != 0)
            todo, slot = todo[more], (slot[more] + 1) & (self.slots - 1)
        return out

    def add(self, keys: np.ndarray) -> None:
        """Adds distinct unknown keys. Of those that want one slot, one gets it and the others go on."""
        keys = np.maximum(keys, np.uint64(1))
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[todo[free]]
            got = self.keys[slot] == keys[todo]
            self.entry[slot[got]] = todo[got] + self.size
            todo, slot = todo[~got], (slot[~got] + 1) & (self.slots - 1)
        self.size += len(keys)


@dataclass
class Block:
    """Texts of consecutive rows: their bytes, and where each begins in them."""

    data: np.ndarray
    offsets: np.ndarray
    first: int
    word_bytes: np.ndarray

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each word, and the byte after its last."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = self.word_bytes[self.data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        opens[cuts] = inside[cuts]
        closes[cuts - 1] = inside[cuts - 1]
        return np.flatnonzero(opens), np.flatnonzero(closes) + 1

    @cached_property
    def bounds(self) -> np.ndarray:
        """Words before each text, and all of them: text i has words bounds[i] to bounds[i + 1]."""
        return np.searchsorted(self.spans[0], self.offsets)

    @cached_property
    def hashes(self) -> np.ndarray:
        return bytes_hash(self.data, *self.spans)

    @cached_property
    def checks(self) -> np.ndarray:
        """A second hash of each word, independent of the first."""
        return bytes_hash(self.data, *self.spans, key=1)

    @cached_property
    def _runs(self) -> dict[int, np.ndarray]:
        return {1: self.hashes}

    def _run(self, k: int) -> np.ndarray:
        """Hashes of ``k`` words (a power of two) from each word on, by doubling."""
        if k not in self._runs:
            half = self._run(k // 2)
            n = max(len(half) - k // 2, 0)
            self._runs[k] = joined(half[:n], half[len(half) - n :], k)
        return self._runs[k]

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; those that run past the block's end are left out."""
        n, out, done = max(len(self.hashes) - k + 1, 0), None, 0
        for size in (1 << b for b in reversed(range(k.bit_length())) if k >> b & 1):
            part = self._run(size)[done : done + n]
            out = part if out is None else joined(out, part, k)
            done += size
        return out[:n]

    def sequence(self, i: int) -> np.ndarray:
        """Hash of the whole word sequence of text i, as an array of one; it takes a step for every word."""
        a, b = self.bounds[i : i + 2]
        out = mix(np.array([b - a], np.uint64))
        for h in self.hashes[a:b]:
            out = joined(out, h, 0)
        return out

    def word(self, j: int) -> bytes:
        return self.data[self.spans[0][j] : self.spans[1][j]].tobytes()


def blocks(texts: pa.Array, word_bytes: np.ndarray = PLAIN, lower: bool = False, most: int = BLOCK_BYTES, kind: type[Block] = Block) -> Iterator[Block]:
    """Blocks of an Arrow column of strings; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        part = raw[at[i] : at[j]]
        yield kind(LOWER[part] if lower else part, at[i : j + 1] - at[i], i, word_bytes)
        i = j


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
