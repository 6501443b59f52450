"""Patched frame-of-reference blocks of token ids, in memory: bytes in, bytes out.

A shard holds whole documents. Its ids are cut into blocks of 1024. A block stores its minimum; the differences from it
are packed at the width that holds the ``PERCENTILE`` of them, and the high bits of the rest go to an exception list.
The index holds each block's first word of packed data and first exception, so one block can be read alone.

Layout, little-endian, in this order: magic, five int64 (ids, documents, blocks, packed words, exceptions); per block
minimum uint32, width uint8; per block and one more: first packed word uint64, first exception uint64; packed words
uint64; exceptions: place in the block uint16, high bits uint32; per document: id int64, id is null uint8, end of its ids
int64. A block packs groups of 64 differences, each in ``width`` words, lowest bits first; the last block is filled up.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"PFORids1"
BLOCK, GROUP = 1024, 64
PERCENTILE = 0.95


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """``(rows, BLOCK)`` values below ``2**width`` to ``(rows, BLOCK // GROUP * width)`` words."""
    rows = len(values)
    v = np.ascontiguousarray(values.reshape(-1, GROUP).T).astype(np.uint64)
    out = np.zeros((width, v.shape[1]), np.uint64)
    for j in range(GROUP):
        k, s = divmod(j * width, 64)
        out[k] |= v[j] << np.uint64(s)
        if s + width > 64:
            out[k + 1] |= v[j] >> np.uint64(64 - s)
    return np.ascontiguousarray(out.T).reshape(rows, -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    rows = len(words)
    w = np.ascontiguousarray(words.reshape(-1, width).T)
    mask = np.uint64((1 << width) - 1)
    out = np.empty((GROUP, w.shape[1]), np.uint32)
    for j in range(GROUP):
        k, s = divmod(j * width, 64)
        x = w[k] >> np.uint64(s)
        if s + width > 64:
            x = x | (w[k + 1] << np.uint64(64 - s))
        out[j] = x & mask
    return np.ascontiguousarray(out.T).reshape(rows, BLOCK)


def encode(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n] = ids
    if n:
        full[n:] = ids[-1]
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = full - low[:, None]
    bits = np.ceil(np.log2(diff.astype(np.float64) + 1)).astype(np.uint8)
    at = min(BLOCK - 1, int(percentile * BLOCK))
    width = np.maximum(np.partition(bits, at, axis=1)[:, at], 1) if blocks else np.zeros(0, np.uint8)
    size = width.astype(np.int64) * (BLOCK // GROUP)
    first = np.concatenate([[0], np.cumsum(size)]).astype(np.uint64)
    words = np.empty(int(first[-1]), np.uint64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        packed = _pack(diff[rows] & np.uint32((1 << int(w)) - 1), int(w))
        words[(first[rows].astype(np.int64)[:, None] + np.arange(packed.shape[1])).ravel()] = packed.ravel()
    where, place = np.nonzero(bits > width[:, None]) if blocks else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    high = diff[where, place] >> width[where]
    exceptions = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=blocks))]).astype(np.uint64)
    null = np.array([d is None for d in doc_ids], np.uint8)
    parts = [
        np.array([n, len(doc_ids), blocks, len(words), len(where)], np.int64), low.astype(np.uint32), width.astype(np.uint8), first, exceptions, words,
        place.astype(np.uint16), high.astype(np.uint32), np.array([d or 0 for d in doc_ids], np.int64), null, np.asarray(ends, np.int64),
    ]
    return MAGIC + b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard's index and, on demand, its blocks."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard of packed token ids")
        self.n, self.n_docs, self.blocks, n_words, n_exceptions = np.frombuffer(data, np.int64, 5, 8).tolist()
        at = 48

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.low, self.width = take(np.uint32, self.blocks), take(np.uint8, self.blocks)
        self.first, self.exceptions = take(np.uint64, self.blocks + 1).astype(np.int64), take(np.uint64, self.blocks + 1).astype(np.int64)
        self.words, self.place, self.high = take(np.uint64, n_words), take(np.uint16, n_exceptions), take(np.uint32, n_exceptions)
        ids, null = take(np.int64, self.n_docs), take(np.uint8, self.n_docs)
        self.doc_ids = [None if gone else i for i, gone in zip(ids.tolist(), null.tolist(), strict=True)]
        self.ends = take(np.int64, self.n_docs)

    def block(self, k: int) -> np.ndarray:
        """The ids of one block, read through the index."""
        w = int(self.width[k])
        out = _unpack(self.words[self.first[k] : self.first[k + 1]][None, :], w)[0]
        a, b = self.exceptions[k], self.exceptions[k + 1]
        out[self.place[a:b]] |= self.high[a:b] << np.uint32(w)
        return (out + self.low[k])[: self.n - k * BLOCK]

    def ids(self) -> np.ndarray:
        out = np.empty((self.blocks, BLOCK), np.uint32)
        for w in np.unique(self.width):
            rows = np.flatnonzero(self.width == w)
            at = self.first[rows][:, None] + np.arange(int(w) * (BLOCK // GROUP))
            out[rows] = _unpack(self.words[at], int(w))
        where = np.repeat(np.arange(self.blocks), np.diff(self.exceptions))
        out[where, self.place] |= self.high << self.width[where].astype(np.uint32)
        return (out + self.low[:, None]).reshape(-1)[: self.n]
