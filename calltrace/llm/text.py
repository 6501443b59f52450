"""Words and word hashes of Arrow text columns, vectorised over bytes.

A word is a run of ``[^\\x20\\x09-\\x0D]``. A block is a stretch of whole texts laid end to end; every function works on
one block, so memory is bounded by the block size or the longest text. Bytes are hashed in pieces of ``PIECE``, so a very long
text costs a few numbers per word, not per byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
#: Bytes whose hash sums are held at once.
PIECE = 1 << 18
#: Rows of an Arrow batch; long texts make Spark's usual 10,000 too large.
BATCH_ROWS = 512
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = {0: 0x9E3779B97F4A7C15, 1: 0xD6E8FEB86659FD93}
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, at least ``n`` of each."""
    have = _TABLES.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + 4096)
        base = _BASE[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _TABLES[which] = (out[0], out[1])
    if n > 4 * PIECE:  # for one very long text; kept no longer than that
        del _TABLES[which]
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def bounded_batches(spark) -> None:
    """Let the session's Arrow batches hold at most ``BATCH_ROWS`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores at its end where ``taken`` has it already (Spark ignores case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose texts hold about ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column laid end to end, and each text's start, with the end last; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def _bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of texts with the given offsets, found piece by piece."""
    starts, ends = [], []
    for a in range(0, len(data), 4 * PIECE):
        b = min(a + 4 * PIECE, len(data))
        full = ~SPACE[data[a:b]]
        before, after = np.empty_like(full), np.empty_like(full)
        before[1:], before[0] = full[:-1], a > 0 and not SPACE[data[a - 1]]
        after[:-1], after[-1] = full[1:], b < len(data) and not SPACE[data[b]]
        cut = offs[np.searchsorted(offs, a) : np.searchsorted(offs, b, "right")]
        before[cut[cut < b] - a] = False
        after[cut[cut > a] - a - 1] = False
        starts.append(np.flatnonzero(full & ~before) + a)
        ends.append(np.flatnonzero(full & ~after) + a + 1)
    none = np.zeros(0, np.int64)
    return np.concatenate(starts or [none]), np.concatenate(ends or [none])


class Words:
    """Word bounds of a block: byte ``start`` and ``end`` of each word, and ``first``: each text's first word, then the end."""

    def __init__(self, column: pa.Array, bounds: bool = True):
        self.data, self.offs = raw(column)
        if bounds:
            self.start, self.end = _bounds(self.data, self.offs)
            self.first = np.searchsorted(self.start, self.offs)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None, data: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of other byte ranges of the block, whose starts and ends must ascend."""
        start, end = self.start if start is None else start, self.end if end is None else end
        return byte_hashes(self.data if data is None else data, start, end)


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending byte ranges: sums of (byte + 1) times powers of an odd base, finalised."""
    up, down = powers(0, PIECE + 1)
    out = np.zeros(len(start), np.uint64)
    sums = np.zeros(min(PIECE, len(data)) + 1, np.uint64)
    for a in range(0, len(data), PIECE):
        b = min(a + PIECE, len(data))
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1 : b - a + 1])
        lo, hi = np.searchsorted(end, a, "right"), np.searchsorted(start, b)  # ranges that meet this piece
        if lo >= hi:
            continue
        s, e = np.maximum(start[lo:hi], a) - a, np.minimum(end[lo:hi], b) - a
        part = (sums[np.maximum(e, s)] - sums[s]) * down[s]
        for k in np.flatnonzero(start[lo:hi] < a).tolist():  # begun in an earlier piece
            part[k] = int(part[k]) * pow(_BASE[0], a - int(start[lo + k]), 1 << 64) & (1 << 64) - 1
        out[lo:hi] += part
    return mix(out)


def runs(h: np.ndarray, n: int, which: int = 1) -> np.ndarray:
    """Hashes of every run of ``n`` hashes (``len(h) - n + 1`` of them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up, _ = powers(which, n)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out += h[j : j + len(out)] * up[j]
    return mix(out)


def spans_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of runs of hashes between any bounds."""
    up, down = powers(which, len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start[i], start[i] + 1, ...``, ``count[i]`` of each, end to end."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(count) - count
    return np.repeat(start - at, count) + np.arange(total)


def plain_bounds(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's bytes in lower case (A-Z and the two-byte capitals of Latin-1), and word bounds without up to three outer ASCII marks a side."""
    data = words.data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    high = data[after]
    data[after] = np.where((high >= 0x80) & (high <= 0x9E) & (high != 0x97), high + 32, high)
    inner = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    start, end = words.start.copy(), words.end.copy()
    if len(start):
        for _ in range(3):
            start += (end - start > 1) & ~inner[start]
            end -= (end - start > 1) & ~inner[end - 1]
    return data, start, end


def plain_hashes(words: Words) -> np.ndarray:
    """Hashes of the words in that form."""
    data, start, end = plain_bounds(words)
    return words.hashes(start, end, data)
