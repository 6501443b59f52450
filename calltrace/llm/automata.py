"""Weighted acyclic automata over strings of words, built level by level from sorted rows.

An automaton accepts strings of exactly ``depth`` symbols; a shorter string ends in symbol 0. Symbol s > 0 is word s - 1 of the
automaton's own sorted word list. The states of a level share one array of arcs in order; an arc leads to a state of the next level,
and those of the last level carry the string's weight. Construction takes the sorted strings from their ends: all continuations of one
prefix are a state, and states with equal arcs are one state, so the automaton is minimal for weights on last arcs. States
are compared by 128-bit hashes of their arcs.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from calltrace.llm.text import mix, ranges


def word_list(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The sorted distinct values of a binary array, and each value's symbol (1 for the first)."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy(zero_copy_only=False)
    rank = np.empty(len(order) + 1, np.int32)
    rank[order] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)]


def sort_rows(rows: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, with the sums of their weights, or with their numbers. Rows whose symbols fit into 64 bits are sorted as one number."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    bits = max(1, int(rows.max()).bit_length())
    if bits * rows.shape[1] <= 64:
        key = np.zeros(len(rows), np.uint64)
        for k in range(rows.shape[1]):
            key = key << np.uint64(bits) | rows[:, k].astype(np.uint64)
        if weights is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, weights = key[order], weights[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key = key[first]
        out = np.empty((len(key), rows.shape[1]), rows.dtype)
        for k in range(rows.shape[1] - 1, -1, -1):
            out[:, k] = key & np.uint64((1 << bits) - 1)
            key = key >> np.uint64(bits)
    else:
        order = np.lexsort(rows.T[::-1])
        out = rows[order]
        weights = None if weights is None else weights[order]
        first = np.flatnonzero(np.concatenate([[True], (out[1:] != out[:-1]).any(axis=1)]))
        out = out[first]
    return out, np.diff(np.append(first, len(rows))) if weights is None else np.add.reduceat(weights, first)


def _small(a: np.ndarray) -> np.ndarray:
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


class Automaton:
    def __init__(self, words: pa.Array, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """``levels``: each state's first arc (and the end), and the arcs' symbols and targets, or weights on the last level."""
        self.words, self.levels = words, levels

    @classmethod
    def build(cls, words: pa.Array, rows: np.ndarray, weights: np.ndarray) -> Automaton:
        """From distinct sorted rows of symbols. Words that no row has are left out."""
        seen = np.zeros(len(words) + 1, bool)
        seen[rows] = True
        used = np.flatnonzero(seen[1:]) + 1
        names = np.zeros(len(words) + 1, np.int32)
        names[used] = np.arange(1, len(used) + 1)
        rows, words = names[rows], words.take(pa.array(used - 1))
        levels: list = []
        target = weights.astype(np.int64)
        for level in range(rows.shape[1] - 1, -1, -1):
            symbol = rows[:, level]
            new = np.zeros(len(rows), bool)
            new[:1] = True
            for k in range(level):
                new[1:] |= rows[1:, k] != rows[:-1, k]
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(rows)))
            state, keep = _equal_states(symbol, target, first, count)
            arcs = ranges(first[keep], count[keep])
            levels.append((np.concatenate([[0], np.cumsum(count[keep])]), symbol[arcs], target[arcs]))
            target, rows = state, rows[first]
        return cls(words, levels[::-1])

    @property
    def states(self) -> int:
        return sum(len(first) - 1 for first, _, _ in self.levels)

    def totals(self) -> list[np.ndarray]:
        """Per level, the sum of the weights that each arc leads to."""
        out, below = [], None
        for first, _, target in reversed(self.levels):
            own = target if below is None else below[target]
            out.append(own)
            sums = np.concatenate([[0], np.cumsum(own)])
            below = sums[first[1:]] - sums[first[:-1]]
        return out[::-1]

    def prefixes(self, least: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per length: the prefixes in order, and the summed weights of all strings that begin so, of those with a sum of ``least``. The first and the last
        prefix of a length are always there; their strings may go on in another range."""
        out: list = []
        state, rows = np.zeros(min(1, len(self.levels[0][0]) - 1), np.int64), np.zeros((1, 0), np.int32)
        for (first, symbol, target), total in zip(self.levels, self.totals(), strict=True):
            count = first[state + 1] - first[state]
            arcs = ranges(first[state], count)
            held = total[arcs] >= least
            held[:1] = held[-1:] = True
            came, arcs = np.repeat(np.arange(len(state)), count)[held], arcs[held]
            rows = np.column_stack([rows[came], symbol[arcs]])
            out.append((rows, total[arcs]))
            state = target[arcs]
        return out

    def strings(self) -> tuple[np.ndarray, np.ndarray]:
        """All accepted strings in order, and their weights."""
        return self.prefixes()[-1]

    def dump(self) -> bytes:
        words = self.words.cast(pa.large_binary())
        at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        arrays = [np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]] if len(words) else np.zeros(0, np.uint8), np.diff(at)]
        for first, symbol, target in self.levels:
            arrays += [np.diff(first), symbol, target]
        out = []
        for a in map(_small, arrays):
            out += [struct.pack("<BQ", a.itemsize, len(a)), a.tobytes()]
        plain = b"".join(out)
        return struct.pack("<Q", len(plain)) + pa.Codec("zstd", compression_level=1).compress(plain, asbytes=True)

    @classmethod
    def load(cls, blob: bytes) -> Automaton:
        (size,) = struct.unpack_from("<Q", blob)
        plain = pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True)
        arrays, at = [], 0
        while at < size:
            item, n = struct.unpack_from("<BQ", plain, at)
            arrays.append(np.frombuffer(plain, f"<u{item}", n, at + 9))
            at += 9 + item * n
        offsets = np.concatenate([[0], np.cumsum(arrays[1].astype(np.int64))])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(arrays[0].tobytes())])
        levels = [(np.concatenate([[0], np.cumsum(c.astype(np.int64))]), s.astype(np.int32), t.astype(np.int64)) for c, s, t in zip(*[iter(arrays[2:])] * 3, strict=True)]
        return cls(words, levels)


def _equal_states(symbol: np.ndarray, target: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each state among the different ones, and the first state of each of those."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = []
    for salt in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        arc = mix(symbol.astype(np.uint64) * np.uint64(salt) + mix(target.astype(np.uint64) + np.uint64(salt >> 1)))
        keys.append(np.add.reduceat(arc, first) + count.astype(np.uint64) * np.uint64(salt))
    order = np.argsort(keys[0], kind="stable")  # different states whose first hashes are equal may keep equal ones apart; that costs a state
    a, b = keys[0][order], keys[1][order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    state = np.empty(len(first), np.int64)
    state[order] = np.cumsum(new) - 1
    return state, order[new]


def union(parts: list[Automaton]) -> Automaton:
    """Accepts what any of ``parts`` does; weights of one string are summed."""
    words = pa.concat_arrays([p.words.cast(pa.large_binary()) for p in parts])
    sorted_words, symbol = word_list(words)
    rows, weights, at = [], [], 0
    for p in parts:
        own = np.concatenate([np.zeros(1, symbol.dtype), symbol[at : at + len(p.words)]])
        at += len(p.words)
        r, w = p.strings()
        rows.append(own[r])
        weights.append(w)
    return Automaton.build(sorted_words, *sort_rows(np.concatenate(rows), np.concatenate(weights)))


def compose(a: Automaton, b: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings that both accept, in symbols of ``a`` and in order, with their weights in ``a`` and in ``b``."""
    found = pc.index_in(b.words.cast(pa.large_binary()), value_set=a.words.cast(pa.large_binary()))
    to_a = np.concatenate([[0], pc.fill_null(found, -2).to_numpy(zero_copy_only=False).astype(np.int64) + 1])  # -1: no word of a
    one = np.zeros(min(1, len(a.levels[0][0]) - 1, len(b.levels[0][0]) - 1), np.int64)
    sa, sb, rows = one, one, np.zeros((len(one), 0), np.int64)
    base = len(a.words) + 1
    for (fa, ya, ta), (fb, yb, tb) in zip(a.levels, b.levels, strict=True):
        na, nb = fa[sa + 1] - fa[sa], fb[sb + 1] - fb[sb]
        xa, xb = ranges(fa[sa], na), ranges(fb[sb], nb)
        pair = np.repeat(np.arange(len(sa)), na)
        left, right = pair * base + ya[xa], np.repeat(np.arange(len(sb)), nb) * base + to_a[yb[xb]]
        known = to_a[yb[xb]] >= 0
        right, xb = right[known], xb[known]
        order = np.argsort(right, kind="stable")
        right, xb = right[order], xb[order]
        at = np.searchsorted(right, left)
        hit = np.flatnonzero((at < len(right)) & (right[np.minimum(at, max(len(right) - 1, 0))] == left)) if len(right) else np.zeros(0, np.int64)
        xa, xb, pair = xa[hit], xb[at[hit]], pair[hit]
        rows = np.column_stack([rows[pair], ya[xa]])
        sa, sb = ta[xa], tb[xb]
    return rows, sa, sb
