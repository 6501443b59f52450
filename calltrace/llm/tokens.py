"""Token ids of texts by a public tokenizer, with each distinct piece encoded once a worker.

A text is cut before spaces. Where the pre-tokenizer breaks there anyway, the pieces' ids end to end are the text's ids;
a text with a space between two pieces of which the first ends in white space and the next starts with it is encoded whole,
as is a text that holds an added token's content, such as ``<|endoftext|>``.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from calltrace.llm.text import Words, ranges

#: Distinct pieces a worker keeps; beyond that it starts anew. Bounds memory, changes no result.
CACHE = 400_000
#: What Python takes for white space in ASCII.
WHITE = np.zeros(256, bool)
WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


class Encoder:
    """Ids of texts as one array with offsets; ``name``: a file of the public tokenizers."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, name: str) -> Encoder:
        if name not in cls._made:
            cls._made[name] = cls(name)
        return cls._made[name]

    def __init__(self, name: str):
        self.model = Tokenizer.from_file(public_tokenizers.path(name))  # as it is, for whole texts
        self.added = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self.plain = Tokenizer.from_file(public_tokenizers.path(name))  # for pieces
        self.plain.encode_special_tokens = True
        # byte-level tokens write a space as this letter
        self.spaced = np.fromiter(((self.model.id_to_token(i) or "").startswith("\u0120") for i in range(self.model.get_vocab_size())), bool)
        self._clear()

    def _clear(self) -> None:
        self.known = 0
        self.ids = np.zeros(1 << 16, np.uint16 if self.model.get_vocab_size() <= 1 << 16 else np.uint32)
        self.used = 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.open, self.shut = np.zeros(1 << 14, bool), np.zeros(1 << 14, bool)
        # open addressing: the hash in each slot and the piece it stands for
        self.keys, self.slots = np.zeros(4 * CACHE, np.uint64), np.full(4 * CACHE, -1, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        size = np.uint64(len(self.keys))
        at = (h % size).astype(np.int64)
        out = self.slots[at]
        more = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        while len(more):
            at[more] = (at[more] + 1) % len(self.keys)
            out[more] = self.slots[at[more]]
            more = more[(out[more] >= 0) & (self.keys[at[more]] != h[more])]
        return out

    def _store(self, h: np.ndarray, first: int) -> None:
        """Give new distinct hashes the numbers from ``first`` on."""
        at = (h % np.uint64(len(self.keys))).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = self.slots[at[left]] < 0
            _, one = np.unique(at[left[free]], return_index=True)  # one for each free slot
            put = left[free][one]
            self.slots[at[put]], self.keys[at[put]] = first + put, h[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) % len(self.keys)

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Encode new distinct pieces, given by their bytes; none is empty."""
        first, n = self.known, len(start)
        while len(self.start) < first + n:
            self.start, self.count, self.open, self.shut = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.count, self.open, self.shut))
        text = lambda i: data[start[i] : end[i]].tobytes().decode("utf-8", "replace")
        led = data[start] == 0x20
        top, last = data[np.minimum(start + led, end - 1)], data[end - 1]
        bare = end - start == led
        opens, shuts = bare | WHITE[top], bare | WHITE[last]
        # white space beyond ASCII begins with one of four bytes and has two or three
        far = (data[np.maximum(end - 2, 0)] == 0xC2) | np.isin(data[np.maximum(end - 3, 0)], (0xE1, 0xE2, 0xE3))
        for i in np.flatnonzero(np.isin(top, (0xC2, 0xE1, 0xE2, 0xE3)) | (last >= 0x80) & far).tolist():
            body = text(i)[int(led[i]) :]
            opens[i], shuts[i] = not body or body[0].isspace(), not body or body[-1].isspace()
        self.open[first : first + n], self.shut[first : first + n] = opens, shuts
        # pieces that start with a space and have no other at their ends can be encoded end to end, which is faster
        plain = led & ~opens & ~shuts
        rest = np.flatnonzero(~plain)
        if len(rest):
            got = [e.ids for e in self.plain.encode_batch_fast([text(i) for i in rest.tolist()], add_special_tokens=False)]
            self._keep(first + rest, np.fromiter(map(len, got), np.int64, len(got)), np.fromiter((i for g in got for i in g), np.int64))
        plain = np.flatnonzero(plain)
        for lo in range(0, len(plain), 4000):
            which = plain[lo : lo + 4000]
            size = end[which] - start[which]
            body = data[ranges(start[which], size)]
            whole = body.tobytes().decode("utf-8", "replace")
            ids = np.array(self.plain.encode_batch_fast([whole], add_special_tokens=False)[0].ids, np.int64)
            # each piece has one space, its first byte, so its first id is the one that starts with a space
            tops = np.flatnonzero(self.spaced[ids])
            if len(tops) != len(which) or tops[0]:
                got = self.plain.encode(whole, add_special_tokens=False)
                ids = np.array(got.ids, np.int64)
                starts = np.append(0, np.cumsum([len(text(i)) for i in which.tolist()]))[:-1]
                tops = np.searchsorted(np.fromiter((s for s, _ in got.offsets), np.int64, len(got)), starts)
            self._keep(first + which, np.diff(tops, append=len(ids)), ids)
        self.known += n

    def _keep(self, at: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[at] = self.used + np.cumsum(sizes) - sizes
        self.count[at] = sizes
        self.used += len(ids)

    def _with_added(self, data: np.ndarray, offs: np.ndarray) -> set[int]:
        """The texts that hold an added token's content."""
        out, body = set(), data.tobytes()
        for token in self.added:
            at = body.find(token)
            while at >= 0:
                i = int(np.searchsorted(offs, at, "right")) - 1
                if at + len(token) <= offs[i + 1]:
                    out.add(i)
                    at = body.find(token, int(offs[i + 1]))
                else:
                    at = body.find(token, at + 1)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, ends)``: all ids of a block of texts end to end, and where each text's ids end; null counts as empty."""
        if self.known > CACHE:
            self._clear()
        words = Words(texts, bounds=False)
        data, offs = words.data, words.offs
        lead = data == 0x20
        lead[offs[:-1][offs[:-1] < len(data)]] = True
        start = np.flatnonzero(lead)
        end = np.append(start[1:], len(data)).astype(np.int64)
        h = words.hashes(start, end) ^ (end - start).astype(np.uint64)
        which = self._find(h)
        new = np.flatnonzero(which < 0)
        if len(new):
            fresh, one = np.unique(h[new], return_index=True)
            first = self.known
            self._learn(data, start[new[one]], end[new[one]])
            self._store(fresh, first)
            which[new] = self._find(h[new])
        counts = self.count[which].astype(np.int64)
        ids = self.ids[ranges(self.start[which], counts)]
        sums = np.concatenate([[0], np.cumsum(counts)])
        first = np.searchsorted(start, offs)  # each text's first piece
        tops = sums[first]
        bad = self.shut[which[:-1]] & self.open[which[1:]]
        inner = first[(first > 0) & (first < len(which))]
        bad[inner - 1] = False
        odd = self._with_added(data, offs)
        if not bad.any() and not odd:
            return ids, tops[1:]
        odd |= set((np.searchsorted(first, np.flatnonzero(bad), "right") - 1).tolist())
        parts = [
            np.array(self.model.encode(texts[i].as_py(), add_special_tokens=False).ids, ids.dtype) if i in odd else ids[tops[i] : tops[i + 1]]
            for i in range(len(texts))
        ]
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])
