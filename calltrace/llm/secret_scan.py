"""Secret scans: fixed base patterns, and a battery of randomness tests for the tokens that they miss.

Base spans (assignments, access keys, long hexadecimal runs) come from three fixed patterns. Every other run of at least
``SHORTEST`` token characters is a candidate. Its encoding is the smallest of :data:`ENCODINGS` that holds its characters, and
the battery asks whether it could be a random string over that alphabet: chi-squared uniformity of its characters, the number
of runs in the two halves of the alphabet, and the serial correlation of neighbouring characters, each with its exact mean and
variance at the token's length. A candidate that one of them rejects at level ``alpha`` (three tests, Bonferroni) is no secret: rulers,
counters, alphabets, repeated pieces.

Short ordinary words pass such tests, because the tests have little power at their length. What a candidate must show besides is
evidence against ordinary text: its likelihood as a random string over that of ordinary text, which is half a first-order chain of
characters as they are and half a chain of words that are joined by capitals, digits or signs; Spark sums the counts of both over all tokens
of the corpus too short to be candidates. Under ordinary text such a ratio has mean 1 (over all encodings together), so it is an e-value, and it
grows with the length of a random token. False discoveries are controlled at share ``fdr`` within each band of lengths (16 to 31, 32 to
63, ...), so that many short words don't raise the bar for long tokens: the e-values of a band's different tokens are counted in steps of an
eighth, and the largest k whose k-th e-value is at least m / (fdr k) sets the band's threshold.

Texts are read whole; null counts as empty. Every input row is a row of the result, whatever its id; a text without secrets has no spans.
Positions are code points. A candidate that touches a base span is left to it. All patterns are linear in the text's length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltrace.functions.work import materialize
from calltrace.llm.text import blocks, bounded_batches, free_name, raw

KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]

#: ASCII letters in either case, and no others (a case-insensitive pattern would take a long s or a Kelvin sign as well).
_ANY = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_ASSIGN = re.compile("(?:" + "|".join(map(_ANY, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Runs that are long enough; a failing shorter run holds no longer one, so none is lost.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

SHORTEST = 16
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets in the order of their codes, from small to large.
ENCODINGS = {
    "decimal": _DIGITS, "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "lower": _LOWER, "upper": _UPPER, "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER, "BASE36": _DIGITS + _UPPER,
    "letters": _UPPER + _LOWER, "base62": _DIGITS + _UPPER + _LOWER, "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
SYMBOLS = _DIGITS + _UPPER + _LOWER + "+/-_"
_OTHER = len(SYMBOLS)
_CODE = np.full(256, _OTHER, np.uint8)
_CODE[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(_OTHER)
_CODES = _CODE.tobytes()
_WITHIN = [(name, len(a), frozenset(a), bytes.maketrans(a.encode(), bytes(range(len(a))))) for name, a in ENCODINGS.items()]
#: Steps a unit of the logarithm of an e-value is counted in, and its bounds.
STEPS, LOW, HIGH = 8, -10, 60


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, rank of the kind, end)`` in code points, sorted."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def encoding(token: str) -> tuple[str, int, np.ndarray] | None:
    """The smallest alphabet that holds a token without its padding: name, size, and the token's codes."""
    have = set(token)
    for name, size, within, table in _WITHIN:
        if have <= within:
            return name, size, np.frombuffer(token.encode().translate(table), np.uint8)
    return None


def _tail(z: float) -> float:
    """Two-sided normal tail."""
    return math.erfc(abs(z) / math.sqrt(2))


def uniformity(codes: np.ndarray, size: int) -> float:
    """p of the chi-squared statistic, by the cube root of a gamma variable with the statistic's exact mean and variance at this length."""
    n = len(codes)
    x = float((np.bincount(codes, minlength=size).astype(float) ** 2).sum()) * size / n - n
    mean, variance = size - 1.0, 2.0 * (size - 1) * (1 - 1 / n)
    k = mean * mean / variance
    return _tail(((max(x, 0.0) / mean) ** (1 / 3) - (1 - 1 / (9 * k))) * 3 * math.sqrt(k))


def runs(codes: np.ndarray, size: int) -> float:
    """p of the number of runs of codes in one half of the alphabet."""
    high = codes >= size // 2
    steps = len(codes) - 1
    changes = int((high[1:] != high[:-1]).sum())
    return _tail(max(abs(changes - steps / 2) - 0.5, 0.0) / math.sqrt(steps / 4))


def serial_correlation(codes: np.ndarray, size: int) -> float:
    """p of the correlation of neighbouring codes about the alphabet's own mean and variance."""
    y = codes - (size - 1) / 2
    return _tail(float((y[1:] * y[:-1]).sum()) / ((size * size - 1) / 12 * math.sqrt(len(codes) - 1)))


def battery(codes: np.ndarray, size: int) -> float:
    """One p for the three tests: a random token's is below ``a`` with a probability of at most about ``a``."""
    return min(1.0, 3 * min(uniformity(codes, size), runs(codes, size), serial_correlation(codes, size)))


def band(length: int) -> int:
    """Lengths in bands that double."""
    return length.bit_length()


def _pair_counts(batches):
    """Neighbouring characters within tokens shorter than a candidate."""
    total = np.zeros((_OTHER + 1) ** 2, np.int64)
    for block in blocks(batches):
        data, offs = raw(block.column("text"))
        code = np.full(len(data) + len(offs), _OTHER, np.uint8)  # texts end in something else
        at = np.arange(len(data)) + np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        code[at] = _CODE[data]
        edge = np.flatnonzero(code == _OTHER)
        length = np.diff(edge) - 1  # tokens lie between edges
        drop = np.flatnonzero(length >= SHORTEST)
        for a, b in zip((edge[drop] + 1).tolist(), edge[drop + 1].tolist(), strict=True):
            code[a:b] = _OTHER
        total += np.bincount(code[:-1].astype(np.int64) * (_OTHER + 1) + code[1:], minlength=len(total))
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], names=["pair", "n"])


def _joined_words(counts: np.ndarray) -> np.ndarray:
    """The chain of joined words: three of four times a letter is followed as in the corpus (case ignored) and a digit by a digit; else,
    and at the start and after a sign, a new part begins: digits, a sign, or a word in either case."""
    kind = np.array([0] * 10 + [1] * 26 + [2] * 26 + [3] * 4)
    letter = np.concatenate([np.zeros(10, int), np.arange(26), np.arange(26), np.zeros(4, int)])
    words = np.ones((27, 26))
    for a in range(_OTHER + 1):
        row = 26 if a == _OTHER else letter[a]
        if a == _OTHER or kind[a] in (1, 2):
            for half in (10, 36):
                words[row] += counts[a, half : half + 26]
    words = 0.9 * words / words.sum(axis=1, keepdims=True) + 0.1 / 26  # the corpus need not hold all words of the world
    begin = np.concatenate([np.full(10, 0.025), words[26] / 4, words[26] / 4, np.full(4, 0.0625)])
    out = np.tile(begin, (_OTHER + 1, 1))
    for a in range(_OTHER):
        if kind[a] == 0:
            out[a] = begin / 4 + np.where(kind == 0, 0.075, 0.0)
        elif kind[a] in (1, 2):
            on = np.zeros(_OTHER)
            on[36:62] = words[letter[a]] * (1.0 if kind[a] == 2 else 0.5)
            on[10:36] = words[letter[a]] * (0.0 if kind[a] == 2 else 0.5)
            out[a] = begin / 4 + 0.75 * on
    return out


def ordinary_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Logarithms of both chains' probabilities: by chain, by the character before (the last row: none), and by the character."""
    bounded_batches(docs.sparkSession)
    pairs = docs.select(F.col(text).alias("text")).mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = np.zeros((_OTHER + 1) ** 2)
    for r in pairs.collect():  # at most 67 x 67 rows
        counts[r.pair] = r.n
    counts = counts.reshape(_OTHER + 1, _OTHER + 1)[:, :_OTHER]
    return chains(counts)


def chains(counts: np.ndarray) -> np.ndarray:
    single = (counts.sum(axis=0) + 1) / (counts.sum() + _OTHER)
    return np.log(np.stack([(counts + 16 * single) / (counts.sum(axis=1, keepdims=True) + 16), _joined_words(counts)]))


def evidence(token: str, model: np.ndarray) -> tuple[float, float] | None:
    """The battery's p and the logarithm of the e-value of a token; None where it is of no encoding."""
    token = token.rstrip("=")
    found = encoding(token)
    if found is None:
        return None
    _, size, codes = found
    symbols = np.frombuffer(token.encode().translate(_CODES), np.uint8)
    ordinary = float(np.logaddexp(*(model[:, _OTHER, symbols[0]] + model[:, symbols[:-1], symbols[1:]].sum(axis=1)))) - math.log(2)
    return battery(codes, size), -len(token) * math.log(size) - ordinary - math.log(len(ENCODINGS))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("band", pa.int32()), ("step", pa.int32()), ("token", pa.int64())]))


def _named(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little", signed=True)


def _scan(doc_id: str, model: np.ndarray, alpha: float):
    def run(batches):
        for block in blocks(batches, column="text"):
            bases, found = [], []
            for text in block.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                ends, last = [], 0
                for s in base:  # where spans have ended by, in the order of their starts
                    last = max(last, s[2])
                    ends.append(last)
                starts = [s[0] for s in base]
                own = []
                for m in _TOKEN.finditer(text):
                    s, e = m.span()
                    at = bisect_left(starts, e)
                    if at and ends[at - 1] > s:
                        continue
                    if (got := evidence(m.group(), model)) and got[0] >= alpha:
                        own.append({"start": s, "end": e, "band": band(e - s), "step": math.floor(min(max(got[1], LOW), HIGH) * STEPS), "token": _named(m.group())})
                bases.append([{"start": s, "rank": k, "end": e} for s, k, e in base])
                found.append(own)
            yield pa.RecordBatch.from_arrays([block.column(doc_id), pa.array(bases, _SPANS), pa.array(found, _FOUND)], names=[doc_id, "base", "found"])

    return run


def thresholds(steps: DataFrame, fdr: float) -> dict[int, int]:
    """The step from which candidates of a band are discoveries, from ``(band, step, token)`` of all candidates; no entry for a band without any.

    A band has at most ``STEPS * (HIGH - LOW) + 1`` steps, so the driver gets some hundred counts a band.
    """
    by: dict[int, list] = {}
    for r in steps.distinct().groupBy("band", "step").count().collect():
        by.setdefault(r.band, []).append((r.step, r["count"]))
    out = {}
    for b, counted in by.items():
        total, so_far = sum(n for _, n in counted), 0
        for step, n in sorted(counted, reverse=True):
            so_far += n
            if math.exp(step / STEPS) * fdr * so_far >= total:
                out[b] = step
    return out


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", alpha: float = 0.001, fdr: float = 0.01) -> DataFrame:
    """``(doc_id, base, spans)`` per input row: arrays of ``(start, rank, end, kind)``, sorted; ``spans`` also holds what the battery adds."""
    bounded_batches(docs.sparkSession)
    model = ordinary_model(docs, text)
    only = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    scanned = materialize(
        only.mapInArrow(_scan("id", model, alpha), f"id {kind}, base array<struct<start:int,rank:int,end:int>>, found array<struct<start:int,end:int,band:int,step:int,token:bigint>>"), "secret-candidates"
    )
    least = thresholds(scanned.select(F.explode("found").alias("f")).select("f.band", "f.step", "f.token"), fdr)
    bars = F.create_map(*[F.lit(x) for pair in sorted(least.items()) for x in pair]) if least else F.create_map().cast("map<int,int>")
    names = F.array(*map(F.lit, KINDS))
    named = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.get(names, s["rank"]).alias("kind"))
    base = F.transform("base", named)
    added = F.filter("found", lambda f: F.coalesce(f["step"] >= F.try_element_at(bars, f["band"]), F.lit(False)))
    random = F.lit(KINDS.index("random")).cast("int")
    spans = F.array_sort(F.concat(base, F.transform(added, lambda f: F.struct(f["start"].alias("start"), random.alias("rank"), f["end"].alias("end"), F.lit("random").alias("kind")))))
    return scanned.select(F.col("id").alias(doc_id), *(c.alias(free_name(n, [doc_id])) for c, n in ((base, "base"), (spans, "spans"))))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(F.encode(_joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
