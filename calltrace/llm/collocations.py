"""Phrase collocations, counted by weighted acyclic automata.

Texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs, A-Z in lower case. From each place of a piece
goes one string of up to ``longest`` words; how often a shorter phrase occurs is the sum of the weights of all strings that begin with
it, so places alone are counted. A task takes texts of about ``shard_bytes`` at a time, sorts their strings, and builds a count transducer of each
range of strings (:mod:`calltrace.llm.automata`). The transducers of a range meet in one group, where their union sums the weights, and
sums over prefix ranges give the counts of all phrases; a phrase that the edge of a range cuts is summed over the ranges afterwards. Ranges are cut
at sampled strings, about ``range_bytes`` of text apart: a frequent word or phrase spreads over as many ranges as its continuations fill, and a
string that occurs often in a shard is one arc there. The driver holds one sampled string per eighth of a range; they say where ranges
end, and no count depends on them.

A candidate's parts are looked up by composing the acceptor of the parts asked for with the transducer of the phrases frequent enough, shard by
shard. A part is at least as frequent as its phrase, so none is missing.

Null texts have no words; a null language is ``und``. Repeated rows count each time. A text is read whole, by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calltrace.functions.work import materialize
from calltrace.llm.automata import Automaton, compose, sort_rows, union, word_list
from calltrace.llm.text import blocks, bounded_batches, raw

SHARD_BYTES = 3 << 20
RANGE_BYTES = 6 << 20
#: Phrases of a shard of the look-ups.
LOOKUP_ROWS = 200_000
#: Of a sampled string so many bytes are read.
SAMPLE_BYTES = 4096
#: 0: part of a word, 1: ends a word, 2: ends a piece too.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data)


def _places(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of texts, and for each the number of its piece and of its text."""
    data, offs = raw(texts)
    full = np.full(len(data) + len(texts) + 1, 0x0A, np.uint8)  # a text ends in a line end
    full[np.arange(len(data)) + np.repeat(np.arange(len(texts)), np.diff(offs))] = _lower(data)
    kind = _CLASS[full]
    inside = np.zeros(len(kind) + 1, np.int8)
    inside[1:] = kind == 0
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[start]
    text = np.searchsorted(offs[1:] + np.arange(len(texts)), start)
    at = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(full[kind == 0].tobytes())])
    return words, piece, text


def _windows(symbol: np.ndarray, piece: np.ndarray, longest: int) -> np.ndarray:
    """From each word the string of up to ``longest`` symbols that its piece holds, filled with 0."""
    out = np.zeros((len(symbol), longest), np.int32)
    for k in range(min(longest, len(symbol))):
        out[: len(symbol) - k, k] = np.where(piece[k:] == piece[: len(piece) - k], symbol[k:], 0)
    return out


def _cuts(rows: np.ndarray, words: list[bytes], edges: list[tuple[bytes, ...]]) -> np.ndarray:
    """For each edge, how many of the sorted rows come before it."""
    names, out = np.array([*words, b""], object)[:-1], []
    for edge in edges:
        lo, hi = 0, len(rows)
        for k in range(rows.shape[1]):
            word = edge[k] if k < len(edge) else b""
            at = int(np.searchsorted(names, word)) if word else -1
            known = word == b"" or at < len(words) and words[at] == word
            column = rows[lo:hi, k]
            lo, hi = lo + int(np.searchsorted(column, at + 1)), lo + int(np.searchsorted(column, at + 1, "right"))
            if not known:
                hi = lo
            if lo >= hi:
                break
        out.append(lo)
    return np.array(out, np.int64)


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks put together to about ``size`` bytes of text."""
    held, have = [], 0
    for block in blocks(batches, size):
        held.append(block)
        have += block.column("text").nbytes
        if have >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, have = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _sampled(step: int):
    def run(batches):
        phase, out = TaskContext.get().partitionId() * 7919 % step, []
        for batch in batches:
            data, offs = raw(batch.column("text"))
            for at in range(phase, len(data), step):
                text = int(np.searchsorted(offs, at, "right")) - 1
                words, piece, _ = _places(pa.array([data[at : min(int(offs[text + 1]), at + SAMPLE_BYTES)].tobytes()], pa.binary()))
                first = words.to_pylist()[1:]  # the first may be cut
                if first:
                    out.append((batch.column("lang")[text].as_py(), [w for w, p in zip(first, piece[1:], strict=True) if p == piece[1]]))
            phase = (phase - len(data)) % step
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.binary()))], names=["lang", "words"])

    return run


def range_edges(docs: DataFrame, range_bytes: int, longest: int = 4) -> list[tuple[str, tuple[bytes, ...]]]:
    """Sorted strings between ranges: every eighth of a sample that takes a string per ``range_bytes / 8`` of text."""
    sample = docs.mapInArrow(_sampled(max(1, range_bytes // 8)), "lang string, words array<binary>").collect()
    found = sorted((r.lang.encode(), tuple(bytes(w) for w in r.words[:longest])) for r in sample)
    return [(lang.decode(), words) for lang, words in found[8::8]]


def _transducers(edges, longest: int, shard_bytes: int):
    by: dict[str, list] = {}
    for i, (lang, words) in enumerate(edges):
        by.setdefault(lang, [i, []])[1].append(words)
    order = sorted(by, key=str.encode)

    def start(lang: str) -> tuple[int, list]:
        if lang in by:
            return tuple(by[lang])
        later = [x for x in order if x.encode() > lang.encode()]
        return (by[later[0]][0] if later else len(edges)), []

    def run(batches):
        for shard in _shards(batches, shard_bytes):
            words, piece, text = _places(shard.column("text"))
            if not len(words):
                continue
            names, symbol = word_list(words)
            listed = names.to_pylist()
            rows = _windows(symbol, piece, longest)
            langs = shard.column("lang").dictionary_encode()
            own = langs.indices.to_numpy(zero_copy_only=False)[text]
            out = []
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                mine = rows[own == k]
                if not len(mine):
                    continue
                strings, weights = sort_rows(mine)
                first, cuts = start(lang)
                bounds = [0, *_cuts(strings, listed, cuts).tolist(), len(strings)]
                for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    if a < b:
                        out.append((lang, first + i, int(weights[a:b].sum()), Automaton.build(names, strings[a:b], weights[a:b]).dump()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["lang", "range", "n", "blob"])

    return run


def _text(words: list[bytes], row: list[int]) -> str:
    return b" ".join(words[s - 1] for s in row).decode("utf-8", "replace")


def _summed(least: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        whole = union([Automaton.load(b) for b in pdf["blob"]])
        words, out = whole.words.to_pylist(), [(key[0], "", 0, int(pdf["n"].sum()))]
        for k, (rows, total) in enumerate(whole.prefixes(least), 1):
            full = rows[:, -1] > 0  # a string that ended earlier is none of this length
            out += [(key[0], _text(words, r), k, n) for r, n in zip(rows[full].tolist(), total[full].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["lang", "phrase", "words", "n"])

    return run


def phrase_counts(docs: DataFrame, least: int = 30, longest: int = 4, text: str = "text", lang: str = "lang", range_bytes: int = RANGE_BYTES, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, words, n)`` of all phrases of up to ``longest`` words that occur ``least`` times, and ``(lang, n)``: all words."""
    bounded_batches(docs.sparkSession)
    only = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    edges = range_edges(only, range_bytes, longest)
    shards = only.mapInArrow(_transducers(edges, longest, shard_bytes), "lang string, range long, n long, blob binary")
    parts = shards.groupBy("lang", "range").applyInPandas(_summed(least), "lang string, phrase string, words int, n long")
    told = materialize(parts.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("words") == 0)), "phrase-counts")
    counts, totals = told.where("words > 0"), told.where("words = 0").select("lang", "n")
    return counts, totals


def _acceptor(strings: list[tuple[str, str]], weights: np.ndarray, depth: int) -> Automaton:
    cut = [[lang.encode(), *phrase.encode().split(b" ")] for lang, phrase in strings]
    words, symbol = word_list(pa.array([w for s in cut for w in s], pa.large_binary()))
    size = np.array([len(s) for s in cut], np.int64)
    rows = np.zeros((len(cut), depth), np.int32)
    rows[np.repeat(np.arange(len(cut)), size), np.arange(len(symbol)) - np.repeat(np.cumsum(size) - size, size)] = symbol
    return Automaton.build(words, *sort_rows(rows, weights))


def look_up(asked: DataFrame, counts: DataFrame, longest: int = 4) -> DataFrame:
    """``(lang, phrase, n)`` of the different rows of ``asked`` that ``counts`` has."""
    shards = F.lit(-(-max(counts.count(), 1) // LOOKUP_ROWS)).cast("long")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"lang": [], "phrase": [], "n": []})
        wanted = _acceptor(list(zip(left["lang"], left["phrase"], strict=True)), np.ones(len(left), np.int64), longest + 1)
        have = _acceptor(list(zip(right["lang"], right["phrase"], strict=True)), right["n"].to_numpy(), longest + 1)
        rows, _, n = compose(wanted, have)
        words = wanted.words.to_pylist()
        return pd.DataFrame([(words[r[0] - 1].decode(), _text(words, [s for s in r[1:] if s]), c) for r, c in zip(rows.tolist(), n.tolist(), strict=True)], columns=["lang", "phrase", "n"])

    shard = F.pmod(F.xxhash64("lang", "phrase"), shards).alias("shard")
    left = asked.select("lang", "phrase").distinct().select(shard, "lang", "phrase").groupBy("shard")
    return left.cogroup(counts.select(shard, "lang", "phrase", "n").groupBy("shard")).applyInPandas(run, "lang string, phrase string, n long")


def scored_phrases(counts: DataFrame, longest: int = 4, share: int = 80) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of the candidates that no longer candidate with ``share`` percent of their count holds."""
    many = counts.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"))
    k = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = many.select("lang", "phrase", "words", "a", k).select(
        "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - words)").alias("right")
    )
    found = materialize(look_up(cuts.select("lang", F.explode(F.array("left", "right")).alias("phrase")), counts, longest), "phrase-parts")
    part = lambda name, n: found.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    told = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    told = told.withColumn("score", F.expr("(cast(a as decimal(20,0)) * 2000000BD) div (cast(l as decimal(20,0)) + r)"))
    least = told.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    inner = many.where("words >= 3").select("lang", "a", F.split("phrase", " ").alias("w"), "words")
    inner = inner.select("lang", "a", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m")).select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("i"))
    holders = inner.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    out = least.join(holders, ["lang", "phrase"], "left").where(F.expr(f"most IS NULL OR 100BD * most < {int(share)}BD * a"))
    return out.select("lang", "phrase", "a", "s.l", "s.r", "s.score")


def top_phrases(scored: DataFrame, totals: DataFrame, most: int = 2000) -> DataFrame:
    """Each language's first phrases; every task passes on at most ``most`` of a language."""
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, totals = phrase_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))
    return top_phrases(scored_phrases(counts), totals)


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) AS sizes(m) WHERE len(w) >= m)),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m >= 2 AND f >= 30),
cuts AS (SELECT lang, phrase, m, a, k, array_to_string(w[1 : k], ' ') AS p, array_to_string(w[k + 1 : m], ' ') AS q FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
told AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.p AND x.m = c.k JOIN counts y ON y.lang = c.lang AND y.phrase = c.q AND y.m = c.m - c.k),
least AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, a, array_to_string(w[i : i + s - 1], ' ') AS phrase
  FROM (SELECT lang, a, w, s, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM cand WHERE m >= 3))),
holders AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL),
kept AS (SELECT l.* FROM least l LEFT JOIN holders h ON h.lang = l.lang AND h.phrase = l.phrase WHERE h.most IS NULL OR 100::HUGEINT * h.most < 80::HUGEINT * l.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
