"""Automata against dictionaries, phrase mining against a plain count, whatever the shards and ranges."""

import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from calltrace.llm import collocations
from calltrace.llm.automata import Automaton, compose, sort_rows, union, word_list


def made(strings, depth=3):
    words, symbol = word_list(pa.array([w for s in strings for w in s], pa.large_binary()))
    rows, at = np.zeros((len(strings), depth), np.int64), 0
    for k, s in enumerate(strings):
        rows[k, : len(s)] = symbol[at : at + len(s)]
        at += len(s)
    return Automaton.build(words, *sort_rows(rows, np.array(list(strings.values()), np.int64)))


def told(a):
    names = [b"", *a.words.to_pylist()]
    rows, weights = a.strings()
    assert rows.tolist() == sorted(rows.tolist())
    return {tuple(names[s] for s in r if s): int(n) for r, n in zip(rows.tolist(), weights, strict=True)}


def test_automata():
    rnd = random.Random(1)
    vocabulary = [b"a", b"b", b"cc", "é".encode(), b"z"]
    some = lambda: {tuple(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 3))): rnd.randint(1, 3) for _ in range(rnd.randint(0, 20))}
    for _ in range(150):
        x, y = some(), some()
        a, b = made(x), made(y)
        assert told(a) == x and told(Automaton.load(a.dump())) == x
        assert told(union([Automaton.load(a.dump()), b])) == collections.Counter(x) + collections.Counter(y)
        rows, p, q = compose(a, b)
        names = [b"", *a.words.to_pylist()]
        assert {tuple(names[s] for s in r if s): (int(n), int(m)) for r, n, m in zip(rows.tolist(), p, q, strict=True)} == {k: (x[k], y[k]) for k in x if k in y}
        for k, (rows, total) in enumerate(a.prefixes(), 1) if x else ():
            sums = collections.Counter()
            for s, n in x.items():
                sums[(*s, b"", b"", b"")[:k]] += n
            assert {tuple(names[s] for s in r): int(n) for r, n in zip(rows.tolist(), total, strict=True)} == sums


def test_automaton_is_minimal():
    """Equal continuations are one state: 6 x 5 x 4 strings of one weight need a state a level."""
    a = made({(bytes([97 + i]), bytes([97 + j]), bytes([97 + k])): 7 for i in range(6) for j in range(5) for k in range(4)})
    assert a.states == 3


def brute(rows, least, most=2000):
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = lang or "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    count[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, f in count.items():
        many = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        held = collections.Counter()
        for p, a in many.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i : i + m]] = max(held[p[i : i + m]], a)
        scored = []
        for p, a in many.items():
            if 100 * held[p] >= 80 * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def corpus(n=250):
    rnd = random.Random(3)
    words = [f"{a}{b}" for a in ("the", "Of", "und", "ß", "é") for b in ("", "a", "en", "-it", "'s")] + ["New", "York"]
    rows = []
    for i in range(n):
        t = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t ", ", ", ".\n", " \x0b", "\x85", " "]) for _ in range(rnd.randrange(60)))
        if i % 3 == 0:
            t += " in New York City of New York City"
        rows.append((t, [None, "en", "de", "und", ""][i % 5], "clash", i))
    rows += [(None, "en", None, 0), ("", "fr", None, 0), (" .,;\n", None, None, 0), ("of the " * 3000, "en", None, 1), ("x" * 20000, "en", None, 1)]
    return rows + rows[:20]


SCHEMA = "text string, lang string, phrase string, n long"


@pytest.mark.parametrize("range_bytes,shard_bytes", [(1 << 23, 1 << 23), (300, 2000), (4000, 500)])
def test_phrases(spark, range_bytes, shard_bytes):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    counts, totals = collocations.phrase_counts(docs, least=8, range_bytes=range_bytes, shard_bytes=shard_bytes)
    got = collocations.top_phrases(collocations.scored_phrases(counts), totals, 40)
    assert sorted(tuple(r) for r in got.collect()) == brute([r[:2] for r in rows], 8, 40)


def test_ranges_split_a_hot_phrase(spark):
    rows = [(f"of the x{i} y{i % 7} of the z{i % 11} w{i}", "en", None, 0) for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    edges = collocations.range_edges(docs.select("lang", "text"), 2000)
    assert len(edges) > 4 and edges == sorted(edges)
    counts, _ = collocations.phrase_counts(docs, least=5, range_bytes=2000)
    assert {r.phrase: r.n for r in counts.collect()}["of the"] == 1800


def test_query_and_its_sql(spark, tmp_path):
    rows = [(t, lang, p, n) for t, lang, p, n in corpus(120) for _ in range(2)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in collocations.op13_phrase_collocations(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(collocations.OP13_SQL).fetchall()) == brute([r[:2] for r in rows], 30) and len(got) > 8


def test_large_counts_are_exact(spark):
    """Products past 64 bits."""
    big = 9_000_000_000_000_000
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 2)], "lang string, phrase string, words int, n long")
    r = collocations.scored_phrases(counts).first()
    assert r.score == 2000000 * big // (2 * big + 3) and (r.l, r.r) == (big + 1, big + 2)


def test_nothing_to_count(spark):
    counts, totals = collocations.phrase_counts(spark.createDataFrame([], SCHEMA))
    assert collocations.top_phrases(collocations.scored_phrases(counts), totals).count() == 0
