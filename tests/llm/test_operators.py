"""Each operator against brute force on a small corpus, with nulls, empties, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from calltrace.functions.work import new_path
from calltrace.llm import decontamination, exact_dedup, line_dedup, mixing, ngram_join, pfor, pii, substring_dedup, token_counts, token_output, toxicity
from calltrace.llm.text import Words, plain_hashes

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_words_and_hashes():
    w = Words(pa.array(["a b", None, "", "  b a\n", "é à"]))
    assert len(w) == 6 and w.first.tolist() == [0, 2, 2, 2, 4, 6]
    h = w.hashes()
    assert h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 4
    p = plain_hashes(Words(pa.array(['"Été,', "été", "A.", "a"])))
    assert p[0] == p[1] and p[2] == p[3]


# --- 1 -------------------------------------------------------------------------------------------------------------------
def shingles(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    texts = collections.defaultdict(list)
    for d, t in rows:
        texts[tuple(words(t))].append(d)
    reps = [(min(v), shingles(" ".join(k))) for k, v in texts.items() if k]
    links, up = collections.Counter(), {r: r for r, _ in reps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(reps):
        for b, t in reps[:i]:
            if len(s & t) >= 0.8 * len(s | t):
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                up[y] = x
    out = {}
    for k, v in texts.items():
        for d in v:
            out[d] = (root(min(v)), min(v), len(v), links[min(v)]) if k else (d, d, 1, 0)
    return out


def test_ngram_join(docs, corpus, empty):
    got = {r.doc_id: (r.class_id, r.text_id, r.n_copies, r.n_links) for r in ngram_join.jaccard_classes(docs).collect()}
    assert got == brute_classes([(r[0], r[1]) for r in corpus]) and len(got) == len(corpus)
    assert ngram_join.jaccard_classes(empty).count() == 0
    kept = {r.doc_id for r in ngram_join.one_of_each_class(docs).collect()}
    assert kept == {d for d, v in got.items() if v[0] == d}


def test_ngram_join_blocks(spark, monkeypatch):
    """A group larger than a block: every link is counted once."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: i % 60], f"new{i}", *base[i % 60 + 1 :]])) for i in range(150)]
    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    got = {r.doc_id: (r.class_id, r.text_id, r.n_copies, r.n_links) for r in ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_ngram_join_repeated(repeated):
    got = ngram_join.jaccard_classes(repeated).collect()
    assert len(got) == 36 and [r.class_id for r in got if r.doc_id is None] == [None]
    assert ngram_join.one_of_each_class(repeated).where("doc_id = 1").count() == 1


def test_least_matches_keeps_certain_pairs():
    least = ngram_join.least_matches(0.8)
    assert least[0] == 0 and all(a <= b for a, b in zip(least, least[1:], strict=False)) and least[-1] < 0.8 * ngram_join.HASHES


# --- 2 -------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("hash_all", [True, False])
def test_exact_dedup(docs, corpus, empty, hash_all):
    groups = collections.defaultdict(list)
    for r in corpus:
        groups[SPACE.sub("", r[1] or "")].append((-len(r[1] or ""), r[0]))
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs, hash_all=hash_all).collect()}
    for norm, members in groups.items():
        for _, d in members:
            r = got[d]
            assert (r.keep_id, r.group_size, r.kept) == (min(members)[1], len(members), d == min(members)[1])
            assert r.text_sha256 == sha(norm) or (not hash_all and len(members) == 1)
    assert exact_dedup.exact_groups(empty, hash_all=hash_all).count() == 0


# --- 3 -------------------------------------------------------------------------------------------------------------------
def test_targets_and_flow():
    want = mixing.targets({"b": 100, "a": 10, None: 1000})
    assert want["a"] == 20 and want["b"] == 200 and abs(want[None] - (1665 - 220)) < 1e-9
    flow = mixing.min_cost_flow({"x": 10, "xy": 10, "y": 10}, {"x": ["X"], "xy": ["X", "Y"], "y": ["Y"]}, {"X": 18, "Y": 12})
    assert flow["x", "X"] == 10 and sum(v for (_, s), v in flow.items() if s == "X") == 18 and sum(v for (_, s), v in flow.items() if s == "Y") == 12
    assert sum(v for (p, _), v in flow.items() if p == "xy") == 10  # no repetition where none is needed


def test_mixing(docs, corpus, empty, repeated):
    rows = mixing.mix(docs).collect()
    size = collections.Counter()
    for r in corpus:
        size[r[3]] += len(words(r[1]))
    want = mixing.targets(size)
    source = {r[0]: r[3] for r in corpus}
    taken = collections.Counter()
    for r in rows:
        assert r.size == len(words(corpus[r.doc_id][1])) and r.source_size == size[source[r.doc_id]] and r.target == want[source[r.doc_id]] and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in want)
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(7)).collect())
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(repeated).columns == repeated.columns
    kept = mixing.mixed_documents(docs).groupBy("doc_id").count().collect()
    assert all(r["count"] <= 2 for r in kept)


def test_flow_costs_least():
    """The flow against the least cost that any routing has, found by trying all."""
    import itertools

    rnd = random.Random(2)
    for _ in range(40):
        sources = ["A", "B", "C"][: rnd.randrange(1, 4)]
        members = {f"p{k}": sorted(rnd.sample(sources, rnd.randrange(1, len(sources) + 1))) for k in range(rnd.randrange(1, 4))}
        supply, want = {p: rnd.randrange(0, 4) for p in members}, {s: rnd.randrange(0, 5) for s in sources}
        flow = mixing.min_cost_flow(supply, members, want)
        edges = [(p, s) for p in members for s in members[p]]
        assert set(flow) <= set(edges)
        value = lambda f: (
            None if any(sum(f.get((p, s), 0) for p in members) > want[s] for s in sources) or any(sum(f.get((p, s), 0) for s in sources) > 2 * supply[p] for p in members)
            else (sum(f.values()), -sum(max(0, sum(f.get((p, s), 0) for s in sources) - supply[p]) for p in members))
        )
        best = max(v for n in itertools.product(range(5), repeat=len(edges)) if (v := value(dict(zip(edges, n, strict=True)))) is not None) if len(edges) < 6 else None
        assert value(flow) is not None and (best is None or value(flow) == best)
    many = {f"p{k}": [f"s{k % 50}", f"s{k * 7 % 50}"] for k in range(20_000)}
    got = mixing.min_cost_flow(dict.fromkeys(many, 10), many, {f"s{k}": 5000 for k in range(50)})
    assert sum(got.values()) == 250_000


def test_mixing_overlapping_sources(docs, corpus, repeated):
    """Documents of several sources reach the mix, every pattern is free."""
    both = F.when(F.col("doc_id") % 3 == 0, F.array("source", F.concat(F.lit("t"), (F.col("doc_id") % 5).cast("string")))).when(F.col("doc_id") % 50 == 1, F.array().cast("array<string>")).otherwise(F.array("source"))
    member = {r[0]: {r[3], f"t{r[0] % 5}"} if r[0] % 3 == 0 else set() if r[0] % 50 == 1 else {r[3]} for r in corpus}
    size = {r[0]: len(words(r[1])) for r in corpus}
    by_source = collections.Counter()
    for d, names in member.items():
        for s in names:
            by_source[s] += size[d]
    want = mixing.targets(by_source)
    rows = mixing.mix(docs, sources=both).collect()
    assert len(rows) == len(corpus) and all(r.taken <= 2 * r.size for r in rows) and all(r.taken == 0 for r in rows if not member[r.doc_id])
    assert sum(r.taken for r in rows) > 0.8 * min(sum(want.values()), 2 * sum(size.values())) and len({r.pattern for r in rows}) <= 40
    kept = mixing.mixed_documents(docs, sources=both).collect()
    copies = collections.Counter(r.doc_id for r in kept)
    assert {r.doc_id: r.copies for r in rows if r.copies} == dict(copies) and any(len(member[d]) == 2 for d in copies)
    odd = repeated.withColumns({"p_n": F.lit("x"), "copy": F.lit("y")}).drop("source")
    out = mixing.mixed_documents(odd, sources=F.array(F.lit("one")))
    assert out.columns == odd.columns and {(r.p_n, r.copy) for r in out.collect()} == {("x", "y")}


def test_mixing_parts_equal_one_flow(spark):
    """Connected parts solved by themselves give the flow of the whole graph; many sources, null among them."""
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        p = rnd.randrange(60)
        mine = [None if p == 7 else f"s{p}"] + ([f"s{p + 60}"] if i % 3 == 0 else []) + ([f"s{(p // 10) * 10}"] if i % 7 == 0 else [])
        rows.append((i, " ".join(["w"] * rnd.randrange(9)), mine))
    df = spark.createDataFrame(rows, "doc_id long, text string, many array<string>")
    got = mixing.mix(df, sources=F.col("many")).collect()
    supply, members, by = collections.Counter(), {}, collections.Counter()
    for r in got:
        supply[r.pattern] += r["size"]
        members[r.pattern] = sorted(set(rows[r.doc_id][2]), key=lambda s: (s is not None, s or ""))
        for s in members[r.pattern]:
            by[s] += r["size"]
    want = mixing.targets(by)
    flow = mixing.min_cost_flow(supply, members, {s: int(t) for s, t in want.items()}, 2)
    assert sum(r.taken for r in got) == sum(flow.values())
    taken = collections.Counter()
    for r in got:
        taken[r.pattern] += r.taken
    # the least cost: as many words as can be are taken once before any is taken twice
    once = mixing.min_cost_flow(supply, members, {s: int(t) for s, t in want.items()}, 1)
    assert sum(min(taken[p], n) for p, n in supply.items()) == sum(once.values())


# --- 4 -------------------------------------------------------------------------------------------------------------------
def test_decontamination(spark, docs, corpus, empty):
    clean = corpus[12][1].split()
    item = " ".join(f"bench{i} {clean[i]}" for i in range(18))
    changed = item.split()
    changed[5] = "other"
    half = [w for i, w in enumerate(item.split()) if i % 4]
    rows = [*corpus, (1000, f"some words before {item.upper()} and after", *corpus[0][2:]), (1001, f"start {' '.join(changed)} end", *corpus[0][2:]), (1002, "start " + " ".join(half) + " end", *corpus[0][2:])]
    bench = spark.createDataFrame([(1, item), (2, "words never seen anywhere qqq zzz yyy"), (3, None), (4, "")], "item_id long, text string")
    d = spark.createDataFrame(rows, docs.schema)
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(d, bench).collect()}
    assert {(1000, 1), (1001, 1)} <= set(got) and got[1000, 1].lcs == 1.0 and got[1001, 1].kind == "copy" and all(k[0] >= 1000 for k in got)
    kept = {r.doc_id for r in decontamination.decontaminated(d, bench).collect()}
    assert {r[0] for r in corpus} <= kept and 1000 not in kept
    assert decontamination.contaminated(empty, bench).count() == 0 and decontamination.contaminated(docs, bench.where("item_id = 3")).count() == 0


def test_paraphrases_without_answers(spark, docs, corpus):
    """A paraphrase is found though some of the rarest words are missing; common words in the same order are none."""
    rnd, clean = random.Random(3), corpus[12][1].split()
    item = [f"bench{i // 2}" if i % 2 == 0 else clean[i // 2] for i in range(36)]
    rows = [*corpus, (1002, " ".join(["start", *(w for i, w in enumerate(item) if i % 4), "end"]), *corpus[0][2:])]
    for k in range(20):
        gone = set(rnd.sample(range(36), 9))
        rows.append((1100 + k, " ".join(f"new{k}x{i}" if i in gone else w for i, w in enumerate(item)), *corpus[0][2:]))
    rows.append((1200, " ".join(f"other{i}" if i % 2 == 0 else w for i, w in enumerate(item)), *corpus[0][2:]))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.kind for r in decontamination.contaminated(spark.createDataFrame(rows, docs.schema), bench).collect()}
    assert got == {i: "paraphrase" for i in (1002, *range(1100, 1120))}


def test_copies_beyond_the_latent_space(spark, monkeypatch):
    """Copies are found where the latent space is too small for the block's passages."""
    monkeypatch.setattr(decontamination, "RANK", 8)
    items = [" ".join(f"i{k}w{j}" for j in range(24)) for k in range(40)]
    rows = [(k, f"{t} {' '.join(items[k % 4].split()[:16])}") for k, t in enumerate(items) if k > 3]
    rows += [(100 + i, items[i % 4]) for i in range(40)] + [(1000 + i, f"nothing of it {i}") for i in range(200)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(k, i) for k in range(4, 40) for i in (k, k % 4)} | {(100 + i, i % 4) for i in range(40)}
    assert min(got[k, k].cosine for k in range(4, 40)) < decontamination.COSINE and all(got[k, k].lcs == 1.0 for k in range(4, 40))


def test_benchmark_pages(spark, monkeypatch):
    """Items of more rows than a page, rows repeated whole, and items that cross a page's border: each row is searched."""
    monkeypatch.setattr(decontamination, "PASSAGES", 2)
    text = lambda k: " ".join(f"{w}{k}" for w in "ab cd ef gh ij kl mn op qr st".split())
    items = [(1, text(0)), *[(2, text(k)) for k in range(1, 6)], (2, text(1)), (2, text(1)), (3, text(6))]
    rows = [(k, f"before {text(k)} after") for k in range(7)] + [(100, " ".join(text(k) for k in range(1, 6)))] + [(i, f"nothing of it {i}") for i in range(200, 300)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_passages for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(0, 1): 1, (6, 3): 1, (100, 2): 5} | {(k, 2): 1 for k in range(1, 6)}


@pytest.mark.parametrize("passages", [1200, 7])
def test_contamination_against_all_pairs(spark, monkeypatch, passages):
    """All pairs by brute force: every copy is found as such, everything found is at least a paraphrase in order, items of many passages
    and rows repeated whole or in their id included."""
    monkeypatch.setattr(decontamination, "PASSAGES", passages)
    rnd = random.Random(12)
    common = [f"c{i}" for i in range(60)]
    text = lambda n: [rnd.choice(common) if rnd.random() < 0.4 else f"w{rnd.randrange(4000)}" for _ in range(n)]
    items = [(k, " ".join(text(rnd.choice([12, 20, 30, 95])))) for k in range(24)] + [(3, " ".join(text(25))), (None, " ".join(text(25)))]
    items += [items[4], (900, None), (901, "")]
    rows = []
    for d in range(140):
        w = text(rnd.randrange(30, 160))
        if d % 3 == 0:
            part = items[rnd.randrange(25)][1].split()
            lo, noise = rnd.randrange(0, max(1, len(part) - 40)), rnd.choice([0, 0.1, 0.3, 0.6])
            part = [f"x{d}y{i}" if rnd.random() < noise else v for i, v in enumerate(part[lo : lo + 60])]
            at = rnd.randrange(len(w))
            w = w[:at] + part + w[at:]
        rows.append((d, " ".join(w)))
    rows += [*rows[:20], (7, " ".join(text(50))), (None, "start " + items[0][1]), (500, None), (501, "")]

    def best(a, b):
        masks = {}
        for i, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << i
        size = len(a) + len(a) // 2 + 2
        return max(decontamination.lcs(masks, len(a), b[s : s + size]) for s in range(max(1, len(b) - size + 1))) / len(a)

    passages_of = collections.defaultdict(list)
    for i, t in items:
        if i is not None and t:
            w = t.split()
            passages_of[i] += [list(p) for p in np.array_split(np.array(w), -(-len(w) // decontamination.ITEM_WORDS))]
    share = {(d, i): max(best(p, t.split()) for p in ps) for d, t in set(rows) if t for i, ps in passages_of.items()}
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bench).collect()
    got = {(r.doc_id, r.item_id): r for r in out}
    copies = {k for k, v in share.items() if v >= decontamination.COPY}
    assert len(copies) > 20 and copies <= set(got) and all(got[k].kind == "copy" for k in copies)
    assert all(share[k] >= decontamination.PARAPHRASE for k in got) and all(got[k].lcs <= share[k] + 1e-9 for k in got)


def test_answer_check(spark):
    text = " ".join(f"a{i}" for i in range(20))
    part = " ".join(f"a{i}" for i in range(20) if i % 3)
    bench = spark.createDataFrame([(1, text, "a1 a2"), (2, text, "missing answer")], "item_id long, text string, answer string")
    rows = [(1, "x y z " + part), *[(i, f"nothing of it {i}") for i in range(2, 200)]]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert [(r.doc_id, r.item_id, r.kind) for r in got] == [(1, 1, "paraphrase")]


# --- 5 -------------------------------------------------------------------------------------------------------------------
def brute_cut(rows, n=20):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            key = tuple(w[s : s + n])
            if key in seen:
                gone[s : s + n] = [True] * n
            seen.add(key)
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_substring_dedup(docs, corpus, empty):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute_cut([(r[0], r[1]) for r in corpus])
    assert substring_dedup.remove_repeats(empty).count() == 0 and substring_dedup.remove_repeats(docs).columns[: len(docs.columns)] == docs.columns


def test_substring_dedup_repeated(repeated, corpus):
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(repeated).collect()}
    want = brute_cut([(-1, "a row without an id"), *[(r[0], r[1]) for r in corpus[:30]]])
    assert got == {(None if d < 0 else d, *v) for d, v in want.items()}


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_substring_dedup_equal_rows(spark, parts):
    """Rows repeated whole keep the words of their first occurrence, however the rows are dealt."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, long), (2, f"x {long} y"), (2, f"x {long} y"), (None, f"{long} z"), (None, f"{long} z"), (3, " ".join(["r"] * 50)), (3, " ".join(["r"] * 50))]
    got = {(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartition(parts)).collect()}
    assert got == {(None, 0), (1, 60), (2, 60), (3, 49)}


def test_substring_dedup_clashing_columns(repeated):
    clash = repeated.withColumns({"n_words": F.lit("a"), "kept_text": F.lit(1), "_ss_at": F.lit(2), "c0": F.lit(3)})
    out = substring_dedup.remove_repeats(clash)
    assert out.columns == [*clash.columns, "n_words_", "n_removed", "kept_text_"] and {(r.n_words, r.kept_text, r._ss_at, r.c0) for r in out.collect()} == {("a", 1, 2, 3)}


# --- 6 -------------------------------------------------------------------------------------------------------------------
def brute_lines(rows, least=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    n = collections.Counter()
    for _, t in rows:
        n.update({key(x) for x in (t or "").split("\n")})
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or n[key(x)] < least]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(docs, corpus, empty, batches):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.drop_frequent_lines(docs, batches=batches, fanout=2).collect()}
    assert got == brute_lines([(r[0], r[1]) for r in corpus])
    assert line_dedup.drop_frequent_lines(empty).count() == 0


def test_line_dedup_repeated(spark, repeated, corpus):
    """Rows repeated with one id and text, or without an id, are documents of their own."""
    rows = [*((r[0], r[1]) for r in corpus[:30]), *((r[0], r[1]) for r in corpus[:5]), (None, "a row without an id")]
    rows += [(None, "a\nshared line")] * 6 + [(1000, "b\nShared line ")] * 4 + [(2000, None)] * 12
    got = line_dedup.drop_frequent_lines(spark.createDataFrame(rows, "doc_id long, text string"), fanout=2).collect()
    want = []
    n = collections.Counter(k for _, t in rows for k in {x.strip().lower() for x in (t or "").split("\n")})
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not x.strip() or n[x.strip().lower()] < 10]
        want.append((d or -1, len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert n["shared line"] == 10 and sorted((r.doc_id or -1, r.n_lines, r.n_dropped, r.kept_text) for r in got) == sorted(want)
    clash = repeated.withColumns({"kept_text": F.lit(1), "n_lines": F.lit("x"), "c0": F.lit(2)})
    out = line_dedup.drop_frequent_lines(clash)
    assert out.columns == [*clash.columns, "kept_text_", "n_lines_", "n_dropped"] and {(r.kept_text, r.n_lines, r.c0) for r in out.collect()} == {(1, "x", 2)}


def test_line_runs(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    assert runs.compact() is None
    for k in range(5):
        runs.add(spark.createDataFrame([(i, i, 1) for i in range(k, k + 3)], "h1 long, h2 long, n_docs long"))
    assert len(runs.runs()) == 2
    latest = {r.h1: r.n_docs for r in runs.runs()[0].collect()}
    assert latest == {4: 3, 5: 2, 6: 1}  # a batch's own run carries the counts of earlier ones on
    total = {r.h1: r.n_docs for r in runs.compact().collect()}
    assert total == {0: 1, 1: 2, 2: 3, 3: 3, 4: 3, 5: 2, 6: 1} and len(runs.runs()) == 1
    runs.close()
    assert not runs.runs() and not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_runs_stay_where_they_are(spark):
    """Neither the merge of a batch nor that of a level shuffles a run."""
    runs = line_dedup.LineRuns(spark, fanout=9)
    batch = spark.range(3000).select("id", (F.col("id") * 7).alias("h2")).selectExpr("id AS h1", "h2", "1L AS n_docs")
    for _ in range(2):
        runs.add(batch)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = batch.join(runs.runs()[0].withColumnRenamed("n_docs", "before"), ["h1", "h2"], "left")
        merged = runs._latest(runs.levels[0])
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (joined, merged)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plans[0].count("Exchange hashpartitioning") == 1 and "Exchange" not in plans[1]
    runs.close()


# --- 7 -------------------------------------------------------------------------------------------------------------------
def test_pfor_round_trip():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0), rng.integers(0, 50257, 5000), np.where(rng.random(3000) < 0.02, 60000, rng.integers(500, 530, 3000)), np.full(1024, 7), np.array([4_000_000_000, 1])):
        ids = ids.astype(np.uint32)
        s = pfor.Shard(pfor.encode(ids, [3, None], np.array([1, len(ids)])))
        assert (s.ids() == ids).all() and s.doc_ids == [3, None] and all((s.block(k) == ids[k * 1024 : (k + 1) * 1024]).all() for k in range(s.blocks))
    with pytest.raises(ValueError):
        pfor.Shard(b"something else")


def test_token_output(docs, corpus, empty, repeated):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: tuple(r)[1:] for r in token_output.token_output(docs, shard_ids=500).collect()}
    at = 0
    for r in sorted(corpus):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        assert got[r[0]] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_output.token_output(empty).count() == 0 and token_output.token_output(repeated).count() == 36


def test_token_output_hot_id(spark):
    """An id that holds nearly all rows, and rows that are equal, are dealt into several ranges."""
    rows = [(None, f"text {i % 50}") for i in range(400)] + [(1, "same")] * 400 + [(2, "last")]
    folder = new_path(spark, "hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = token_output.token_output(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 801 and sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got) and len({r.start for r in got}) == 801
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == [None] * 400 + [1] * 400 + [2]
    assert min(r.n_docs for r in spark.read.parquet(f"{folder}/manifest").collect()) < 400 and spark.read.parquet(f"{folder}/manifest").where("n_docs > 350").count() == 0


def test_paths_without_a_scheme(spark, tmp_path):
    from calltrace.functions.work import qualified

    assert qualified(spark, str(tmp_path)) == f"file:{tmp_path}" == qualified(spark, f"file://{tmp_path}/")


def test_encoder_matches_whole_texts():
    import random

    from calltrace.llm.tokens import Encoder

    rnd, e = random.Random(1), Encoder.of("byte_bpe_50k.json")
    texts = ["".join(rnd.choice(["a", "é", "1", " ", "  ", "\n", "\t", " ", "'s", "!", "<|endoftext|>", "\x1c", "　", "b c", "\0"]) for _ in range(rnd.randrange(0, 30))) for _ in range(1500)]
    ids, ends = e.encode(pa.array(texts))
    parts = np.split(ids, ends[:-1])
    assert all(e.model.encode(t, add_special_tokens=False).ids == p.tolist() for t, p in zip(texts, parts, strict=True))


# --- 8 -------------------------------------------------------------------------------------------------------------------
def test_encoder_keeps_added_tokens():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from calltrace.llm.tokens import Encoder

    texts = ["a<|endoftext|>b c", "plain text", None, "", "<|endof", "text|> x", " <|endoftext|> <|endoftext|>", "x <|endoftext|", "again plain text"]
    model, encoder = Tokenizer.from_file(path("byte_bpe_50k.json")), Encoder("byte_bpe_50k.json")
    for _ in range(2):
        ids, ends = encoder.encode(pa.array(texts))
        assert [p.tolist() for p in np.split(ids, ends[:-1])] == [model.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert 50256 in ids


def test_toxicity(spark, corpus, empty):
    bad = ["vilexx", "nastyqq", "horridzz"]
    rows, labels = [], []
    for i in range(900):
        w = words(corpus[i % 300][1])[:60]
        y = i % 5 == 0
        if y:
            w.insert(len(w) // 2, bad[i % 3])
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(y)))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame([*labels, (5000, 1, 1), (5001, 1, None)], "doc_id long, quality long, toxic long")
    model = toxicity.train(d.where("doc_id < 600"), lab.where("doc_id < 600"))
    got = {r.doc_id: r.score for r in toxicity.score_documents(d, model).collect()}
    y = np.array([i % 5 == 0 for i in range(600, 900)])
    s = np.array([got[i] for i in range(600, 900)])
    assert ((s >= 0.7) == y).mean() > 0.97 and 0 <= s.min() and s.max() <= 1
    assert toxicity.score_documents(empty, model).count() == 0
    none = toxicity.train(d, lab.where("toxic = 0"))
    assert none.net is None and toxicity.score_documents(d, none).where("score <> 0").count() == 0
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "word " * 30000, "en")], "doc_id long, text string, lang string")
    assert toxicity.score_documents(odd, model).count() == 3
    clash = d.limit(20).withColumns({"score": F.lit("given"), "_tox_text": F.lit(1), "y": F.lit(2), "_h": F.lit(3)})
    assert {(r.score, r._tox_text, 0 <= r.score_ <= 1) for r in toxicity.score_documents(clash, model).collect()} == {("given", 1, True)}
    assert toxicity.without_toxic(clash, model).columns == clash.columns
    again = toxicity.train(d.where("doc_id < 600").repartition(5), lab.where("doc_id < 600").repartition(3))
    assert {r.doc_id: r.score for r in toxicity.score_documents(d, again).collect()} == got


def test_toxicity_learns_from_long_texts(spark):
    """Every training text is long, and what makes it toxic lies anywhere in it; rows are repeated."""
    rnd = random.Random(8)
    rows = []
    for i in range(300):
        w = [f"w{rnd.randrange(3000)}" for _ in range(3000)]
        if i % 3 == 0:
            w[rnd.randrange(3000)] = rnd.choice(["vilexx", "nastyqq"])
        rows.append((i, " ".join(w), "en"))
    d = spark.createDataFrame([*rows, *rows[:40]], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] * 2, "doc_id long, toxic long")
    got = toxicity.score_documents(d.where("doc_id >= 200"), toxicity.train(d, lab)).collect()
    assert np.mean([(r.score >= 0.7) == (r.doc_id % 3 == 0) for r in got]) > 0.95


def plain_score(net, text):
    """The network word by word, without blocks."""
    words = Words(pa.array([text], pa.string()))
    x = [sum(net.emb[b] for b in row) for row in toxicity.features(words)]
    top = []
    for w, bank in net.filters.items():
        for k in range(bank.shape[2]):
            all_ = [sum(float(x[i + j] @ bank[j, :, k]) for j in range(w)) + float(net.bias[w][k]) for i in range(len(x) - w + 1)]
            top.append(max([0.0, *all_]))
    z = (float(np.array(top) @ net.out) + float(net.base)) * net.scale + net.shift
    return 1 / (1 + np.exp(-z))


def test_toxicity_against_plain_network(spark, corpus):
    """Scores of whole texts in blocks, empty and short ones among them, are those of the network applied to each text alone."""
    net = toxicity.TextCnn(3)
    rng = np.random.default_rng(5)
    net.emb = rng.normal(0, 0.3, net.emb.shape).astype(np.float32)
    net.bias = {w: rng.normal(0, 0.3, len(b)).astype(np.float32) for w, b in net.bias.items()}
    net.scale, net.shift = 0.7, 0.2
    rows = [(r[0], r[1]) for r in corpus if len(words(r[1])) < 200] + [(2000, "one"), (2001, "Two, WORDS!"), (2002, "a b c"), (None, "no id")]
    model = toxicity.Model(net, {None: 0.7}, 0.5)
    got = collections.defaultdict(list)
    for r in toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model).collect():
        got[r.doc_id].append(r.score)
    assert all(np.allclose(got[d], plain_score(net, t or ""), atol=1e-4) for d, t in rows)


def test_toxicity_pieces(monkeypatch):
    """A long text's score is that of its whole."""
    words = Words(pa.array([" ".join(f"w{i * 7919 % 1000}" for i in range(5000))]))
    net = toxicity.TextCnn()
    net.emb = np.random.default_rng(1).normal(0, 1, net.emb.shape).astype(np.float32)
    feats = toxicity.features(words)
    whole = net.score(feats, words.first)
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 64)
    assert np.allclose(net.score(feats, words.first), whole, atol=1e-5)


def test_hashes_in_pieces(monkeypatch):
    """Bounds and hashes don't depend on the pieces in which bytes are read."""
    import calltrace.llm.text as text

    rnd = random.Random(4)
    column = pa.array(["".join(rnd.choice("ab \n\u00e9") for _ in range(rnd.randrange(0, 400))) for _ in range(50)] + [None, "", "x" * 1000])
    one = Words(column)
    want = (one.start.tolist(), one.end.tolist(), one.first.tolist(), one.hashes().tolist())
    monkeypatch.setattr(text, "PIECE", 16)
    two = Words(column)
    assert (two.start.tolist(), two.end.tolist(), two.first.tolist(), two.hashes().tolist()) == want


# --- 9 -------------------------------------------------------------------------------------------------------------------
def test_pii_base():
    text = "a@b.c@d.e x.y+z@mail-1.example.com, @b.c@d.e 1.2.3.4.5.6.7.8, 999.1.1.1, 4111 1111-1111 1111, 4111111111111112, +1 (487) 555-7209 +12 007"
    got = [(k, text[s:e]) for k, s, e in pii.base_spans(text)]
    assert got == [("email", "a@b.c"), ("email", "x.y+z@mail-1.example.com"), ("email", "b.c@d.e"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (487) 555-7209")]
    assert pii.base_spans("9" * 100_000) == [] and pii.base_spans("a" * 100_000) == []


def contract_spans(text):
    """The contract's expressions as they stand."""
    digits = lambda t: [int(c) for c in t if c.isdigit()]

    def luhn(d):
        return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0

    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 16 <= len(digits(t)) <= 19 and luhn(digits(t))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 8 <= len(digits(t)) <= 15),
    )
    return [(kind, *m.span()) for kind, rule, good in rules for m in re.finditer(rule, text) if good(m.group())]


def test_pii_base_matches_the_contract():
    rnd = random.Random(6)
    for alphabet in ("a1.@ ", "0123456789. -", "+0123456789 ().-", "a@b.c-_ %", "1.2é@\n+("):
        for _ in range(1500):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 60)))
            assert pii.base_spans(text) == contract_spans(text), text
    for _ in range(500):
        d = [rnd.randrange(10) for _ in range(rnd.randrange(15, 19))]
        number = "".join(map(str, d)) + str(-sum(x if k % 2 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10)
        text = f"x {''.join(c + rnd.choice(['', '', ' ', '-']) for c in number)}y {rnd.randrange(300)}.{rnd.randrange(300)}.1.1 +{number[:9]}"
        assert pii.base_spans(text) == contract_spans(text)


def test_pii_odd_texts():
    """Long runs neither fail nor take quadratic time; long context words are told apart by their whole."""
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)] and pii.base_spans("1" * 5000 + ".1.1.1") == []
    for text in ("(" * 300_000 + "@", "a@b.cc," * 30_000, " " * 300_000 + "1@" + "x" * 300_000, "9 " * 100_000, "+1" * 100_000):
        base = pii.base_spans(text)
        spans = [x[1:] for x in base] + list(pii.candidate_spans(text, base))
        assert len(pii.contexts(text, spans)) == len(spans)
    one, two = (pii.contexts(f"{'w' * 100}{c} a@b.cc", [(102, 108)])[0][0] for c in "xy")
    assert one != two and len(one) == 33
    assert pii.contexts("to a@b.cc c@d.ee on", [(3, 9), (10, 16)]) == [("to", ""), ("", "on")]


def test_pii_rows(spark):
    """Null and repeated ids: each input row gives one row."""
    rows = [(None, "x@y.zz"), (None, "p@q.rrr"), (1, "a@b.cc"), (1, "a@b.cc"), (1, "other 1.2.3.4"), (2, None)]
    got = sorted((r.doc_id or 0, [tuple(s)[1:] for s in r.spans]) for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, [(0, 6, "email")]), (0, [(0, 7, "email")]), (1, [(0, 6, "email")]), (1, [(0, 6, "email")]), (1, [(6, 13, "ip")]), (2, [])]


def test_pii_bootstraps(spark, empty):
    rows = [(i, f"word{i} phone: +1 (487) 555-{7000 + i} thanks") for i in range(10)] + [(20, "my phone: 030 123 4567 thanks"), (21, "order 030 123 4567 boxes"), (22, None), (23, "")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 14 and [(s.kind, s.start, s.end) for s in got[20].spans] == [("phone", 10, 22)] and not got[20].base
    assert not got[21].spans and not got[22].spans and [s.kind for s in got[3].base] == ["phone"]
    assert pii.find_personal_data(empty).count() == 0


# --- 10 ------------------------------------------------------------------------------------------------------------------
def test_pii_later_rounds(spark):
    """Identifiers known from one context make their other context confident, which gives one that no seed's context extracts."""
    rows = [(50 + i, f"x mail person{i}@site.org {'y' * i}z") for i in range(30)]
    rows += [(20 + i, f"x mail u{i}@host z{chr(97 + i)}") for i in range(6)]
    rows += [(30 + i, f"x write U{i}@host v{chr(97 + i)}") for i in range(6)]
    rows += [(40, "x write last9@host w"), (41, "elsewhere last9@host again"), (42, "never other9@host here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [{r.doc_id: r.spans for r in pii.find_personal_data(docs, rounds=n).collect()} for n in (1, 2, 3)]
    assert all(got[0][20 + i] and not got[0][30 + i] for i in range(6)) and not got[0][40]
    for later in got[1:]:
        assert all(later[30 + i] for i in range(6)) and [tuple(x) for x in later[40]] == [(1, 8, 18, "email")] and not later[41] and not later[42]


def bootstrapped(texts, rounds, support=5, confidence=0.8):
    """The method as it is stated, over all texts at once."""
    found = [(i, *f) for i, t in enumerate(texts) for f in pii.found_in(t or "")]
    all_, known, good = collections.defaultdict(set), {(x[6], x[1]) for x in found if x[1] and x[1] in x[5].split(",")}, set()
    for _, _, _, _, met, _, key in found:
        for p in met:
            all_[p].add(key)
    for _ in range(rounds):
        held = collections.defaultdict(set)
        for _, kind, _, _, met, could, key in found:
            for p in met:
                for k in [kind] if kind else [k for k in pii.KINDS if could and (key, k) in known and p[0] != "form"]:
                    held[p, k].add(key)
        good = {(p, k) for (p, k), v in held.items() if len(v) >= support and len(v) >= confidence * len(all_[p])}
        known |= {(x[6], k) for x in found if not x[1] for p in x[4] for k in pii.KINDS if (p, k) in good and k in x[5].split(",")}
    out = collections.defaultdict(set)
    for i, kind, s, e, met, could, _ in found:
        kinds = [kind] if kind else [k for k in pii.KINDS if any((p, k) in good for p in met) and k in could.split(",")]
        if kinds:
            out[i].add((kinds[0], s, e))
    return out


def test_pii_against_brute_force(spark):
    """Numbers side by side, broken phones, contexts of one and two words with punctuation, copies that count once."""
    rnd = random.Random(12)

    def card():
        d = [rnd.randrange(10) for _ in range(15)]
        return "".join(map(str, d)) + str(-sum(x if k % 2 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10)

    def phone(gap=" "):
        return f"+1{gap}({rnd.randrange(200, 999)}){gap}555-{rnd.randrange(1000, 9999)}"

    w = lambda: rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split())
    texts = []
    for i in range(150):
        kind = i % 10
        body = {0: card(), 1: f"{card()} {card()}" if i % 50 == 1 else card(), 2: phone(), 3: phone("\n") if i % 20 == 3 else phone(), 4: f"u{i}@mail.org", 5: f"Call me: {phone()}", 6: f"call, me 030 {1000 + i} 99" if i % 50 == 6 else f"Call me {phone()}", 7: f"order {rnd.randrange(10**15, 10**16)}", 8: f"{card()[:4]}", 9: "v 2.0"}[kind]
        texts.append(f"{w()} {w()}! {body} {w()}, {w()}.")
    texts += ["copied word: 4111 222 3334 end"] * 9 + [None, ""]
    planted = {i for i, t in enumerate(texts) if t and (i % 50 in (1, 6) or i % 20 == 3) and i < 150}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for rounds in (1, 3):
        got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans} for r in pii.find_personal_data(docs, rounds=rounds).collect()}
        want = bootstrapped(texts, rounds)
        assert got == {i: want[i] for i in range(len(texts))}
    added = {i for i, t in enumerate(texts) if len(got[i]) > len(pii.base_spans(t or ""))}
    assert added == planted


def test_token_counts(spark, docs, corpus, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path("byte_bpe_50k.json"))
    n_tokens = {r[0]: len(model.encode(r[1] or "", add_special_tokens=False).ids) for r in corpus}
    rollup = token_counts.TokenRollup(spark, new_path(spark, "t"))
    read = lambda: {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert not read() and not rollup.compact()
    n = token_counts.count_tokens(docs.select("doc_id", "source", "lang", "text")).withColumn("tokenizer", F.lit("v1"))
    assert {r.doc_id: r.n_tokens for r in n.collect()} == n_tokens
    assert rollup.commit("a", token_counts.inserts(n)) and not rollup.commit("a", token_counts.inserts(n))

    def want(version, rows):
        out = collections.defaultdict(lambda: (0, 0))
        for r in rows:
            d, t = out[r[3], r[2], version]
            out[r[3], r[2], version] = d + 1, t + n_tokens[r[0]]
        return dict(out)

    odd = [r for r in corpus if r[0] % 2]
    assert read() == want("v1", corpus)
    assert rollup.commit("b", token_counts.deletes(n.where("doc_id % 2 = 0"))) and read() == want("v1", odd)
    moved = n.where("doc_id % 2 = 1").withColumns({"old_tokens": F.col("n_tokens"), "old_tokenizer": F.lit("v1"), "tokenizer": F.lit("v2")})
    assert rollup.commit("c", token_counts.revisions(moved)) and read() == want("v2", odd)
    for _ in range(3):  # folding again changes nothing
        rollup.compact()
        assert read() == want("v2", odd) and len(rollup.live(rollup.entries())) == 1
    assert not rollup.commit("a", token_counts.inserts(n)) and not rollup.commit("c", token_counts.revisions(moved)) and read() == want("v2", odd)
    rollup.clean()
    assert read() == want("v2", odd)
    again = token_counts.inserts(n.where("doc_id % 2 = 1").withColumn("tokenizer", F.lit("v2")))
    assert rollup.commit("d", again) and rollup.commit("e", token_counts.deletes(n.where("doc_id % 2 = 1").withColumn("tokenizer", F.lit("v2"))))
    assert rollup.compact() and read() == want("v2", odd)
    assert token_counts.count_tokens(empty).count() == 0
    clash = token_counts.count_tokens(docs.select("text", F.lit("given").alias("n_tokens")))
    assert clash.columns == ["n_tokens", "n_tokens_"]


def test_token_counts_writers(spark):
    """Writers that meet: one of two commits of an id holds, a compaction that comes second is given up, what a lost one leaves is not read."""
    row = lambda n: spark.createDataFrame([("s", "en", "v", 1, n)], "source string, lang string, tokenizer string, d_docs long, d_tokens long")
    rollup = token_counts.TokenRollup(spark, new_path(spark, "t"))
    total = lambda: [(r.n_docs, r.n_tokens) for r in rollup.totals().collect()]
    rollup.commit("a", row(1))
    lost = rollup._write(row(50))  # written, but its writer was lost before the log entry
    assert total() == [(1, 1)]
    assert rollup._publish(lost, "b", []) and not rollup._publish(rollup._write(row(70)), "b", []) and total() == [(2, 51)]
    old = rollup.live(rollup.entries())
    folded = [rollup._write(rollup._read(old).groupBy(*token_counts.KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))) for _ in range(2)]
    rollup.commit("c", row(3))  # between a compaction's reading and its entry
    assert rollup._publish(folded[0], None, old) and not rollup._publish(folded[1], None, old) and total() == [(3, 54)]
    assert not rollup._append({"number": 1, "batch": "z", "delta": lost, "replaces": []}) and total() == [(3, 54)]


# --- pipeline ------------------------------------------------------------------------------------------------------------
def test_pipeline(spark, corpus, docs, empty, tmp_path):
    """What each stage keeps, against brute force on what the one before it kept; all decisions meet in the token output."""
    import corpus_pipeline
    from public_tokenizers import path
    from tokenizers import Tokenizer

    d, rnd = str(tmp_path), random.Random(21)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    clean = [list(r[:5]) for r in corpus]
    bad = ["vilexx", "nastyqq", "horridzz"]
    toxic = []
    for i in range(1000, 1400):  # most rows are of one source
        w = [rnd.choice(["plain", "words", "that", "mean", "no", "harm", f"u{rnd.randrange(500)}"]) for _ in range(40)]
        if i % 4 == 0:
            w[rnd.randrange(40)] = bad[i % 3]
            toxic.append(i)
        clean.append([i, " ".join([*w, f"end{i}", f"last{i}"]), "en", "hot", 0])
    item = " ".join(f"bench{i} mark{i}" for i in range(15))
    near = [f"copy{i}" for i in range(150)]
    for i in range(12):
        clean.append([2000 + i, " ".join(near[: 5 * i] + [f"new{i}"] + near[5 * i + 1 :]), "en", "hot", 0])
    clean += [[3000, f"some words before {item} and after", "en", "s1", 0], [3001, "start " + " ".join(w for k, w in enumerate(item.split()) if k % 7) + " end", "fr", "s2", 0]]
    spark.createDataFrame([tuple(r) for r in clean], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(1000, 1300)], "doc_id long, quality long, toxic long").write.parquet(f"{d}/labels.parquet")

    at, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, d)
        assert k == 4 or out.columns == names
        out.write.parquet(f"{d}/stage{k}")
        at = spark.read.parquet(f"{d}/stage{k}")
        kept[name] = at.collect()
    ids = lambda name: {r.doc_id for r in kept[name]}
    # toxicity: all that holds a toxic word goes, labelled or not, and nothing else
    assert ids("toxicity") == {r[0] for r in clean} - set(toxic)
    # near duplicates: one of each class, by all pairs
    classes = brute_classes([(r.doc_id, r.text) for r in kept["toxicity"]])
    assert ids("ngram_jaccard_join") == {i for i, v in classes.items() if v[0] == i} and len(kept["ngram_jaccard_join"]) < len(kept["toxicity"]) - 11
    # decontamination: both texts with the item
    assert ids("decontamination") == ids("ngram_jaccard_join") - {3000, 3001}
    # mixing: words by source near their targets, no document more than twice, each a whole row of before
    size = collections.Counter()
    for r in kept["decontamination"]:
        size[r.source] += len(words(r.text))
    want, took = mixing.targets(size), collections.Counter()
    for r in kept["mixing"]:
        took[r.source] += len(words(r.text))
    longest = max(len(words(r.text)) for r in kept["decontamination"])
    assert all(abs(took[s] - want[s]) <= longest for s in want) and set(kept["mixing"]) <= set(kept["decontamination"])
    assert max(collections.Counter(r.doc_id for r in kept["mixing"]).values()) == 2
    # token output: each row's ids, end to end
    model = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ends = collections.Counter((r.doc_id, len(model.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in kept["mixing"])
    assert collections.Counter((r.doc_id, r.n_tokens) for r in kept["token_output"]) == ends
    rows = sorted(kept["token_output"], key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()] and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, d).collect()) == sorted(tuple(r) for r in rows)
    got = empty.drop("id", "tid")
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, got, d)
    assert got.count() == 0


def test_pieces_are_learned_without_offsets_and_give_the_model_s_ids():
    """White space of any kind at a piece's ends, and no character offsets, which cost as much as the ids."""
    import pyarrow as pa
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from calltrace.llm.tokens import Encoder

    rnd, model, encoder = random.Random(8), Tokenizer.from_file(path("byte_bpe_50k.json")), Encoder("byte_bpe_50k.json")

    class NoOffsets:
        def __init__(self, inner):
            self.encode_batch_fast = inner.encode_batch_fast

    encoder.plain = NoOffsets(encoder.plain)
    parts = [" ", "  ", " ", "\u0085", " ", " ", " ", " ", "　", "\x1c", "\n", "\t", "é", "©", "ß", "€", "日", "x", "Word", "12", "!?", " an", "Ġ", "'s"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(12))) for _ in range(4000)]
    ids, ends = encoder.encode(pa.array(texts))
    want = [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and np.diff(ends, prepend=0).tolist() == list(map(len, want))
