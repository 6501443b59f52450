"""N-gram Jaccard join with Bayesian candidate pruning.

The similarity of two texts is the Jaccard index of their sets of ``n`` consecutive words (words ``[^\\x20\\x09-\\x0D]+``; a
text of fewer words is one n-gram). Links are pairs of at least ``threshold``.

1. Documents with the same words are one text; from here on only one representative of each text is compared.
2. MinHash signatures of ``HASHES`` values are cut into bands. Texts that share a band are candidates; a star to each
   band's smallest text makes edges, whose connected components (groups) hold every candidate pair.
3. Each group is dealt into blocks of bounded size, and each pair of blocks meets in one task, so no pairs are made as rows
   and no task holds a whole group. There all pairs compare their MinHash values ``STEP`` at a time and are dropped when
   the posterior probability that their similarity reaches the threshold (uniform prior) falls below ``TOLERANCE``; the
   rest are verified exactly on their n-gram sets.
4. Classes are the connected components of the verified links.

A pair just at the threshold misses all bands with a probability of about 6e-5 and is then still found through any
text in between; pruning drops it with about 1e-5. Null and empty texts have no n-grams: each is alone, with no links.
Rows without an id are alone. Rows repeated with one id and text are copies of each other.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltrace.functions.work import materialize, release
from calltrace.llm.text import Words, blocks, bounded_batches, mix, powers, ranges, runs, spans_hash
from calltrace.operators.components import connected_components

BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
#: Texts of a block, and texts that small groups are gathered to for one task.
BLOCK, BIN = 384, 1500

#: Up to so many members (about 40 MB) their ids go to every executor and no text moves; beyond, texts and ids meet in a shuffle.
BROADCAST_ROWS = 1_000_000

_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 31, HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-gram hashes of a block's texts end to end, and where each text's begin, with the end last."""
    h = words.hashes()
    size = np.diff(words.first)
    grams = runs(h, n)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(first[-1], np.uint64)
    long = size >= n
    at = ranges(first[:-1][long], count[long])
    out[at] = grams[ranges(words.first[:-1][long], count[long])]
    short = np.flatnonzero((size > 0) & ~long)
    out[first[:-1][short]] = spans_hash(h, words.first[short], words.first[short + 1])
    return out, first


def signatures(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash signatures of texts that have n-grams: (texts, HASHES) uint32."""
    h = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((HASHES, len(first) - 1), np.uint32)
    v = np.empty_like(h)
    for i in range(HASHES):
        np.multiply(h, _A[i], out=v)
        v += _B[i]
        v ^= v >> np.uint32(15)
        np.minimum.reduceat(v, first[:-1], out=out[i])
    return np.ascontiguousarray(out.T)


def _sign(n: int):
    def run(batches):
        for block in blocks(batches):
            words = Words(block.column("text"))
            grams, first = ngrams(words, n)
            some = np.flatnonzero(np.diff(first) > 0)
            if not len(some):
                continue
            sig = signatures(grams, np.append(first[some], first[-1])).astype(np.uint64)
            up, _ = powers(1, ROWS + 1)
            keys = np.zeros((len(some), BANDS), np.uint64)
            for r in range(ROWS):
                keys += sig[:, r::ROWS] * up[r + 1]
            keys = mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
            h = words.hashes()
            whole = [spans_hash(h, words.first[some], words.first[some + 1], k).view(np.int64) for k in (0, 1)]
            take = pa.array(some)
            yield pa.RecordBatch.from_arrays(
                [block.column("id").take(take), block.column("tid").take(take), pa.array(whole[0]), pa.array(whole[1]), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))],
                names=["id", "tid", "t1", "t2", "bands"],
            )

    return run


def _sets(n: int):
    """Signature and sorted n-gram set of each text, as bytes."""

    def run(batches):
        for block in blocks(batches):
            words = Words(block.column("text"))
            grams, first = ngrams(words, n)
            sig = signatures(grams, first)
            sets = [np.unique(grams[a:b]).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            names = ["id", "tid", "copies", "group", "blk", "n_blk"]
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in names), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(sets, pa.binary())], names=[*names, "sig", "grams"])

    return run


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """By number of hashes compared (0, STEP, 2 STEP, ...): the fewest matches at which a pair is kept.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    out = [0]
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while (total := total + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        out.append(m)
    return out


def linked(sig: np.ndarray, sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that reach the threshold: pruned by their posterior, then verified."""
    match = np.zeros(len(i), np.int32)
    for k in range(1, len(least)):
        c = slice((k - 1) * STEP, k * STEP)
        match += (sig[i, c] == sig[j, c]).sum(axis=1, dtype=np.int32)
        live = match >= least[k]
        i, j, match = i[live], j[live], match[live]
        if not len(i):
            return i, j
    size = np.array([len(s) for s in sets])
    if len(i) > 64 * len(sets) ** 0.5:  # many pairs of few texts: count common n-grams by products of incidence columns
        _, col = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(col[-1]) + 1, 4096):
            a, b = np.searchsorted(col, [lo, lo + 4096])
            x = np.zeros((len(sets), 4096), np.float32)
            x[row[a:b], col[a:b] - lo] = 1
            common += x @ x.T
        both = common[i, j]
    else:
        both = np.empty(len(i), np.float64)
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            s, t = (sets[a], sets[b]) if size[a] < size[b] else (sets[b], sets[a])
            at = np.searchsorted(t, s)
            both[k] = (t[np.minimum(at, len(t) - 1)] == s).sum()
    good = both >= threshold * (size[i] + size[j] - both) - 1e-6
    return i[good], j[good]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(threshold: float):
    least = least_matches(threshold)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("group", "ascending"), ("id", "ascending"), ("tid", "ascending")]).combine_chunks()
        group, blk = table.column("group").to_numpy(), table.column("blk").to_numpy()
        copies = table.column("copies").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        sets = [np.frombuffer(b, np.uint64) for b in table.column("grams").to_pylist()]
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        n = len(sets)
        links, link_docs, root = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
        cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            if low < high:
                one, two = np.flatnonzero(blk[a:b] == low), np.flatnonzero(blk[a:b] == high)
                i, j = np.repeat(one, len(two)), np.tile(two, len(one))
            else:
                i, j = np.triu_indices(b - a, 1)
            i, j = linked(sig[a:b], sets[a:b], i, j, threshold, least)
            if not len(i):
                continue
            links[a:b] += np.bincount(i, minlength=b - a) + np.bincount(j, minlength=b - a)
            link_docs[a:b] += (np.bincount(i, copies[a + j], b - a) + np.bincount(j, copies[a + i], b - a)).astype(np.int64)
            root[a:b] = a + _roots(b - a, i, j)
        out = table.select(["id", "tid"])
        take = pa.array(root)
        for name, col in (("links", pa.array(links)), ("link_docs", pa.array(link_docs)), ("root_id", out.column("id").take(take)), ("root_tid", out.column("tid").take(take))):
            out = out.append_column(name, col)
        return out

    return run


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, tid, class_id, text_id, n_copies, n_links, n_link_docs)`` for every row.

    ``text_id``: smallest id among the documents with the same words; ``n_copies``: their number; ``n_links``: other texts
    at least ``threshold`` similar; ``n_link_docs``: documents with those texts; ``class_id``: smallest id of the class;
    ``tid``: xxhash64 of the text.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("tid"), F.col(text).alias("text"))
    signed = materialize(rows.where("id IS NOT NULL").mapInArrow(_sign(n), "id long, tid long, t1 long, t2 long, bands array<long>"), "signed")
    node = F.struct("id", "tid")
    texts = materialize(signed.groupBy("t1", "t2").agg(F.min(node).alias("node"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "texts")
    bands = texts.select("node", F.explode("bands").alias("band"))
    shared = materialize(bands.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("m")).where("m > 1").drop("m"), "bands-shared")
    stars = bands.join(shared, "band").where("node <> pivot").groupBy("node").agg(F.collect_set("pivot").alias("pivots"))  # at most BANDS
    # a text needs one edge, to its smallest pivot; its other pivots are tied to that one, mostly alike for all texts of a group
    low = F.array_min("pivots").alias("dst")
    edges = stars.select(F.col("node").alias("src"), low).unionByName(stars.select(F.explode("pivots").alias("src"), low).where("src <> dst").distinct())
    groups = connected_components(edges)
    size = groups.groupBy("component").agg(F.count("*").alias("m"))
    size = materialize(size.select("component", F.ceil(F.col("m") / BLOCK).cast("int").alias("n_blk")), "group-sizes")
    members = groups.join(size, "component").join(texts.select("node", "copies"), "node")
    members = materialize(
        members.select(
            F.col("node.id").alias("m_id"), F.col("node.tid").alias("m_tid"), "copies", F.xxhash64("component").alias("group"), "n_blk",
            F.pmod(F.xxhash64(F.lit(3), "node"), F.col("n_blk")).cast("int").alias("blk"),
        ),
        "members",
    )
    n_members = members.count()
    bins = max(1, n_members // BIN)
    held = rows.join(F.broadcast(members) if n_members <= BROADCAST_ROWS else members, (rows.id == members.m_id) & (rows.tid == members.m_tid)).select("id", "tid", "text", "copies", "group", "blk", "n_blk")
    sets = held.dropDuplicates(["id", "tid"]).mapInArrow(_sets(n), "id long, tid long, copies long, group long, blk int, n_blk int, sig binary, grams binary")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blk") - 1)).alias("o")
    sets = sets.select("*", other).withColumns({"low": F.least("blk", "o"), "high": F.greatest("blk", "o")})
    task = F.when(F.col("n_blk") == 1, F.pmod("group", F.lit(bins))).otherwise(F.col("group"))
    sets = sets.select("id", "tid", "copies", "group", "blk", "low", "high", "sig", "grams", task.alias("task"), (F.col("n_blk") > 1).alias("large"))
    found = materialize(
        sets.groupBy("large", "task", "low", "high").applyInArrow(_verify(threshold), "id long, tid long, links long, link_docs long, root_id long, root_tid long").where("links > 0"), "links"
    )
    counts = found.groupBy(node.alias("node")).agg(F.sum("links").alias("links"), F.sum("link_docs").alias("link_docs"))
    classes = connected_components(found.select(node.alias("src"), F.struct(F.col("root_id").alias("id"), F.col("root_tid").alias("tid")).alias("dst")))
    table = texts.drop("bands").join(counts, "node", "left").join(classes, "node", "left")
    table = materialize(
        table.select("t1", "t2", "copies", "links", "link_docs", F.col("node.id").alias("text_id"), F.coalesce(F.col("component.id"), F.col("node.id")).alias("class_id")), "classes"
    )
    release(texts, shared, size, members, found, groups, classes)
    out = signed.select("id", "tid", "t1", "t2").join(table, ["t1", "t2"])
    zero = F.lit(0).cast("long")
    out = out.select(F.col("id").alias("doc_id"), "tid", "class_id", "text_id", F.col("copies").alias("n_copies"), F.coalesce("links", zero).alias("n_links"), F.coalesce("link_docs", zero).alias("n_link_docs"))
    bare = rows.where((F.col("id").isNull()) | ~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))
    return out.unionByName(bare.select(F.col("id").alias("doc_id"), "tid", F.col("id").alias("class_id"), F.col("id").alias("text_id"), F.lit(1).cast("long").alias("n_copies"), zero.alias("n_links"), zero.alias("n_link_docs")))


def one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the document with the smallest id stays (once)."""
    keep = materialize(jaccard_classes(docs, **options).where("doc_id IS NULL OR doc_id = class_id").select(F.col("doc_id").alias("_nj_id"), F.col("tid").alias("_nj_tid")).distinct(), "one-each")
    keyed = docs.withColumn("_nj_tid", F.xxhash64("text"))
    out = keyed.join(keep, keyed.doc_id.cast("long").eqNullSafe(keep._nj_id) & (keyed._nj_tid == keep._nj_tid), "left_semi")
    return out.dropDuplicates(["doc_id", "_nj_tid"]).select(*docs.columns)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "class_id", "text_id", "n_copies", "n_links", "n_link_docs")
