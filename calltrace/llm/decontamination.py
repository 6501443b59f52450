"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of at most ``ITEM_WORDS`` words by Spark, and ``PASSAGES`` passages at a time meet all documents;
documents are read whole in overlapping windows of ``WINDOW`` words, so that every stretch of ``WINDOW - STRIDE`` words lies in one.

1. Document frequencies of the items' terms are counted over all windows of all documents.
2. A randomised SVD of the TF-IDF matrix: each task adds every window's row, with a random sign, to one of ``SKETCH``
   random sums (a sparse random projection of the rows); the summed sketch, of fixed size, together with the items' own rows
   is decomposed, and its ``RANK`` leading right singular vectors span the latent space.
3. Every window is projected and compared with all item passages; those with a cosine of at least ``COSINE`` are candidates.
   Beside them, by exact sums over the terms that both hold, so are windows that share ``CUE`` of a passage's weight, or less
   where its words without weight could make up for the rest; what the rank cuts off is found by these.
4. A candidate is verified on its words: the longest common subsequence with a stretch of the window of about the passage's
   length. At ``COPY`` of the passage's words it is a copy. From ``PARAPHRASE`` on it is a paraphrase if ``ANSWER`` of the
   words of the column ``answer`` are there too, or, where an item has no answer, words that hold ``PARAPHRASE`` of the passage's
   weight: the sum over its distinct words of their inverse document frequency.

Words are compared in lower case without outer punctuation. Terms in more than ``STOP`` of the windows, and in more than ``RARE``, carry no weight,
except the rarest of each passage. Null and empty texts and items match nothing, nor do items without an id; rows repeated with one id
are read one by one and give equal rows once, and an item id may stand for several texts. An answer is a few words. What grows with the
corpus stays in Spark; only a block's passages, their term counts and the sketch reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltrace.functions.work import materialize, release
from calltrace.llm.text import Words, blocks, bounded_batches, mix, plain_hashes, ranges

ITEM_WORDS, WINDOW, STRIDE = 40, 64, 24
SKETCH, RANK = 192, 96
COSINE, COPY, PARAPHRASE, ANSWER = 0.5, 0.8, 0.5, 0.8
STOP, RARE = 0.02, 20
PASSAGES = 1200
#: Share of a passage's weight that makes a window a candidate whatever the cosine.
CUE = 0.25
KEY_TERMS = 4


def _passages(batches):
    """``(item_id, t, k, words, answer)``: an item's passages in order, their words and those of the answer as hashes."""
    for batch in batches:
        rows = []
        for item_id, t, text, answer in zip(*(batch.column(c).to_pylist() for c in ("item_id", "t", "text", "a")), strict=True):
            w = plain_hashes(Words(pa.array([text], pa.string())))
            a = plain_hashes(Words(pa.array([answer], pa.string()))).view(np.int64) if answer else None
            rows += [(item_id, t, k, part.view(np.int64), a) for k, part in enumerate(np.array_split(w, max(1, -(-len(w) // ITEM_WORDS)))) if len(part)]
        if rows:
            types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["item_id", "t", "k", "words", "answer"])


def passage_table(benchmark: DataFrame) -> DataFrame:
    """Passages of a benchmark ``(item_id, text)`` and, if there, ``answer``; rows repeated whole count once."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    given = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", F.coalesce(answer, F.lit("")).alias("a")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    rows = given.withColumn("t", F.xxhash64("text", "a")).mapInArrow(_passages, "item_id long, t long, k int, words array<long>, answer array<long>")
    return materialize(rows, "benchmark-passages")


@dataclass
class Passages:
    """The passages of one block, and the sorted term hashes they use."""

    item: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray | None]
    terms: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Passages:
        words = [np.array(r.words, np.int64).view(np.uint64) for r in rows]
        answers = [None if r.answer is None else np.array(r.answer, np.int64).view(np.uint64) for r in rows]
        return cls([r.item_id for r in rows], words, answers, np.unique(np.concatenate(words)))


class Finder:
    """Term hits of a block of texts, by window."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(terms >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and term numbers of the words that are terms."""
        at = np.flatnonzero(self.gate[(h >> np.uint64(48)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        good = self.terms[term] == h[at]
        return at[good], term[good]


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of each window."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    start = first[doc] + STRIDE * ranges(np.zeros(len(n), np.int64), count)
    return doc, start, np.minimum(start + WINDOW, first[doc + 1])


def _window_hits(words: Words, finder: Finder):
    """``(h, doc, start, end, row, term)``: windows, and each hit's window and term, a term once a window."""
    h = plain_hashes(words)
    doc, start, end = windows(words.first)
    at, term = finder.hits(h)
    a, b = np.searchsorted(at, start), np.searchsorted(at, end)
    row = np.repeat(np.arange(len(start)), b - a)
    pair = np.unique(row * np.int64(len(finder.terms)) + term[ranges(a, b - a)])
    return h, doc, start, end, pair // len(finder.terms), pair % len(finder.terms)


def _document_frequencies(terms):
    def run(batches):
        finder, df, n = Finder(terms.value), np.zeros(len(terms.value), np.int64), 0
        for block in blocks(batches):
            _, _, start, _, _, term = _window_hits(Words(block.column("text")), finder)
            df += np.bincount(term, minlength=len(df))
            n += len(start)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], names=["term", "n"])

    return run


def _weighted(row, term, weight, n):
    """Each hit's value in rows of length one."""
    value = weight[term]
    return value / np.sqrt(np.bincount(row, value * value, n))[row]


def _sketch(shared):
    def run(batches):
        terms, weight = shared.value
        finder = Finder(terms)
        out = np.zeros(SKETCH * len(terms))
        for block in blocks(batches):
            _, _, start, _, row, term = _window_hits(Words(block.column("text")), finder)
            if not len(row):
                continue
            value = _weighted(row, term, weight, len(start))
            # the window's random row and sign depend on its terms alone
            key = np.zeros(len(start), np.uint64)
            np.add.at(key, row, terms[term])
            key = mix(key)
            to = (key % np.uint64(SKETCH)).astype(np.int64)[row]
            sign = np.where((key >> np.uint64(60)) & np.uint64(1), 1.0, -1.0)[row]
            np.add.at(out, to * len(terms) + term, value * sign)
        for r, line in enumerate(out.reshape(SKETCH, -1).astype(np.float32)):
            if line.any():
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([line.tobytes()], pa.binary())], names=["r", "line"])

    return run


def _summed(batches):
    """Sums of the lines of each sketch row, one line held per row."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for r, line in zip(batch.column("r").to_pylist(), batch.column("line").to_pylist(), strict=True):
            x = np.frombuffer(line, np.float32)
            total[r] = total[r] + x if r in total else x.copy()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["r", "line"])


def lcs(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence; ``masks``: word to the bits of its places among ``n``."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _search(shared):
    def run(batches):
        terms, weight, basis, found, keys = shared.value
        keys = [(a.tolist(), w.tolist(), max(float(w.sum()), 1e-9), enough) for a, w, enough in keys]
        finder = Finder(terms)
        latent, least = found["latent"], found["least"]
        # passages of each term, and the weight that a window must share with each passage
        first, holders, cue = found["first"], found["holders"], found["cue"]
        project = (basis * weight[:, None]).astype(np.float32)
        items = found["words"]
        masks = []
        # a subsequence of a share of the passage's words holds at least so many of its distinct words
        need = [PARAPHRASE * len(w) - (len(w) - len(np.unique(w))) for w in items]
        for w in items:
            m: dict[int, int] = {}
            for k, x in enumerate(w.tolist()):
                m[x] = m.get(x, 0) | 1 << k
            masks.append(m)
        for block in blocks(batches):
            words = Words(block.column("text"))
            h, doc, start, end, row, term = _window_hits(words, finder)
            count = np.bincount(row, minlength=len(start))
            keep = np.flatnonzero((count >= least) | (np.bincount(row, weight[term], len(start)) >= cue.min()))
            out: dict[tuple[int, int], tuple] = {}
            if len(keep):
                slot = np.full(len(start), -1, np.int64)
                slot[keep] = np.arange(len(keep))
                used = slot[row] >= 0
                row, term = row[used], term[used]  # rows are in order
                cuts = np.searchsorted(row, keep)
                for lo in range(0, len(keep), 2048):
                    hi = min(lo + 2048, len(keep))
                    a, b = cuts[lo], cuts[hi] if hi < len(keep) else len(row)
                    e = np.add.reduceat(project[term[a:b]], cuts[lo:hi] - a, axis=0)
                    e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-9)
                    cos = e @ latent.T
                    some = first[term[a:b] + 1] - first[term[a:b]]
                    pair = np.repeat((np.cumsum(np.bincount(cuts[lo:hi] - a, minlength=b - a)) - 1) * len(items), some) + holders[ranges(first[term[a:b]], some)]
                    shared_weight = np.bincount(pair, np.repeat(weight[term[a:b]], some), (hi - lo) * len(items)).reshape(hi - lo, -1)
                    seen = -1
                    for x, p in zip(*(c.tolist() for c in np.nonzero((cos >= COSINE) | (shared_weight >= cue))), strict=True):
                        k = keep[lo + x]
                        if k != seen:
                            seen = k
                            a0, b0 = max(words.first[doc[k]], start[k] - 8), min(words.first[doc[k] + 1], end[k] + 8)
                            text = h[a0:b0].tolist()
                            here = set(text)
                        if len(here & masks[p].keys()) < need[p]:
                            continue
                        self_cos = float(cos[x, p])
                        n = len(items[p])
                        size, step = n + n // 2 + 2, max(1, n // 4)
                        best, where = 0, 0
                        for s in range(0, max(1, len(text) - size + step), step):
                            got = lcs(masks[p], n, text[s : s + size])
                            if got > best:
                                best, where = got, s
                        share = best / n
                        if share < PARAPHRASE:
                            continue
                        part = set(text[where : where + size])
                        answer, worth, whole, enough = keys[p]
                        told = sum(v for w, v in zip(answer, worth, strict=True) if w in part) / whole
                        if share >= COPY or told >= enough:
                            key = (int(doc[k]), int(p))
                            new = (share, self_cos, told, int(a0 + where - words.first[doc[k]]))
                            if key not in out or new > out[key]:
                                out[key] = new
            if out:
                take = pa.array([d for d, _ in out])
                names = ["share", "cosine", "told", "at"]
                cols = [pa.array(c, t) for c, t in zip(zip(*out.values(), strict=True), (pa.float64(), pa.float64(), pa.float64(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [block.column("id").take(take), block.column("tid").take(take), pa.array([found["item"][p] for _, p in out], pa.int64()), pa.array([p for _, p in out], pa.int64()), *cols],
                    names=["id", "tid", "item_id", "passage", *names],
                )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, tid, item_id, n_passages, lcs, cosine, answer, at, kind)``: pairs of a document and an item it holds.

    ``benchmark``: ``item_id``, ``text`` and, if there, ``answer``. ``lcs``: the best passage's share of words found in order;
    ``at``: first word of the stretch; ``kind``: copy or paraphrase; ``tid``: xxhash64 of the text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("tid"), F.col(text).alias("text"))
    given = passage_table(benchmark)
    schema = "id long, tid long, item_id long, passage long, share double, cosine double, told double, at int"
    found = None
    last, n_passages = None, 0
    while True:  # the stated query set against all rows, in blocks
        block = given
        if last is not None:  # rows are distinct in these three, which are the cursor
            i, t, k = (F.col(c) for c in ("item_id", "t", "k"))
            block = given.where((i > last.item_id) | ((i == last.item_id) & ((t > last.t) | ((t == last.t) & (k > last.k)))))
        taken = block.orderBy("item_id", "t", "k").limit(PASSAGES).collect()
        if not taken:
            break
        last = taken[-1]
        p = Passages.of(taken)
        shared = spark.sparkContext.broadcast(p.terms)
        counts = rows.mapInArrow(_document_frequencies(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        df = np.zeros(len(p.terms))
        total = 1.0
        for r in counts:  # one row a term of this block of items
            if r.term < 0:
                total = max(total, float(r.n))
            else:
                df[r.term] = r.n
        weight = np.log((total + 1) / (df + 1))
        numbers = [np.unique(np.searchsorted(p.terms, w)) for w in p.words]
        rare = [t[np.argsort(df[t], kind="stable")[:KEY_TERMS]] for t in numbers]
        active = df <= max(STOP * total, RARE)
        active[np.concatenate(rare)] = True
        # words that tell a paraphrase, what each is worth, and the share that is enough
        keys = [(a, np.ones(len(a)), ANSWER) if a is not None and len(a) else (p.terms[t], np.maximum(weight[t], 1e-3), PARAPHRASE) for a, t in zip(p.answers, numbers, strict=True)]
        terms, weight = p.terms[active], np.maximum(weight[active], 1e-3)
        whole = np.array([w.sum() for _, w, _ in keys])
        numbers = [np.flatnonzero(np.isin(terms, w)) for w in p.words]
        own = np.array([weight[t].sum() for t in numbers])
        # what a paraphrase must share, if it holds all words without weight; one term at least
        cue = np.minimum(CUE * own, [(PARAPHRASE * all_ - (all_ - mine)) if enough == PARAPHRASE else np.inf for all_, mine, (_, _, enough) in zip(whole, own, keys, strict=True)])
        cue = np.maximum(cue, [weight[t].min() for t in numbers]) * (1 - 1e-9)
        holders = np.repeat(np.arange(len(numbers)), [len(t) for t in numbers])
        flat = np.concatenate(numbers)
        order = np.argsort(flat, kind="stable")
        postings = {"first": np.searchsorted(flat[order], np.arange(len(terms) + 1)), "holders": holders[order], "cue": cue}
        q = np.zeros((len(p.words), len(terms)))
        for k, t in enumerate(numbers):
            q[k, t] = weight[t]
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((terms, weight))
        lines = rows.mapInArrow(_sketch(shared), "r int, line binary")
        # summed in two levels, so that no task reads a line of every other
        for keys_ in (["r", F.pmod(F.spark_partition_id(), F.lit(16))], ["r"]):
            lines = lines.repartition(*keys_).mapInArrow(_summed, "r int, line binary")
        lines = lines.collect()  # SKETCH rows
        sketch = np.stack([np.frombuffer(r.line, np.float32) for r in lines]) if lines else np.zeros((0, len(terms)), np.float32)
        scale = np.linalg.norm(sketch) / max(1.0, np.sqrt(len(sketch)))  # items weigh as much as the sketch's rows
        _, _, right = np.linalg.svd(np.vstack([sketch, q * max(scale, 1.0)]), full_matrices=False)
        basis = right[:RANK].T
        latent = q @ basis
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        least = max(1, min(int(np.ceil(PARAPHRASE * 0.8 * len(t))) for t in numbers))
        # everything here is bounded by PASSAGES, ITEM_WORDS and RANK
        shared = spark.sparkContext.broadcast((terms, weight, basis, {"latent": latent.astype(np.float32), "least": least, "words": p.words, "item": p.item, **postings}, keys))
        part = materialize(rows.mapInArrow(_search(shared), schema).withColumn("passage", F.col("passage") + n_passages), "contaminated")
        del q, right, basis, sketch, lines  # before the next block's are made
        n_passages += len(p.words)
        found = part if found is None else found.unionByName(part)
    release(given)
    if found is None:
        found = spark.createDataFrame([], schema)
    best = F.max(F.struct("share", "cosine", "told", "at"))
    out = found.groupBy("id", "tid", "item_id").agg(F.countDistinct("passage").alias("n_passages"), best.alias("b"))
    return out.select(
        F.col("id").alias("doc_id"), "tid", "item_id", "n_passages", F.col("b.share").alias("lcs"), F.col("b.cosine").alias("cosine"), F.col("b.told").alias("answer"), F.col("b.at").alias("at"),
        F.when(F.col("b.share") >= COPY, "copy").otherwise("paraphrase").alias("kind"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    hit = materialize(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_dc_id"), F.col("tid").alias("_dc_tid")).distinct(), "contaminated-docs")
    keyed = docs.withColumn("_dc_tid", F.xxhash64("text"))
    return keyed.join(hit, keyed.doc_id.cast("long").eqNullSafe(hit._dc_id) & (keyed._dc_tid == hit._dc_tid), "left_anti").select(*docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.drop("tid")
