"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of hashed embeddings of the word, of its beginnings (4, 6 and 8 bytes) and of its last 4 bytes,
so that it also knows parts of words. Filters of several widths slide over the words of the whole text; each filter's maximum (and so any length
of text) goes to a logistic unit. Training takes at most ``max_train`` labelled rows (a bounded, documented sample: those
with the lowest hash of the id, half of it toxic rows at most) and minimises the weighted logistic loss by Adam, each
step touching only the words that won a maximum. Embeddings start from smoothed log odds of the training rows.

The sample meets in one task, not in the driver, and passes through it twice: once for the log odds, which count every word,
once for the features, integers that lie in a file of the task's own while it trains. So all words of all sampled texts train, and memory
holds the texts of one step.

Scores are calibrated on a held-out fifth of the training rows. A threshold per language is chosen there as well: the one
with the best F-beta of that language's rows, or the common one where a language has too few toxic rows. Language, source
and id are never inputs of a score.

Null text counts as empty and is scored by the bias alone; texts of any length are read whole, in pieces whose maxima are
merged. Labels that are null, or whose document is missing, are left out; a document with several labels trains
with each, an id with several rows with one of them. Without both classes the score is the share of toxic labels (0 without any label). Columns of the input
keep their names and values; where one has the name of an output column, that gets underscores at its end.
"""

from __future__ import annotations

import pickle
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from calltrace.llm.text import Words, blocks, bounded_batches, byte_hashes, free_name, plain_bounds

BUCKETS = 1 << 17
DIM = 4
WIDTHS = {1: 8, 2: 4, 3: 4}
PARTS = 5
MAX_TRAIN = 12_000
#: Words whose responses are held at once when texts are scored.
PIECE_WORDS = 1 << 16
#: The score at which all languages together are best divided.
CUT = 0.7
#: A reject threshold should seldom hit clean documents.
BETA = 0.7


def features(words: Words) -> np.ndarray:
    """``(words, PARTS)`` embedding rows: the word, its first 4, 6 and 8 bytes and its last 4 bytes, in lower case without outer punctuation."""
    lower, start, end = plain_bounds(words)
    out = np.empty((len(start), PARTS), np.int32)
    seeds = (0, 0x5BD1, 0x7F4A, 0x1B87, 0x3C6E)
    bounds = ((start, end), (start, np.minimum(end, start + 4)), (start, np.minimum(end, start + 6)), (np.maximum(start, end - 4), end), (start, np.minimum(end, start + 8)))
    for k, (s, e) in enumerate(bounds):
        h = byte_hashes(lower, s, e) ^ np.uint64(seeds[k] * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        out[:, k] = (h >> np.uint64(20)) % np.uint64(BUCKETS)
    return out


class TextCnn:
    """The network: ``emb`` (BUCKETS, DIM); per width ``w`` a filter bank (w, DIM, n) and bias; output weights and bias."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.emb = np.zeros((BUCKETS, DIM), np.float32)
        self.noise = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.filters = {w: rng.normal(0, 0.5, (w, DIM, n)).astype(np.float32) for w, n in WIDTHS.items()}
        for w, n in WIDTHS.items():  # half of the filters begin by reading the log odds
            self.filters[w][:, 0, : n // 2 + 1] = np.abs(self.filters[w][:, 0, : n // 2 + 1]) + 0.5
        self.bias = {w: np.zeros(n, np.float32) for w, n in WIDTHS.items()}
        self.out = rng.normal(0.3, 0.1, sum(WIDTHS.values())).astype(np.float32)
        self.base = np.float32(-1.0)
        self.scale, self.shift = 1.0, 0.0

    def pooled(self, feats: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Maxima per text (texts, filters) and, per width, the word at which each was taken (-1: none)."""
        n, texts = len(feats), len(first) - 1
        x = self.emb[feats[:, 0]]
        for k in range(1, PARTS):
            x += self.emb[feats[:, k]]
        tops, won = [], {}
        length = np.diff(first)
        for w, bank in self.filters.items():
            count = bank.shape[2]
            top = np.full((texts, count), 0.0, np.float32)
            if n >= w:
                y = x[: n - w + 1] @ bank[0]
                for j in range(1, w):
                    y += x[j : n - w + 1 + j] @ bank[j]
                y += self.bias[w]
                has = np.flatnonzero(length >= w)
                if len(has):
                    # a window that crosses a text's end takes no part
                    edge = np.repeat(first[1:-1], w - 1) - np.tile(np.arange(1, w), len(first) - 2) if w > 1 and len(first) > 2 else np.zeros(0, np.int64)
                    y[edge[(edge >= 0) & (edge < len(y))]] = -np.inf
                    s = first[:-1][has]
                    best = np.maximum.reduceat(y, s, axis=0) if len(has) == texts else np.stack([y[a:b].max(axis=0) for a, b in zip(s, first[1:][has] - w + 1, strict=True)])
                    top[has] = np.maximum(best, 0)
                    won[w] = (y, s, has, best)
            tops.append(top)
            won.setdefault(w, None)
        return np.concatenate(tops, axis=1), won

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return (pooled @ self.out + self.base) * self.scale + self.shift

    def score(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) == 2 and len(feats) > PIECE_WORDS:  # one long text: the maxima of its pieces
            over = max(WIDTHS) - 1
            parts = [feats[a : a + PIECE_WORDS + over] for a in range(0, len(feats), PIECE_WORDS)]
            top = np.max([self.pooled(p, np.array([0, len(p)]))[0] for p in parts], axis=0)
        else:
            top = self.pooled(feats, first)[0]
        return 1 / (1 + np.exp(-np.clip(self.logits(top).astype(np.float64), -30, 30)))


def log_odds(have: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Smoothed log odds of each bucket; ``have``: (2, BUCKETS) texts of each class that hold it, ``rows``: texts of each class."""
    neg, pos = np.maximum(rows, 1)
    odds = np.log((have[1] + 0.5) / (pos + 1)) - np.log((have[0] + 0.5) / (neg + 1))
    seen = have.sum(axis=0)
    return (odds * (seen / (seen + 2))).astype(np.float32)


def fit(feats: list[np.ndarray], labels: np.ndarray, langs: list[str | None], held: np.ndarray, odds: np.ndarray, epochs: int = 6, rate: float = 0.02, batch: int = 32, seed: int = 7) -> tuple[TextCnn, dict]:
    """The trained network and thresholds ``{language or None: threshold}``. ``feats``: each text's :func:`features`; ``held``: rows
    to calibrate with; ``odds``: log odds of the other rows."""
    net, rng = TextCnn(seed), np.random.default_rng(seed)
    hold, train = np.flatnonzero(held), np.flatnonzero(~held)
    y = labels.astype(np.float32)
    pos, neg = max(1, int(y[train].sum())), max(1, int((1 - y[train]).sum()))
    net.emb = net.noise * 0.2
    net.emb[:, 0] = np.clip(odds, -3, 5) / PARTS
    del net.noise
    weight = np.where(y == 1, len(train) / (2 * pos), len(train) / (2 * neg)).astype(np.float32)

    params = {"out": net.out, **{f"f{w}": net.filters[w] for w in WIDTHS}, **{f"b{w}": net.bias[w] for w in WIDTHS}}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    base_m = [0.0, 0.0]
    emb_sq = np.full(BUCKETS, 1e-4, np.float32)
    step = 0
    for _ in range(epochs):
        rng.shuffle(train)
        for lo in range(0, len(train), batch):
            rows = train[lo : lo + batch]
            lens = np.array([len(feats[i]) for i in rows])
            flat = np.concatenate([feats[i] for i in rows]) if lens.sum() else np.zeros((0, PARTS), np.int32)
            first = np.concatenate([[0], np.cumsum(lens)])
            top, won = net.pooled(flat, first)
            p = 1 / (1 + np.exp(-np.clip(top @ net.out + net.base, -30, 30)))
            d = (p - y[rows]) * weight[rows] / len(rows)
            grads = {"out": top.T @ d + 1e-4 * net.out}
            d_top = d[:, None] * net.out * (top > 0)
            col, emb_rows, emb_grads = 0, [], []
            for w, bank in net.filters.items():
                n = bank.shape[2]
                g = np.zeros_like(bank)
                gb = d_top[:, col : col + n].sum(axis=0)
                if won[w] is not None:
                    resp, _, has, _ = won[w]
                    for t in has:
                        live = np.flatnonzero(d_top[t, col : col + n])
                        if not len(live):
                            continue
                        at = first[t] + resp[first[t] : first[t + 1] - w + 1][:, live].argmax(axis=0)
                        dt = d_top[t, col + live]
                        for j in range(w):
                            rows_j = flat[at + j]
                            g[j][:, live] += net.emb[rows_j].sum(axis=1).T * dt
                            emb_rows.append(rows_j.ravel())
                            emb_grads.append(np.repeat(dt[:, None] * bank[j][:, live].T, PARTS, axis=0))
                grads[f"f{w}"], grads[f"b{w}"] = g + 1e-4 * bank, gb
                col += n
            step += 1
            for k, v in params.items():
                m, s = moment[k]
                m *= 0.9
                m += 0.1 * grads[k]
                s *= 0.99
                s += 0.01 * grads[k] ** 2
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            base_m[0] = 0.9 * base_m[0] + 0.1 * float(d.sum())
            base_m[1] = 0.99 * base_m[1] + 0.01 * float(d.sum()) ** 2
            net.base = np.float32(net.base - rate * (base_m[0] / (1 - 0.9**step)) / (np.sqrt(base_m[1] / (1 - 0.99**step)) + 1e-8))
            if emb_rows:
                at, gr = np.concatenate(emb_rows), np.concatenate(emb_grads)
                uniq, inv = np.unique(at, return_inverse=True)
                total = np.zeros((len(uniq), DIM), np.float32)
                np.add.at(total, inv, gr)
                emb_sq[uniq] += (total**2).mean(axis=1)
                net.emb[uniq] -= rate * total / np.sqrt(emb_sq[uniq])[:, None]

    def raw(rows):
        return np.array([float((net.pooled(feats[i], np.array([0, len(feats[i])]))[0] @ net.out + net.base)[0]) for i in rows])

    z, t = raw(hold), y[hold].astype(np.float64)
    if 0 < t.sum() < len(t):  # calibration on the held-out fifth: slope and shift by damped Newton steps towards smoothed targets
        goal = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            r, q = p - goal, p * (1 - p) + 1e-4
            h = np.array([[np.sum(q * z * z) + 1, np.sum(q * z)], [np.sum(q * z), np.sum(q) + 1]])
            da, db = np.clip(np.linalg.solve(h, [np.sum(r * z), np.sum(r)]), -0.1, 0.1)
            a, b = max(a - da, 0.05), b - db
        net.scale, net.shift = float(a), float(b)
    score = 1 / (1 + np.exp(-np.clip(z * net.scale + net.shift, -30, 30)))

    def best(rows):
        options = np.linspace(0.04, 0.96, 47)

        def f_beta(c):
            hit = score[rows] >= c
            tp, fp, fn = (hit & (t[rows] == 1)).sum(), (hit & (t[rows] == 0)).sum(), (~hit & (t[rows] == 1)).sum()
            return (1 + BETA**2) * tp / max(1, (1 + BETA**2) * tp + BETA**2 * fn + fp)

        got = np.array([f_beta(c) for c in options])
        return float(np.median(options[got == got.max()]))

    every = np.arange(len(hold))
    if 0 < t.sum() < len(t):  # the common threshold becomes CUT
        move = np.log(CUT / (1 - CUT)) - np.log((c := best(every)) / (1 - c))
        net.shift += float(move)
        score = 1 / (1 + np.exp(-np.clip(z * net.scale + net.shift, -30, 30)))
    thresholds: dict[str | None, float] = {None: CUT}
    lang = np.array([langs[i] or "" for i in hold], object)
    for name in sorted(set(lang) - {""}):
        rows = np.flatnonzero(lang == name)
        if (t[rows] == 1).sum() >= 10 and (t[rows] == 0).sum() >= 10:
            thresholds[name] = best(rows)
    return net, thresholds


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, label: str = "toxic", seed: int = 0) -> DataFrame:
    """``(text, lang, y)``: at most ``max_train`` labelled rows, at most half of them toxic, by a seeded hash of the id."""
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y")).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    half = max_train // 2
    picked = known.where("y = 1").orderBy("_h", "doc_id").limit(half).unionByName(known.where("y = 0").orderBy("_h", "doc_id").limit(half))
    found = docs.select("doc_id", "text", "lang").join(F.broadcast(picked), "doc_id")
    one = F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("d")  # rows repeated with one id train as one
    return found.groupBy("doc_id", "y", "_h").agg(one).select("d.text", "d.lang", "y", "_h", "doc_id")


@dataclass
class Model:
    """A network (None without both classes), thresholds by language (None: all others) and the share of toxic labels."""

    net: TextCnn | None
    thresholds: dict[str | None, float]
    share: float


def _fit_rows(options: dict):
    """One task's fit: rows come twice, first all of pass 0, then all of pass 1; gives the pickled :class:`Model`."""

    def run(batches):
        have, rows, odds = np.zeros((2, BUCKETS), np.float32), np.zeros(2), None
        ends, y, langs, held = [0], [], [], []
        kept = tempfile.TemporaryFile()  # this task's alone
        for block in blocks(batches):
            words = Words(block.column("text"))
            f = features(words)
            cuts = words.first.tolist()
            columns = (block.column(c).to_pylist() for c in ("pass", "y", "lang", "held"))
            for k, (second, label, lang, hold) in enumerate(zip(*columns, strict=True)):
                own = f[cuts[k] : cuts[k + 1]]
                if not second:
                    if not hold:
                        have[label, np.unique(own)] += 1
                        rows[label] += 1
                    continue
                if odds is None:
                    odds = log_odds(have, rows)
                kept.write(np.ascontiguousarray(own).data)
                ends.append(ends[-1] + len(own))
                y.append(label)
                langs.append(lang)
                held.append(hold)
        y, held = np.array(y, np.int64), np.array(held, bool)
        kept.flush()
        every = np.memmap(kept, np.int32, "r", shape=(ends[-1], PARTS)) if ends[-1] else np.zeros((0, PARTS), np.int32)
        feats = [every[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        if not len(y) or y.min() == y.max():
            model = Model(None, {None: CUT}, float(y.mean()) if len(y) else 0.0)
        else:
            model = Model(*fit(feats, y, langs, held, odds, **options), float(y.mean()))
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(model)]}, pa.schema([("model", pa.binary())]))

    return run


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, **options) -> Model:
    """Fit on at most ``max_train`` labelled rows, in one task; the driver gets the weights alone."""
    bounded_batches(docs.sparkSession)
    rows = training_rows(docs, labels, max_train).withColumn("held", F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(5)) == 0)
    rows = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("pass")).repartition(1).sortWithinPartitions("pass", "_h", "doc_id", "y", "text")
    got = rows.select("pass", "y", "lang", "held", "text").mapInArrow(_fit_rows(options), "model binary").collect()
    return pickle.loads(got[0].model) if got else Model(None, {None: CUT}, 0.0)


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``; the model is of fixed size and goes along as a broadcast variable."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    names = docs.columns
    own, out = free_name("_tox_text", names), free_name("score", names)
    given = docs.withColumn(own, F.col(text))

    def run(batches):
        model = pickle.loads(shared.value)
        for block in blocks(batches, column=own):
            if model.net is None:
                score = np.full(block.num_rows, model.share)
            else:
                words = Words(block.column(own))
                score = model.net.score(features(words), words.first)
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in names), pa.array(score, pa.float64())], names=[*names, out])

    return given.mapInArrow(run, StructType(docs.schema.fields[:]).add(out, "double"))


def threshold(thresholds: dict[str | None, float], lang: Column) -> Column:
    """The threshold of a row's language."""
    limit = F.lit(thresholds[None])
    for name, value in thresholds.items():
        if name is not None:
            limit = F.when(lang == name, F.lit(value)).otherwise(limit)
    return limit


def without_toxic(docs: DataFrame, model: Model, lang: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` whose score is below their language's threshold."""
    scored = score_documents(docs, model, **options)
    return scored.where(F.col(scored.columns[-1]) < threshold(model.thresholds, F.col(lang))).select(*docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``threshold`` and ``rejected`` tell what the calibrated threshold of a document's language says; ``predicted`` uses 0.7 for all.
    A row without an id is not held out, and no label is its."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(part != 1)
    model = train(docs, labels)
    limit = threshold(model.thresholds, F.col("lang"))
    out = score_documents(docs, model)
    return out.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), limit.alias("threshold"), (F.col("score") >= limit).alias("rejected"))
