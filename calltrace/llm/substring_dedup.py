"""Substring dedup: seed and extend over winnowed anchors.

A window is ``window`` consecutive words. Every window has one anchor: the leftmost smallest hash among its runs of
``gram`` words. Neighbouring windows that share an anchor form a seed, which is the anchor extended both ways as far as
its windows reach. Equal windows have equal anchors, so only seeds with a common anchor need to meet:

1. Each task makes the seeds of its texts and marks those equal to an earlier seed of its own.
2. Seeds whose anchor occurs once are dropped.
3. Seeds with equal anchor and equal extension have the same windows: all but the earliest are repeats as a whole.
4. Where an anchor has several extensions, the earliest seed of each is cut into windows, which are compared one by one.
5. Covered stretches are merged per document into maximal repeats, and their words removed.

Seeds and windows are compared by 128-bit hashes (two independent 64-bit hashes). Groups are reduced to their earliest
member by partial aggregation, and rows meet their group in joins of written tables that adaptive execution can split, so
neither thousands of copies nor a passage shared by a third of all documents gathers in one task, and no pairs are made.

Null text holds no words. Texts with fewer words than a window lose none. Rows with equal id and text are one document and
come out alike; rows with equal id and different texts are ordered by a hash of the text. A null id orders first. Columns of the
input keep their names and values; where one has the name of an output column, that gets underscores at its end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from calltrace.functions.work import materialize, release
from calltrace.llm.text import Words, blocks, bounded_batches, free_name, ranges, runs, spans_hash

GRAM = 5
#: Seeds a task holds to find repeats among its own; more are dealt with in several such groups.
HELD = 400_000


def seeds(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Per seed: text, first window's first word, number of windows, anchor hash, extension hash."""
    h = words.hashes()
    n = np.diff(words.first)
    starts = ranges(words.first[:-1], np.maximum(n - window + 1, 0))
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    low = runs(h, gram)
    g = low
    at = np.arange(len(low), dtype=np.int32)
    reach, size = 1, window - gram + 1
    while reach < size:  # leftmost smallest of `size` neighbours, by doubling
        step = min(reach, size - reach)
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.minimum(low[step:], low[:-step])
        reach += step
    chosen = at[starts]
    new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    first, count = starts[new], np.diff(np.append(new, len(starts)))
    anchor = g[chosen[new]]
    extension = spans_hash(h, first, first + count + window - 1, 1) + (chosen[new] - first).astype(np.uint64)
    return np.searchsorted(words.first, first, "right") - 1, first, count, anchor, extension


def _seed_rows(window: int, gram: int):
    def run(batches):
        held: list[tuple] = []
        rows = 0

        def flush():
            ids, tids, pos, anchor, ext = (np.concatenate(c) for c in zip(*[x[:5] for x in held], strict=True))
            null = np.concatenate([x[5] for x in held])
            order = np.lexsort((pos, tids, ids, ~null, ext, anchor))
            a, e = anchor[order], ext[order]
            lead = np.concatenate([[True], (a[1:] != a[:-1]) | (e[1:] != e[:-1])])
            first = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
            # the earliest seed itself may be there more than once: its row is repeated
            known = np.empty(len(order), bool)
            known[order] = (ids[order] != ids[first]) | (null[order] != null[first]) | (tids[order] != tids[first]) | (pos[order] != pos[first])
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=null), pa.array(tids), pa.array(pos), pa.array(anchor.view(np.int64)), pa.array(ext.view(np.int64)), pa.array(known)],
                names=["id", "tid", "pos", "anchor", "ext", "known"],
            )

        for block in blocks(batches):
            words = Words(block.column("text"))
            doc, first, count, anchor, ext = seeds(words, window, gram)
            if not len(doc):
                continue
            ids = block.column("id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            tids = block.column("tid").to_numpy(zero_copy_only=False)
            pos = (first - words.first[doc] << 8) | count
            held.append((ids[doc], tids[doc], pos, anchor, ext, null[doc]))
            rows += len(doc)
            if rows >= HELD:
                yield flush()
                held, rows = [], 0
        if held:
            yield flush()

    return run


def _window_rows(window: int):
    """Windows of the seeds in ``at``: ``(id, tid, pos, w1, w2)``."""

    def run(batches):
        for block in blocks(batches):
            words = Words(block.column("text"))
            h = words.hashes()
            lists = block.column("at")
            pos = lists.flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(block.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            count = pos & 255
            start = ranges(words.first[doc] + (pos >> 8), count)
            row = np.repeat(doc, count)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [block.column("id").take(take), block.column("tid").take(take), pa.array((start - words.first[row] << 8) | 1)]
                + [pa.array(spans_hash(h, start, start + window, k).view(np.int64)) for k in (0, 1)],
                names=["id", "tid", "pos", "w1", "w2"],
            )

    return run


def _cut_rows(window: int, names: list[str], added: list[str]):
    """Texts without the words covered by ``_ss_at`` (first window and number of windows, packed)."""

    def run(batches):
        for block in blocks(batches, column="_ss_text"):
            words = Words(block.column("_ss_text"))
            n = np.diff(words.first)
            lists = block.column("_ss_at").fill_null([])
            pos = lists.flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(block.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            start = words.first[doc] + (pos >> 8)
            edge = np.bincount(start, minlength=len(words) + 1) - np.bincount(start + (pos & 255) + window - 1, minlength=len(words) + 1)
            gone = np.cumsum(edge)[: len(words)] > 0
            keep = np.flatnonzero(~gone)
            at = ranges(words.start[keep], words.end[keep] - words.start[keep] + 1)
            size = np.concatenate([[0], np.cumsum(words.end[keep] - words.start[keep] + 1)])
            body = np.append(words.data, np.uint8(32))[at]
            body[size[1:] - 1] = 32
            cut = size[np.searchsorted(keep, words.first)]
            raw = body.tobytes()
            texts = [raw[a : b - 1] if b > a else b"" for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            removed = n - np.diff(np.searchsorted(keep, words.first))
            yield pa.RecordBatch.from_arrays(
                [*(block.column(c) for c in names), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(texts, pa.binary()).cast(pa.string())], names=[*names, *added]
            )

    return run


def _same(a: str, b: str):
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.tid") == F.col(f"{b}.tid"))


def covered(rows: DataFrame, window: int = 20, gram: int = GRAM) -> DataFrame:
    """Repeated stretches of ``rows (id, tid, text)``: ``(id, tid, at)``, written; ``at``: positions, each first window's word << 8 | number of windows."""
    if not gram < window <= 255:
        raise ValueError("gram < window <= 255 is needed")
    bounded_batches(rows.sparkSession)
    found = materialize(rows.mapInArrow(_seed_rows(window, gram), "id long, tid long, pos long, anchor long, ext long, known boolean"), "seeds")
    fresh = found.where("NOT known").drop("known")
    anchors = materialize(fresh.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    live = materialize(fresh.join(anchors, "anchor", "left_semi"), "seeds-live")
    known = materialize(found.where("known").select("id", "tid", "pos"), "seeds-known")
    release(found, anchors)
    me = F.struct("id", "tid", "pos")
    groups = materialize(live.groupBy("anchor", "ext").agg(F.min(me).alias("first"), F.count("*").alias("n")), "extensions")
    whole = materialize(live.join(groups.where("n > 1"), ["anchor", "ext"]).where(me != F.col("first")).select("id", "tid", "pos"), "repeats-whole")
    release(live)
    several = groups.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    lead = materialize(groups.join(several, "anchor", "left_semi").groupBy("first.id", "first.tid").agg(F.collect_list("first.pos").alias("at")), "leads")
    release(groups)
    cut = rows.alias("r").join(lead.alias("l"), _same("r", "l")).select("r.id", "r.tid", "r.text", "l.at").dropDuplicates(["id", "tid"])
    windows = materialize(cut.mapInArrow(_window_rows(window), "id long, tid long, pos long, w1 long, w2 long"), "windows")
    firsts = materialize(windows.groupBy("w1", "w2").agg(F.min(me).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "windows-first")
    single = windows.join(firsts, ["w1", "w2"]).where(me != F.col("first")).select("id", "tid", "pos")
    spans = materialize(known.unionByName(whole).unionByName(single).groupBy("id", "tid").agg(F.collect_list("pos").alias("at")), "repeats")
    release(known, whole, lead, windows, firsts)
    return spans


def remove_repeats(docs: DataFrame, window: int = 20, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``: the words left, joined by one space.

    A word is removed if a window that covers it has the words of a window that starts earlier (smaller id, or same
    document, earlier start).
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("tid"), F.col(text).alias("text"))
    spans = covered(rows, window, gram).toDF("_ss_i", "_ss_t", "_ss_at")
    names, inner = docs.columns, [f"c{k}" for k in range(len(docs.columns))]
    added = [free_name(c, names) for c in ("n_words", "n_removed", "kept_text")]
    given = docs.select(*[F.col(c).alias(k) for c, k in zip(names, inner, strict=True)], F.col(text).alias("_ss_text"), F.xxhash64(text).alias("_ss_tid"), F.col(doc_id).cast("long").alias("_ss_id"))
    joined = given.join(spans, F.col("_ss_id").eqNullSafe(F.col("_ss_i")) & (F.col("_ss_tid") == F.col("_ss_t")), "left").select(*inner, "_ss_text", "_ss_at")
    schema = StructType([StructField(k, f.dataType) for k, f in zip(inner, docs.schema, strict=True)]).add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return joined.mapInArrow(_cut_rows(window, inner, ["n_words", "n_removed", "kept_text"]), schema).toDF(*names, *added)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM documents),
win AS (
  SELECT doc_id, s, md5(array_to_string(ws[s:s+19], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
rep AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM rep),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
