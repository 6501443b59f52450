"""Line dedup: levelled sorted runs of line hashes, compacted periodically. DataFrame functions only.

:class:`LineRuns` keeps runs: tables of line hashes with the number of documents that hold each so far, bucketed by hash and
sorted within a bucket, all with the same buckets. A new batch is dealt into these buckets once and merge-joined with the runs, none
of which moves: lines that no run holds are new and enter with the batch's count, lines of a run enter with the count carried
forward. Both make the batch's own run, of level 0, whose counts hold from then on. When a level has ``fanout`` runs they are merged
into one run of the next level: of the older runs those lines stay that no later one holds, by merge anti joins of the buckets. So n batches leave at most ``fanout *
log(n)`` runs, each line is rewritten once a level, and the answer is read off the last level.

:func:`drop_frequent_lines` sends a table through the runs in batches, then drops every line found in at least
``min_docs`` documents.

Null and empty texts hold one empty line, whose key is empty: it is never counted or dropped. A document is a row:
rows repeated with one id and text, or with a null id, count once each and come out once each. Long texts stay in one row as an array.
Columns of the input keep their names and values; where one has the name of an output column, that gets underscores at its end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltrace.functions.work import delete, materialize, new_path, shuffles_end
from calltrace.llm.text import free_name

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at both ends and with A-Z in lower case."""
    key = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


class LineRuns:
    """Runs of ``(h1, h2, n_docs)``: the two halves of a 128-bit line hash, and the documents that hold it up to that run."""

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def runs(self) -> list[DataFrame]:
        """All runs, the latest first."""
        return [self.spark.table(name) for level in self.levels for name in reversed(level)]

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, "line-run")
        # dealt as it is bucketed, so a bucket is one sorted file
        dealt = rows.repartition(self.buckets, "h1", "h2")
        with shuffles_end(self.spark):
            dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.paths[name]).format("parquet").saveAsTable(name)
        return name

    def add(self, counts: DataFrame) -> None:
        """Add a batch of distinct ``(h1, h2, n_docs)``."""
        new = counts.select("h1", "h2", "n_docs")
        before = []
        for k, run in enumerate(self.runs()):
            new = new.join(run.select("h1", "h2", F.col("n_docs").alias(f"before_{k}")), ["h1", "h2"], "left")
            before.append(F.col(f"before_{k}"))
        carried = F.coalesce(*before, F.lit(0)) if before else F.lit(0)  # the latest run that holds the line
        self._push(self._write(new.select("h1", "h2", (F.col("n_docs") + carried).cast("long").alias("n_docs"))), 0)

    def _push(self, run: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            self._merge(level)

    def _latest(self, names: list[str]) -> DataFrame:
        """Each line of these runs (the oldest first) as the latest run that holds it has it: merge anti joins within the buckets."""
        runs = [self.spark.table(name) for name in reversed(names)]
        out = runs[0]
        for k, run in enumerate(runs[1:], 1):
            for later in runs[:k]:
                run = run.join(later.select("h1", "h2"), ["h1", "h2"], "left_anti")
            # a union of bucketed tables must not be grouped as it is: Spark takes it for bucketed, but reads its parts one after the other
            out = out.unionByName(run)
        return out

    def _merge(self, level: int) -> None:
        """One run of the next level for the runs of this one."""
        old, self.levels[level] = self.levels[level], []
        self._push(self._write(self._latest(old)), level + 1)
        for name in old:
            self._drop(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        delete(self.spark, self.paths.pop(name))

    def compact(self) -> DataFrame | None:
        """Merge level by level until one run is left; its ``(h1, h2, n_docs)`` are the counts of all batches."""
        while sum(map(len, self.levels)) > 1:
            low = next(k for k, level in enumerate(self.levels) if level)
            if len(self.levels[low]) == 1:  # goes up as it is
                self.levels[low + 1].append(self.levels[low].pop())
            else:
                self._merge(low)
        left = self.runs()
        return left[0] if left else None

    def close(self) -> None:
        """Delete all runs; nothing lazy may still read them."""
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = []


def drop_frequent_lines(
    docs: DataFrame, min_docs: int = 10, min_key: int = 1, batches: int = 3, fanout: int = 3, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``.

    A line's key is :func:`line_key`; keys of at least ``min_key`` code points found in at least ``min_docs`` documents
    lose all their lines. The rows are dealt into ``batches`` batches by a hash of the document's id and text.
    """
    given = docs.columns
    names = [free_name(c, given) for c in ("kept_text", "n_lines", "n_dropped")]
    inner = [f"c{k}" for k in range(len(given))]  # no name of the input meets one of ours
    body, ident = F.col(inner[given.index(text)]), F.col(inner[given.index(doc_id)])
    row = docs.toDF(*inner).withColumn("_ld_id", ident).withColumn("_ld_h", F.xxhash64(body))
    lines = F.split(F.coalesce(body, F.lit("")), "\n")
    seen = materialize(
        row.withColumn("_ld_row", F.monotonically_increasing_id())  # before the explode, so that it numbers documents
        .select("_ld_id", "_ld_h", "_ld_row", F.posexplode(lines).alias("pos", "line"))
        .select("_ld_id", "_ld_h", "_ld_row", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_key)
        .select(
            "_ld_id", "_ld_h", "_ld_row", "pos",
            F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
            F.pmod(F.xxhash64("_ld_id", "_ld_h"), F.lit(batches)).alias("batch"),
        ),
        "lines",
    )
    store = LineRuns(docs.sparkSession, fanout)
    for k in range(batches):
        batch = seen.where(F.col("batch") == k)
        store.add(batch.select("h1", "h2", "_ld_row").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs")))
    frequent = materialize(store.compact().where(F.col("n_docs") >= min_docs).select("h1", "h2"), "frequent-lines")
    store.close()
    hits = seen.join(frequent, ["h1", "h2"]).groupBy("_ld_id", "_ld_h").agg(F.collect_set("pos").alias("_ld_drop"))
    d, h = row.alias("d"), hits.alias("h")
    joined = d.join(h, F.col("d._ld_id").eqNullSafe(F.col("h._ld_id")) & (F.col("d._ld_h") == F.col("h._ld_h")), "left")
    n_lines, n_dropped = F.size(lines).cast("long"), F.coalesce(F.size("_ld_drop"), F.lit(0)).cast("long")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_ld_drop"))
    kept_text = F.when(F.col("_ld_drop").isNull(), F.coalesce(body, F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return joined.select(*inner, kept_text.alias("_kept"), n_lines.alias("_n"), n_dropped.alias("_dropped")).toDF(*given, *names)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_frequent_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP6_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT doc_id, pos, line, k IN (SELECT k FROM frequent) AS gone FROM keyed)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
