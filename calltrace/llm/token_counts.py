"""Token counts as delta-maintained rollups.

Changes to documents are signed rows: an insert adds one document and its tokens, a delete takes them away, a revised
count does both. :class:`TokenRollup` sums a batch of changes by source, language and tokenizer version and commits it as
one additive delta under the batch's id. A batch id commits once: a second commit of it, as after a failure or by another
writer, changes nothing. Totals are the sum of the live deltas; :meth:`TokenRollup.compact` folds them into one.

The folder holds written deltas and a log of numbered entries. Whatever is committed is one log entry, put in place by a
rename that fails where the number is taken; then the writer reads the log again and, if the change still holds, takes
the next number. An entry names the delta that it adds, the batch id it commits, and the deltas that it replaces. So a writer
that is lost between any two steps leaves a delta that no entry names, never half a change. The rename is as atomic as the file
system's own.

Null sources and languages are groups of their own; null texts count as empty, with 0 tokens. Repeated rows are changes of
their own. Groups whose documents have all been deleted vanish from the totals. ``n_tokens`` among the columns given to
:func:`count_tokens` gives way to the new count's name with an underscore at its end.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltrace.functions.work import materialize, new_path, shuffles_end
from calltrace.llm.text import blocks, bounded_batches, free_name
from calltrace.llm.tokens import Encoder

KEYS = ["source", "lang", "tokenizer"]


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_tokens`` by a public tokenizer (no special tokens)."""
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]
    out = free_name("n_tokens", rest)

    def count(batches):
        encoder = Encoder.of(tokenizer)
        for block in blocks(batches, column=text):
            _, ends = encoder.encode(block.column(text))
            yield pa.RecordBatch.from_arrays([block.column(c) for c in rest] + [pa.array(np.diff(ends, prepend=0))], names=[*rest, out])

    schema = docs.select(*rest).schema.add(out, "long")
    return docs.mapInArrow(count, schema)


def inserts(rows: DataFrame) -> DataFrame:
    """``rows`` with source, lang, tokenizer and n_tokens as changes."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").cast("long").alias("d_tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    return inserts(rows).select(*KEYS, (-F.col("d_docs")).alias("d_docs"), (-F.col("d_tokens")).alias("d_tokens"))


def revisions(rows: DataFrame) -> DataFrame:
    """Changes of rows that hold old_tokens and n_tokens, and old_source and old_lang where the document moved."""
    old = [F.col(f"old_{c}").alias(c) if f"old_{c}" in rows.columns else F.col(c) for c in KEYS]
    both = F.array(
        F.struct(*old, F.lit(-1).cast("long").alias("d_docs"), (-F.col("old_tokens")).cast("long").alias("d_tokens")),
        F.struct(*KEYS, F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").cast("long").alias("d_tokens")),
    )
    return rows.select(F.explode(both).alias("c")).select("c.*")


class TokenRollup:
    """Committed deltas in ``folder``: ``data/`` and ``log/``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def entries(self) -> list[dict]:
        """The log's entries in order."""
        fs, path = self._path("log")
        names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
        texts = self.spark.read.text([f"{self.folder}/log/{n}" for n in names], wholetext=True).collect() if names else []  # an entry is a few names
        return sorted((json.loads(r.value) for r in texts), key=lambda e: e["number"])

    @staticmethod
    def live(entries: list[dict]) -> list[str]:
        """The deltas that make the totals."""
        gone = {d for e in entries for d in e["replaces"]}
        return [e["delta"] for e in entries if e["delta"] not in gone]

    def _append(self, entry: dict) -> bool:
        """Put an entry in place; False if its number is taken."""
        jvm = self.spark.sparkContext._jvm
        fs, part = self._path(f"part-{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        _, log = self._path("log")
        fs.mkdirs(log)
        _, path = self._path(f"log/{entry['number']:012d}.json")
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(kind, 1)
        none[0] = kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(part, path, none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.toString():
                raise
            fs.delete(part, False)
            return False
        return True

    def _publish(self, delta: str, batch_id: str | None, replaces: list[str]) -> bool:
        while True:
            entries = self.entries()
            if batch_id is not None and any(e["batch"] == batch_id for e in entries):
                return False
            if set(replaces) - set(self.live(entries)):
                return False
            if self._append({"number": len(entries), "batch": batch_id, "delta": delta, "replaces": replaces}):
                return True

    def _write(self, delta: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        with shuffles_end(self.spark):
            delta.write.parquet(f"{self.folder}/{name}")
        return name

    def _drop(self, name: str) -> None:
        fs, path = self._path(name)
        fs.delete(path, True)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch's signed changes; False if the id has been committed before."""
        if any(e["batch"] == batch_id for e in self.entries()):
            return False
        name = self._write(changes.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")))
        done = self._publish(name, batch_id, [])
        if not done:
            self._drop(name)
        return done

    def _read(self, names: list[str]) -> DataFrame:
        schema = "source string, lang string, tokenizer string, d_docs long, d_tokens long"
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{n}" for n in names))

    def deltas(self) -> DataFrame:
        return self._read(self.live(self.entries()))

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, n_docs, n_tokens)``."""
        out = self.deltas().groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return out.where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> bool:
        """Fold the live deltas into one; batch ids stay committed. False if there is nothing to fold or another writer was first.

        The folded deltas' files stay for readers that have them open; :meth:`clean` deletes them.
        """
        old = self.live(self.entries())
        if len(old) < 2:
            return False
        name = self._write(self._read(old).groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")))
        done = self._publish(name, None, old)
        if not done:
            self._drop(name)
        return done

    def clean(self) -> None:
        """Delete the files of deltas that have been replaced; no reader may still use them."""
        for name in {d for e in self.entries() for d in e["replaces"]}:
            self._drop(name)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents enter with their number of words as a first estimate, which is then revised to the tokenizer's count; a second
    version of counts, in words, is inserted and deleted again; the deltas are folded twice, and one batch comes twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang", "text")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")
    rollup = TokenRollup(spark, new_path(spark, "token-counts"))
    counted = materialize(count_tokens(docs.withColumn("old_tokens", words)), "token-counted").withColumn("tokenizer", F.lit("byte_bpe_50k"))
    estimates = counted.select("source", "lang", "tokenizer", F.col("old_tokens").alias("n_tokens"))
    by_words = estimates.withColumn("tokenizer", F.lit("words"))
    rollup.commit("load", inserts(estimates).unionByName(inserts(by_words)))
    rollup.commit("exact", revisions(counted))
    rollup.compact()
    rollup.commit("exact", revisions(counted))  # a repeated commit changes nothing
    rollup.commit("retire-words", deletes(by_words))
    rollup.compact()
    return rollup.totals()
