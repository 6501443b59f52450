"""Token ids of a table, written as shards of patched frame-of-reference blocks (:mod:`calltrace.llm.pfor`) and read back.

Rows are dealt into ranges of ascending document id and sorted (a null id first, rows of one id by a hash of the text), and the
ranges may cut an id that holds many rows; each task
tokenizes its range, appends the end id to each document and writes shards of about ``shard_ids`` ids. A shard is written
under a temporary name and renamed, and a task that runs again writes the same bytes under the same names, so a lost
executor leaves no partial or doubled shard. Null texts count as empty: such a document is its end id alone. Rows repeated
with one id are documents of their own. The folder must be one that all executors share; one without a scheme is in the
cluster's default file system.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calltrace.functions.work import new_path, qualified, shuffles_end
from calltrace.llm import pfor
from calltrace.llm.text import blocks, bounded_batches
from calltrace.llm.tokens import Encoder

TOKENIZER = "byte_bpe_50k.json"
SHARD_IDS = 1 << 20


def _put(path: str, data: bytes) -> None:
    """Write a file whole or not at all."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    if path.startswith("file:"):
        part, path = (re.sub("^file:/*", "/", p) for p in (part, path))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    part = f"{name}.{uuid.uuid4().hex}.part"
    store.create_dir(os.path.dirname(name), recursive=True)
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, name)


def write_shards(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = 0, shard_ids: int = SHARD_IDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards; returns the written manifest ``(path, n_ids, n_docs)``, one row per shard."""

    def write(batches):
        encoder, part, seq = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush():
            path = f"{folder}/part-{part:06d}-{seq:06d}.pfor"
            flat = np.concatenate(ids)
            _put(path, pfor.encode(flat, docs, np.cumsum(np.concatenate(sizes))))
            return pa.RecordBatch.from_pydict({"path": [path], "n_ids": [len(flat)], "n_docs": [len(docs)]})

        for block in blocks(batches):
            got, ends = encoder.encode(block.column("text"))
            ids.append(np.insert(got, ends, end_id))
            sizes.append(np.diff(ends, prepend=0) + 1)
            docs += block.column("doc_id").to_pylist()
            held += len(ids[-1])
            if held >= shard_ids:
                yield flush()
                ids, docs, sizes, held, seq = [], [], [], 0, seq + 1
        if docs:
            yield flush()

    bounded_batches(docs.sparkSession)
    folder = qualified(docs.sparkSession, folder)
    # the row's number parts rows that are equal, so that no id and no text makes a range that can't be cut
    order = [F.xxhash64("text").alias("tid"), F.monotonically_increasing_id().alias("row")]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).select("doc_id", "text", *order)
    rows = rows.repartitionByRange("doc_id", "tid", "row").sortWithinPartitions("doc_id", "tid", "row")
    manifest = rows.mapInArrow(write, "path string, n_ids long, n_docs long")
    with shuffles_end(docs.sparkSession):
        manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """``(part, seq, at, doc_id, n_tokens, ids_crc32)`` per document, from the files."""

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                part, seq = map(int, re.search(r"part-(\d+)-(\d+)\.pfor$", path.as_py()).groups())
                shard = pfor.Shard(content.as_buffer())
                ids = shard.ids().astype("<u4")
                starts = np.concatenate([[0], shard.ends[:-1]])
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), shard.ends.tolist(), strict=True)]
                n = shard.n_docs
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(shard.ends - starts), pa.array(crc, pa.int64())],
                    names=["part", "seq", "at", "doc_id", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("path", "content")
    return files.mapInArrow(read, "part int, seq int, at int, doc_id long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write ``docs`` and return ``(doc_id, start, n_tokens, ids_crc32)`` as read from the files."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-ids")
    write_shards(docs, folder, **options)
    rows = read_shards(spark, folder)
    # one row per range, whatever the number of documents
    before = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq", "at")) - F.col("n_tokens")
    out = rows.withColumn("inside", inside).join(before, "part")
    return out.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))
