"""Ranks over long keys, or over whole tables, without a task that holds a key.

Rows are dealt by ranges of key and order; each task numbers its own rows, and the counts of the tasks before it (a row a task, for
the one key that can go on from task to task) are summed up and added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from calltrace.functions.work import materialize


def ranked(rows: DataFrame, key: str | None, order: list[str | Column], name: str = "rank", tasks: int | None = None) -> DataFrame:
    """``rows`` with a 1-based ``name`` within ``key`` (None: within the table) by ``order``, which should leave no ties. Null keys are one key."""
    spark = rows.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([*rows.schema.fields, StructField("_chunk", IntegerType()), StructField("_n", LongType()), StructField("_first", BooleanType()), StructField("_end", BooleanType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, last, base, opening = TaskContext.get().partitionId(), None, None, 0, True

        def told(batch: pa.RecordBatch, n: np.ndarray, mine: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), chunk, np.int32)), pa.array(n), pa.array(mine), pa.array(end)], names=[*batch.schema.names, "_chunk", "_n", "_first", "_end"])

        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            if key is None:
                first, value, after = np.array([held is None] + [False] * (size - 1)), None, None
            else:
                coded = batch.column(key).dictionary_encode(null_encoding="encode")
                codes = coded.indices.to_numpy(zero_copy_only=False)
                value, after = coded.dictionary[codes[0]].as_py(), coded.dictionary[codes[-1]].as_py()
                first = np.concatenate([[held is None or value != last], codes[1:] != codes[:-1]])
            if held is not None:
                held[3][-1] = first[0]
                yield told(*held)
                opening = opening and not first[0]
            begin = np.maximum.accumulate(np.where(first, np.arange(size), -1))
            n = np.where(begin < 0, base + np.arange(size) + 1, np.arange(size) - begin + 1)
            ahead = int(np.argmax(first[1:]) + 1) if first[1:].any() else size
            mine = np.zeros(size, bool)
            mine[:ahead] = opening
            opening = opening and ahead == size
            held, last, base = (batch, n, mine, np.append(first[1:], False)), after, int(n[-1])
        if held is not None:
            held[3][-1] = True
            yield told(*held)

    by = [*([F.col(key)] if key else []), *[F.col(c) if isinstance(c, str) else c for c in order]]
    done = materialize(rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by).mapInArrow(scan, schema), "ranked")
    k = (F.col(key) if key else F.lit(0)).alias("k")
    edge = done.where("_end").select(k, "_chunk", "_n", "_first")
    many = F.broadcast(edge.where("_first").select("k").distinct())  # at most a key a task
    edge = edge.alias("a").join(many.alias("b"), F.expr("a.k <=> b.k"), "left_semi")
    before = edge.withColumn("before", F.coalesce(F.sum("_n").over(Window.partitionBy("k").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_first")
    same = F.col("s._first") & F.expr("s._chunk = c._chunk")
    told = done.alias("s").join(F.broadcast(before.select("_chunk", "before").alias("c")), same, "left")  # a row a task
    return told.select(*[F.col(f"s.`{c}`") for c in rows.columns], (F.col("s._n") + F.coalesce("before", F.lit(0))).alias(name))
