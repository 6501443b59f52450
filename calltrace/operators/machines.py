"""State machines over long keys: transitions are maps over states, and maps compose.

A fold looks at one row after the other, so a key with a third of all rows would be one task. Here rows are dealt by ranges of key and
order, so a hot key spreads over many tasks. Each task scans its rows in parallel form: every row is a map from the state before it to the
state after it, and the maps of a stretch compose pairwise in about log n vectorised steps, whatever state the stretch begins in. Only
the first key of a task can go on from the task before. For its rows the composed map is kept, and the one map at its end tells
the next tasks; these few maps (one a task and key) are composed in order of tasks, and the rows then read their state off their map.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from calltrace.functions.work import materialize


def transition_map(table: DataFrame, start: str) -> tuple[list[str], dict[str, list[int]]]:
    """The machine's states, the start first, and for each symbol where it leads from each of them. A machine is a description and is collected
    whole; of two rows for one state and symbol the larger target counts."""
    found = {(r.from_state, r.symbol): r.to_state for r in table.select("from_state", "symbol", "to_state").distinct().orderBy("from_state", "symbol", "to_state").collect()}
    states = [start, *sorted({s for (a, _), b in found.items() for s in (a, b)} - {start})]
    at = {s: i for i, s in enumerate(states)}
    maps: dict[str, list[int]] = {}
    for (a, symbol), b in found.items():
        maps.setdefault(symbol, list(range(len(states))))[at[a]] = at[b]
    return states, maps


def composed(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Inclusive scan: row i of the result maps the state before its segment to the state after row i. ``maps``: a map per row; ``first``:
    where segments begin."""
    out = maps.copy()
    n = len(out)
    since = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))  # rows of the segment before this one
    d = 1
    while d <= since.max(initial=0):
        ok = np.flatnonzero(since >= d)
        out[ok] = np.take_along_axis(out[ok], out[ok - d], axis=1)
        d *= 2
    return out


def machine_states(rows: DataFrame, table: DataFrame, key: str, order: tuple[str, ...], symbol: str, start: str = "START", tasks: int | None = None) -> DataFrame:
    """``rows`` with ``from_state`` and ``to_state``: the transition table ``(from_state, symbol, to_state)`` folded over each key's rows.

    A pair that is not in the table, and a null symbol, leaves the state as it is. Rows that tie in key and order are taken by symbol. Null keys
    are one key. ``tasks``: ranges that the rows are dealt to, by default as many as shuffles have.
    """
    states, maps = transition_map(table, start)
    size = len(states)
    names = list(maps)
    number = {s: i for i, s in enumerate(names)}
    steps = np.array([maps[s] for s in names] + [list(range(size))], np.int32)  # the last: no change
    spark = rows.sparkSession
    by = [F.col(key), *map(F.col, order), F.col(symbol)]
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    added = (("_chunk", IntegerType()), ("_from", ArrayType(IntegerType())), ("_to", ArrayType(IntegerType())), ("_first", BooleanType()), ("_end", BooleanType()))
    schema = StructType([*rows.schema.fields, *(StructField(n, t) for n, t in added)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        identity = np.arange(size, dtype=np.int32)
        held, carry, last, opening = None, identity, None, True  # a batch waits until it is known whether its last row ends a key
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(key).dictionary_encode(null_encoding="encode")
            codes = coded.indices.to_numpy(zero_copy_only=False)
            value = coded.dictionary[codes[0]].as_py()
            first = np.concatenate([[held is None or value != last], codes[1:] != codes[:-1]])
            if held is not None:
                yield _marked(held, bool(first[0]))
            if first[0]:
                opening = opening and held is None
                carry = identity
            sym = batch.column(symbol).to_pylist()
            own = steps[[number.get(s, -1) for s in sym]]
            to = composed(own, first)
            ahead = int(np.argmax(first[1:]) + 1) if first[1:].any() else len(first)  # rows of the batch's first key
            to[:ahead] = np.take_along_axis(to[:ahead], np.broadcast_to(carry, (ahead, size)), axis=1)
            before = np.vstack([carry[None], to[:-1]])
            before[np.flatnonzero(first)] = identity
            mine = np.zeros(len(first), bool)
            mine[:ahead] = opening
            opening = opening and ahead == len(first)
            carry, last = to[-1], coded.dictionary[codes[-1]].as_py()
            end = np.append(first[1:], False)
            held = (batch, before, to, mine, end, chunk)
        if held is not None:
            yield _marked(held, True)

    def _marked(held, ends: bool) -> pa.RecordBatch:
        batch, before, to, mine, end, chunk = held
        end[-1] = ends
        n = batch.num_rows
        # a key that begins in this task begins in the start state, the first of all: one number will do
        wide = np.where(mine, size, 1)
        offsets = pa.array(np.concatenate([[0], np.cumsum(wide)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(m[np.repeat(mine[:, None], size, 1) | (np.arange(size) == 0)].astype(np.int32))) for m in (before, to)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, chunk, np.int32)), *lists, pa.array(mine), pa.array(end)], names=[*batch.schema.names, "_chunk", "_from", "_to", "_first", "_end"])

    dealt = rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by)
    scanned = materialize(dealt.mapInArrow(scan, schema), "machine-scan")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = 0, []
        for r in pdf.sort_values("_chunk").itertuples():
            out.append(state)
            state = r.map[state] if r.whole else r.map[0]
        return pdf.sort_values("_chunk").assign(state=out)[["k", "_chunk", "state"]]

    # of each task the last row of its first and of its last key; of a key that lies within one task nothing is needed
    k = F.col(key).alias("k")
    edge = scanned.where("_end").select(k, "_chunk", F.col("_to").alias("map"), F.col("_first").alias("whole"))
    many = edge.where("whole").select("k").distinct()
    kind = dict(rows.dtypes)[key]
    same = F.expr("a.k <=> b.k")
    edge = edge.alias("a").join(F.broadcast(many).alias("b"), same, "left_semi")
    begin = edge.groupBy("k").applyInPandas(chain, f"k {kind}, _chunk int, state int")
    told = scanned.alias("s").join(F.broadcast(begin.alias("c")), F.col("s._first") & F.expr(f"s.`{key}` <=> c.k AND s._chunk = c._chunk"), "left")  # at most a row a task
    at = F.when(F.col("_first"), F.coalesce("state", F.lit(0))).otherwise(0)
    name = lambda c: F.get(F.array(*map(F.lit, states)), F.get(F.col(c), at))
    return told.select(*[F.col(f"s.`{c}`") for c in rows.columns], name("_from").alias("from_state"), name("_to").alias("to_state"))


def run_machine(rows: DataFrame, table: DataFrame, key: str, order: tuple[str, ...], symbol: str, start: str = "START") -> DataFrame:
    """``(key, n, final_state)`` of each key: no list of its rows is made."""
    x = machine_states(rows.select(key, *[c for c in order if c != symbol], symbol), table, key, order, symbol, start)
    return x.groupBy(key).agg(F.count("*").alias("n"), F.max_by("to_state", F.struct(*order, symbol)).alias("final_state"))
