"""Machines as composed maps against a plain fold."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from calltrace.operators import machines

TABLE = [("A", "x", "B"), ("B", "x", "C"), ("C", "x", "A"), ("A", "y", "A"), ("B", "y", "A"), ("C", "z", "D"), ("D", "y", "B")]


def folded(rows, start="A"):
    moves, state, out = {(a, s): b for a, s, b in TABLE}, {}, []
    for k, i, s in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or ""), r[1], (r[2] is not None, r[2] or ""))):
        before = state.get(k, start)
        state[k] = moves.get((before, s), before)
        out.append((k, i, s, before, state[k]))
    return out


def test_composed_scan():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 500):
        maps, first = rng.integers(0, 5, (n, 5)).astype(np.int32), rng.random(n) < 0.05
        first[0] = True
        got = machines.composed(maps, first)
        want = np.arange(5)
        for i in range(n):
            want = maps[i] if first[i] else maps[i][want]
            assert got[i].tolist() == want.tolist()


@pytest.mark.parametrize("batch,tasks", [(10000, 3), (7, 5), (1, 2)])
def test_machine_states(spark, batch, tasks):
    rnd = random.Random(batch)
    rows = [(rnd.choice(["hot"] * 6 + ["k1", "k2", None] + [f"c{j}" for j in range(9)]), i // 2, rnd.choice(["x", "y", "z", "other", None])) for i in range(500 if batch > 1 else 60)]
    rows += [("only", 1, "x")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "k string, i int, s string").repartition(4)
        table = spark.createDataFrame(TABLE, "from_state string, symbol string, to_state string")
        got = machines.machine_states(df, table, "k", ("i",), "s", "A", tasks).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    order = lambda r: tuple((v is not None, v) if v is not None else (False, "") for v in r)
    assert sorted((tuple(r) for r in got), key=order) == sorted(folded(rows), key=order)


def test_final_states_empty_tables_and_symbols_as_order(spark):
    table = spark.createDataFrame(TABLE, "from_state string, symbol string, to_state string")
    df = spark.createDataFrame([("k", 1, "x"), ("k", 1, "y"), ("k", 2, "x")], "k string, i int, s string")
    assert [tuple(r) for r in machines.run_machine(df, table, "k", ("i", "s"), "s", "A").collect()] == [("k", 3, "B")]
    assert machines.machine_states(df.limit(0), table, "k", ("i",), "s", "A").count() == 0
    assert {r.to_state for r in machines.machine_states(df, table.limit(0), "k", ("i",), "s", "A").collect()} == {"A"}


def test_one_key_of_a_million_rows(spark):
    """Linear, spread over tasks: each task gets its part of the one key."""
    n = 1_000_000
    symbol = F.element_at(F.array(*map(F.lit, "xyzxw")), (F.pmod(F.xxhash64("i"), F.lit(5)) + 1).cast("int"))
    df = spark.range(n).withColumnRenamed("id", "i").withColumns({"k": F.lit("hot"), "s": symbol})
    table = spark.createDataFrame(TABLE, "from_state string, symbol string, to_state string")
    began = time.time()
    out = machines.materialize(machines.machine_states(df, table, "k", ("i",), "s", "A", 8), "machine-test")
    assert time.time() - began < 120
    got = out.orderBy("i").toPandas()
    state, moves = "A", {(a, s): b for a, s, b in TABLE}
    for s, a, b in zip(got["s"], got["from_state"], got["to_state"], strict=True):
        assert a == state
        state = moves.get((state, s), state)
        assert b == state
    sizes = [r["count"] for r in df.repartitionByRange(8, "k", "i").groupBy(F.spark_partition_id()).count().collect()]
    assert len(got) == n and max(sizes) < 0.3 * n
