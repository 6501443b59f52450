"""Calls watched while they run: state per call and timers, so that a call that rings and is never answered is told when its time is up.

Per call the state holds the sessions that may still change, each as one row of first and last times and counts; no events are kept. A session is all
events no further apart than ``gap``. Minima, maxima and sums don't depend on the order in which events come, and sessions
that a later event ties are merged, so that for all events within the watermark the stream tells what :func:`session_findings`
tells of the whole table. Events later than the watermark are dropped by Spark and counted in the query's progress.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: What a message means to the watch. Fixed values of the signalling protocols.
RINGS = ("180", "183", "RINGING", "ALERTING")
ANSWERS = ("200 OK", "CONNECT")
ENDS = ("BYE", "CANCEL", "DISCONNECT", "RELEASE")

FINDINGS = "key string, kind string, at long, start long, end long, events long, ring long, answer long, finish long"
_STATE = "start long, end long, events long, ring long, answer long, finish long, told boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sign(message: Column) -> Column:
    """``ring``, ``answer``, ``finish`` or null."""
    m = F.upper(message)
    any_of = lambda words: F.coalesce(m.rlike("|".join(words)), F.lit(False))
    return F.when(any_of(ENDS) | m.rlike("^[4-6][0-9][0-9]"), "finish").when(any_of(RINGS), "ring").when(any_of(ANSWERS), "answer")


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def merged(sessions: list[tuple], gap: int) -> list[tuple]:
    """Sessions no further apart than ``gap`` as one; rows as in the state, in order of time."""
    out: list[tuple] = []
    for s in sorted(sessions, key=lambda s: s[:2]):
        if out and s[0] - out[-1][1] <= gap:
            o = out[-1]
            out[-1] = (o[0], max(o[1], s[1]), o[2] + s[2], _least(o[3], s[3]), _least(o[4], s[4]), _least(o[5], s[5]), o[6] or s[6])
        else:
            out.append(s)
    return out


def unanswered(s: tuple, wait: int) -> bool:
    """Whether a session rang and was neither answered nor ended within ``wait``."""
    return s[3] is not None and not any(t is not None and t <= s[3] + wait for t in s[4:6])


class CallWatch(StatefulProcessor):
    """Findings of one call key: ``NO_ANSWER`` when the wait is over, ``CLOSED`` when the gap is. Times are microseconds."""

    def __init__(self, wait: int, gap: int):
        self.wait, self.gap = wait, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _STATE)

    def _timers(self, sessions: list[tuple]) -> None:
        for s in sessions:
            self.handle.registerTimer((s[1] + self.gap) // 1000 + 1)
            if not s[6] and unanswered(s, self.wait):
                self.handle.registerTimer((s[3] + self.wait) // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mine = [tuple(None if v is None or v != v else v for v in s) for s in self.open.get()] if self.open.exists() else []
        for part in rows:
            for us, what in zip(part["us"].tolist(), part["sign"].tolist(), strict=True):
                mine.append((us, us, 1, *(us if what == name else None for name in ("ring", "answer", "finish")), False))
            mine = merged(mine, self.gap)
        self.open.put(mine)
        self._timers(mine)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        out, left = [], []
        for s in ([tuple(None if v is None or v != v else v for v in x) for x in self.open.get()] if self.open.exists() else []):
            over = s[1] + self.gap < now
            if not s[6] and unanswered(s, self.wait) and (over or s[3] + self.wait < now):
                out.append((key[0], "NO_ANSWER", s[3] + self.wait, *s[:6]))
                s = (*s[:6], True)
            if over:
                out.append((key[0], "CLOSED", s[1] + self.gap, *s[:6]))
            else:
                left.append(s)
        if left:
            self.open.put(left)
        elif self.open.exists():
            self.open.clear()
        if not out:
            return iter([])
        names = [f.split()[0] for f in FINDINGS.split(", ")]
        found = pd.DataFrame(out, columns=names).astype({n: "Int64" for n in names[2:]})
        return iter([found])

    def close(self) -> None:
        pass


def call_findings(events: DataFrame, key: str = "call_id", message: str = "message_type", wait: float = 60.0, gap: float = 45.0, late: str = "2 minutes") -> DataFrame:
    """Findings of a stream of events: ``(key, kind, at, start, end, events, ring, answer, finish)``, times in microseconds. ``wait`` and ``gap`` are
    seconds. The query needs Spark's RocksDB state store, which :func:`watch` starts it with. Events without key or time are left out.

    ``start``, ``end`` and the other facts of a ``NO_ANSWER`` are as known when it is told.
    """
    x = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    x = x.select(F.col(key).cast("string").alias("key"), "ts", F.unix_micros("ts").alias("us"), sign(F.col(message)).alias("sign"))
    return x.groupBy("key").transformWithStateInPandas(CallWatch(int(wait * 1e6), int(gap * 1e6)), FINDINGS, "Append", "EventTime")


@contextlib.contextmanager
def _state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def watch(events: DataFrame, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Write the findings of a stream as Parquet; a query started again from its checkpoint goes on with the calls it held. ``trigger``: as of ``writeStream``."""
    trigger = options.pop("trigger", {"availableNow": True})
    with _state_store(events.sparkSession):
        return call_findings(events, **options).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()


def session_findings(events: DataFrame, key: str = "call_id", message: str = "message_type", wait: float = 60.0, gap: float = 45.0) -> DataFrame:
    """The same of a whole table: ``(key, kind, at, start)`` of all sessions."""
    us, far, long_wait = F.unix_micros("ts"), int(gap * 1e6), int(wait * 1e6)
    x = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(F.col(key).cast("string").alias("key"), us.alias("us"), sign(F.col(message)).alias("sign"))
    w = Window.partitionBy("key").orderBy("us")
    x = x.withColumn("new", F.coalesce((F.col("us") - F.lag("us").over(w) > far).cast("int"), F.lit(1)))
    x = x.withColumn("session", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    first = lambda name: F.min(F.when(F.col("sign") == name, F.col("us"))).alias(name)
    s = x.groupBy("key", "session").agg(F.min("us").alias("start"), F.max("us").alias("end"), F.count("*").alias("events"), first("ring"), first("answer"), first("finish"))
    silent = F.col("ring").isNotNull() & ~F.coalesce(F.least("answer", "finish") <= F.col("ring") + long_wait, F.lit(False))
    told = F.filter(
        F.array(F.when(silent, F.struct(F.lit("NO_ANSWER").alias("kind"), (F.col("ring") + long_wait).alias("at"))), F.struct(F.lit("CLOSED").alias("kind"), (F.col("end") + far).alias("at"))), lambda v: v.isNotNull()
    )
    return s.select("key", F.explode(told).alias("t"), "start", "end", "events", "ring", "answer", "finish").select("key", "t.kind", "t.at", "start", "end", "events", "ring", "answer", "finish")
