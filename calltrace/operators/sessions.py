"""Joins and summaries over sessions: scoped events, simultaneous calls, counts, statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from calltrace.functions.columns import display_duration, display_time


def scoped_events(events: DataFrame, links: DataFrame, bounds: DataFrame, seconds: int = 30, key: str = "session_id", event: str = "event_id", ts: str = "ts") -> DataFrame:
    """``(key, event, own)``: a session's events, and those of no session inside its bounds widened by ``seconds``.

    Time is cut into slots on levels of doubling width. A session takes the slots that fill it, short ones at its ends, long ones between (at most some
    200 however long it is), and all events of such a slot are its own; those of the minutes that it begins and ends in are compared. An event is looked
    up once on each level. A slot's sessions meet its events as lists of :data:`LIST`, so a pair costs one step of a loop, and slots of an hour, not sizes
    in bytes, make the tasks. A list comes out once for each session, one after the other, so that columns of the pairs repeat and files of them take little room.
    """
    own = links.select(key, event).withColumn("own", F.lit(True))
    free = events.join(links.select(event), event, "left_anti").where(F.col(ts).isNotNull())
    width, pad, full = 60_000_000, int(seconds * 1e6), 6
    spans = bounds.where("start_time IS NOT NULL AND end_time IS NOT NULL").select(key, (F.unix_micros("start_time") - pad).alias("lo"), (F.unix_micros("end_time") + pad).alias("hi"))
    minute = lambda t: F.floor(t / F.lit(width))
    # the highest level's slots are as long as an hour, or a 64th of a longer session
    top = F.greatest(F.lit(full), F.ceil(F.log2(F.greatest(F.lit(1), F.col("hi") - F.col("lo")) / width)) - full).cast("int")
    spans = spans.where("lo <= hi").withColumns({"top": top, "first": minute(F.col("lo")), "last": minute(F.col("hi"))})
    size = spans.agg(F.count("*").alias("n"), F.max("top").alias("top"), F.min("first").alias("first"), F.max("last").alias("last")).first()  # one row
    if not size.n:
        return own
    tasks = max(1, min(2000, (size.last - size.first >> full) + 1, size.n // 100))
    edges = F.transform(F.array_distinct(F.array("first", "last")), lambda m: F.struct(F.lit(-1).alias("level"), m.alias("slot")))
    inner = [_slots(level, F.col("first") + 1, F.col("last"), F.col("top")) for level in range(size.top + 1)]
    spans = spans.select(key, "lo", "hi", F.inline(F.concat(edges, *inner))).repartition(tasks, "level", "slot")
    free = free.select(event, F.unix_micros(F.col(ts)).alias("t"), F.explode(F.sequence(F.lit(-1), F.lit(size.top))).alias("level"))
    free = free.withColumn("slot", F.expr(f"shiftright(cast(floor(t / {width}) as bigint), greatest(level, 0))"))
    free = free.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("level", "slot").orderBy("t")) - 1) / LIST)).groupBy("level", "slot", "part")
    free = free.agg(F.sort_array(F.collect_list(F.struct("t", event))).alias("events")).repartition(tasks, "level", "slot")
    near = free.join(spans.hint("merge"), ["level", "slot"]).select("level", "lo", "hi", key, F.explode("events").alias("e")).where("level >= 0 OR e.t BETWEEN lo AND hi")
    return own.unionByName(near.select(key, F.col("e").getField(event).alias(event), F.lit(False).alias("own")))


#: Events in one list of :func:`scoped_events`: as many as a run of packed values of a Parquet page holds, so that its runs are alike for each session.
LIST = 504


def _slots(level: int, first: Column, end: Column, top: Column) -> Column:
    """The slots of a level among those that fill the minutes from ``first`` to before ``end``: one at each side at most, all of them on level ``top``."""
    a, b = F.shiftright(first + ((1 << level) - 1), level), F.shiftright(end, level)
    slot = lambda x: F.struct(F.lit(level).alias("level"), x.alias("slot"))
    none = F.array().cast("array<struct<level:int,slot:bigint>>")
    sides = F.concat(F.when(a % 2 != 0, F.array(slot(a))).otherwise(none), F.when(b % 2 != 0, F.array(slot(b - 1))).otherwise(none))
    return F.when((a >= b) | (top < level), none).when(top == level, F.transform(F.sequence(a, F.greatest(a, b - 1)), slot)).otherwise(sides)


def simultaneous(sessions: DataFrame, seconds: float = 5.0, key: str = "session_id", start: str = "start_time") -> DataFrame:
    """``(a, b, delta)``: pairs of sessions whose starts lie at most ``seconds`` apart, by buckets and their neighbours."""
    x = sessions.where(F.col(start).isNotNull()).select(F.col(key).alias("a"), (F.unix_micros(start) / 1e6).alias("ta")).withColumn("bucket", F.floor(F.col("ta") / seconds))
    y = x.select(F.col("a").alias("b"), F.col("ta").alias("tb"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    return x.join(y, "bucket").where((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) <= seconds)).select("a", "b", F.round(F.abs(F.col("ta") - F.col("tb")), 3).alias("delta"))


def simultaneous_counts(sessions: DataFrame, seconds: float = 5.0, key: str = "session_id", start: str = "start_time") -> DataFrame:
    """``(key, n, nearest)``: how many other sessions start at most ``seconds`` away, and how far the nearest of all lies that does.

    In place of the pairs, whose number grows with the square of a busy moment. Stretches of an hour are counted by themselves, with
    the edges of their neighbours.
    """
    width = max(3600.0, 4 * seconds)
    x = sessions.where(F.col(start).isNotNull()).select(F.col(key), (F.unix_micros(start)).alias("t"))
    span = F.lit(int(seconds * 1e6))
    part = lambda c: F.floor(c / (width * 1e6))
    own = part(F.col("t"))
    x = x.select("*", own.alias("own"), F.explode(F.array_distinct(F.array(part(F.col("t") - span), own, part(F.col("t") + span)))).alias("part"))
    w = Window.partitionBy("part").orderBy("t")
    near = w.rangeBetween(-int(seconds * 1e6), int(seconds * 1e6))
    gaps = F.least(F.col("t") - F.lag("t").over(w), F.lead("t").over(w) - F.col("t"))
    x = x.withColumns({"n": F.count("*").over(near) - 1, "gap": gaps}).where("part = own")
    return x.select(key, "n", F.when(F.col("n") > 0, F.round(F.col("gap") / 1e6, 3)).alias("nearest"))


def _told(other: str) -> Column:
    return F.concat(F.lit("Simultaneous call "), F.col(other).cast("string"), F.lit(" active within "))


def simultaneous_notes(pairs: DataFrame) -> DataFrame:
    """``(session_id, notes)`` for both sides of each pair."""
    note = lambda other: F.concat(_told(other), F.format_string("%.1fs.", "delta")).alias("n")
    both = pairs.select(F.col("a").alias("session_id"), note("b")).unionByName(pairs.select(F.col("b").alias("session_id"), note("a")))
    return both.groupBy("session_id").agg(F.array_sort(F.collect_list("n")).alias("notes"))


def noted(sessions: DataFrame, seconds: float = 5.0, key: str = "session_id", start: str = "start_time") -> DataFrame:
    """:func:`simultaneous_notes` of the pairs of :func:`simultaneous`, which are neither shuffled nor sorted as rows: the sessions of a bucket meet the starts of it and the two beside it
    as lists, and :data:`BLOCK` pairs at once are made there. Lists are in the order of their texts, so notes are nearly sorted when they are made."""
    spark, rows = sessions.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= 512:
        spark.conf.set(rows, "512")  # a row is a bucket with its lists
    x = sessions.where(F.col(start).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("a"), (F.unix_micros(start) / 1e6).alias("ta")).withColumn("bucket", F.floor(F.col("ta") / seconds))
    y = x.select(F.struct(_told("a").alias("text"), F.col("ta").alias("tb")).alias("other"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    own = x.groupBy("bucket").agg(F.collect_list(F.struct("a", "ta", _told("a").alias("told"))).alias("own"))
    others = y.groupBy("bucket").agg(F.sort_array(F.collect_list("other")).alias("others"))
    met = own.join(others.hint("merge"), "bucket").select("own.a", "own.ta", "own.told", "others.text", "others.tb")
    notes = met.mapInArrow(_notes(seconds, BLOCK), StructType([StructField("session_id", x.schema["a"].dataType), StructField("notes", ArrayType(StringType()))]))
    return notes.select("session_id", F.sort_array("notes").alias("notes"))


#: Pairs of sessions that a task of :func:`noted` holds at once.
BLOCK = 500_000


def _notes(seconds: float, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = pa.array([f"{t // 10}.{t % 10}s." for t in range(int(seconds * 10) + 2)])
        for batch in batches:
            for i in range(batch.num_rows):
                a, ta, told, text, tb = (batch.column(c)[i].values for c in ("a", "ta", "told", "text", "tb"))
                ta, tb, names = ta.to_numpy(), tb.to_numpy(), text.unique()
                me, them = (pc.index_in(c, value_set=names).to_numpy() for c in (told, text))
                step = max(1, block // len(tb))
                for k in range(0, len(ta), step):
                    gap = np.abs(ta[k : k + step, None] - tb)
                    near = (gap <= seconds) & (me[k : k + step, None] != them)
                    # halves up, to three places and then to one
                    tenths = (np.floor(gap[near] * 1000 + 0.5).astype(np.int64) + 50) // 100
                    notes = pc.binary_join_element_wise(text.take(pa.array(near.nonzero()[1])), said.take(pa.array(tenths)), "")
                    n = near.sum(1)
                    some = n.nonzero()[0]
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, n[some].cumsum()), pa.int32()), notes)
                    yield pa.RecordBatch.from_arrays([a.take(pa.array(some + k)), lists], ["session_id", "notes"])

    return run


def number_pairs(left: DataFrame, right: DataFrame, a: str = "calling_number", b: str = "calling_number") -> DataFrame:
    """Rows of two tables whose party numbers match, found by equal text or the last seven digits."""
    from calltrace.operators.scored import digits, numbers_match

    keys = lambda c: F.array_distinct(F.filter(F.array(F.lower(F.btrim(F.col(c))), digits(F.col(c)), F.when(F.length(digits(F.col(c))) >= 7, F.right(digits(F.col(c)), F.lit(7)))), lambda k: k.isNotNull() & (k != "")))
    x, y = left.withColumn("_k", F.explode(keys(a))).alias("l"), right.withColumn("_k", F.explode(keys(b))).alias("r")
    out = x.join(y, F.col("l._k") == F.col("r._k")).where(numbers_match(F.col(f"l.{a}"), F.col(f"r.{b}")))
    return out.select(F.struct(*[F.col(f"l.{c}") for c in left.columns]).alias("left"), F.struct(*[F.col(f"r.{c}") for c in right.columns]).alias("right")).distinct()


def protocol_counts(events: DataFrame, key: str, protocols: tuple[str, ...] = ("ISDN", "MGCP", "SIP", "CUCM"), column: str = "protocol") -> DataFrame:
    """A count per protocol and key, zero-filled."""
    return events.groupBy(key).agg(*[F.count_if(F.col(column) == p).alias(p.lower().replace(" ", "_")) for p in protocols])


def summaries(events: DataFrame, key: str = "session_id", order: tuple[str, ...] = ("ts",), name: str = "message_type") -> DataFrame:
    """One row per key: bounds, duration, count, first and last message, distinct messages."""
    at = F.struct(*order)
    return events.groupBy(key).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.greatest(F.lit(0.0), F.round((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6, 3)).alias("duration_seconds"), F.count("*").alias("event_count"),
        F.min_by(name, at).alias("first_message"), F.max_by(name, at).alias("last_message"), F.count_distinct(name).alias("distinct_messages"),
    )


def session_summaries(built: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The 25 summary fields of each row of :func:`scored.build_sessions`; ``found``: anomalies with a ``session_id``. Names, some of them twice, are fixed values."""
    n = found.groupBy("session_id").agg(F.count("*").alias("_n")) if found is not None else built.select("session_id", F.lit(0).cast("long").alias("_n"))
    x = built.join(n, "session_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    number = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown"))
    start, end = display_time(F.col("start_time"), fallback="Unknown"), display_time(F.col("end_time"), fallback="Unknown")
    known = F.col("start_time").isNotNull() & F.col("end_time").isNotNull()
    named = F.array_join(F.array_sort(F.filter(F.array(*[F.when(F.col(p.lower()) > 0, p) for p in ("ISDN", "MGCP", "SIP", "CUCM")]), lambda p: p.isNotNull())), ", ")
    sources = F.coalesce(F.nullif(F.array_join("trace_sources", ", "), F.lit("")), F.lit("N/A"))
    return x.select(
        "session_id", F.col("session_id").alias("call_id"), "architecture", number("calling_number").alias("calling"), number("calling_number").alias("calling_number"), number("called_number").alias("called"), number("called_number").alias("called_number"),
        start.alias("start"), start.alias("start_time_ist"), end.alias("end"), end.alias("end_time_ist"), display_duration(F.when(known, F.col("duration_seconds"))).alias("duration"), F.coalesce("duration_seconds", F.lit(0.0)).alias("duration_seconds"), named.alias("protocols"),
        sources.alias("trace_sources"), "confidence_level", "isdn", "mgcp", "sip", "cucm", "event_count", F.format_string("%d%%", F.floor(F.col("correlation_confidence") * 100).cast("long")).alias("confidence"), F.col("_n").cast("long").alias("anomalies"),
        F.when(F.col("_n") > 0, "Anomalous").otherwise("Normal").alias("status"), F.size("ambiguity_notes").cast("long").alias("ambiguities"),
    )


def distinct_messages(events: DataFrame, group: str = "protocol", name: str = "message_type", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """``(group, messages)``: distinct messages in the order they are first seen."""
    first = events.where(F.col(name).isNotNull()).groupBy(group, name).agg(F.min(F.struct(*order)).alias("at"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", name))), lambda m: m[name]).alias("messages"))


def statistics(events: DataFrame, links: DataFrame, pairs: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """One row: totals of events by protocol, assigned and not, sessions, ambiguous pairs, lines."""
    one = events.agg(F.count("*").alias("total_events"), *[F.count_if(F.col("protocol") == p).alias(f"{p.lower()}_events") for p in ("ISDN", "SIP", "MGCP", "CUCM")], F.count_distinct("source").alias("source_files"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))
    two = links.agg(F.count_distinct("session_id").alias("correlated_calls"), F.count_distinct("event_id").alias("events_assigned_to_calls"))
    out = one.join(two)  # one row each
    if pairs is not None:
        out = out.join(pairs.agg(F.count("*").alias("potentially_ambiguous")))
    if lines is not None:
        out = out.join(lines.agg(F.count("*").alias("raw_lines")))
    return out.withColumn("events_not_assigned", F.col("total_events") - F.col("events_assigned_to_calls"))


def bye_confirmed(events: DataFrame, key: str, order: str, name: str = "message_type") -> DataFrame:
    """``(key, has_bye, bye_ok)``: whether a 200 OK follows a session's first BYE."""
    bye, ok = F.col(name) == "BYE", F.col(name).contains("200 OK")
    g = events.groupBy(key).agg(F.min(F.when(bye, F.col(order))).alias("b"), F.max(F.when(ok, F.col(order))).alias("o"))
    return g.select(key, F.col("b").isNotNull().alias("has_bye"), F.coalesce(F.col("o") > F.col("b"), F.lit(False)).alias("bye_ok"))


def files_in_window(files: DataFrame, start, end, modified: str = "modified", node: str | None = None, tie: str = "filename") -> DataFrame:
    """Files modified inside the window, and the last file before it whose successor is not before it, newest first."""
    m = F.col(modified)
    # per node (or in all) one row: the last file before the window, and whether any file follows it
    edge = files.groupBy(*([node] if node else [])).agg(F.max(F.when(m < F.lit(start), F.struct(modified, tie))).alias("_last"), F.max(m).alias("_newest"))
    x = files.join(edge.withColumnRenamed(node, "_node"), F.col(node).eqNullSafe(F.col("_node"))) if node else files.join(F.broadcast(edge))  # one row
    before = F.coalesce((F.struct(modified, tie) == F.col("_last")) & (F.col("_newest") >= F.lit(start)), F.lit(False))
    return x.where(m.between(F.lit(start), F.lit(end)) | before).select(*files.columns).orderBy(F.desc(modified), tie)


#: Relative windows by name, in minutes. Fixed values.
RELATIVE = {"Last 5 minutes": 5, "Last 15 minutes": 15, "Last 30 minutes": 30, "Last 1 hour": 60, "Last 2 hours": 120, "Last 4 hours": 240, "Last 8 hours": 480, "Last 12 hours": 720, "Last 24 hours": 1440, "Last 7 days": 10080}


def window_of(mode: str, now, start=None, end=None):
    """``(start, end)`` of a selection: a name of :data:`RELATIVE`, ``latest`` (a year) or ``custom``."""
    from datetime import timedelta

    if mode == "latest":
        return now - timedelta(days=365), now
    if mode == "custom":
        if start is None or end is None or start >= end:
            raise ValueError("a custom window needs a start before its end")
        if end > now:
            raise ValueError("a custom window may not end in the future")
        return start, end
    return now - timedelta(minutes=RELATIVE[mode]), now


def selection_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"), F.round(F.coalesce(F.sum("size_bytes"), F.lit(0)) / 1048576, 2).alias("size_mb"))
