"""Linking events into calls by shared identifiers and by party numbers close in time.

Works on any event table with an id, a time and key columns. Keys become star edges to their first holder and number pairs
become edges between neighbours in time, so no pairs of a hot key are made; calls are the connected components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltrace.functions.columns import has_any
from calltrace.functions.work import materialize
from calltrace.operators.components import connected_components

#: Key kind to column.
SDL_KEYS = {"CI": "ci", "CDCC": "cdcc", "Call-ID": "call_id", "ccbID": "ccb_id", "tcpHandle": "tcp_handle", "AppCorr": "app_corr"}
#: Fixed values.
VOICE_WORDS = ("setup", "invite", "alert", "ringing", "connect", "ack", "bye", "disconnect", "release", "crcx", "mdcx", "dlcx", "ntfy", "rqnt", "mgcp", "sip", "station", "digit", "cc")
VOICE_PROTOCOLS = ("SIP", "Q931", "MGCP", "SCCP")


def key_rows(events: DataFrame, keys: dict[str, str], node: str = "event_id") -> DataFrame:
    """``(node, kind, value)`` of non-empty keys; an AppCorr of 0 is none."""
    values = [F.struct(F.lit(k).alias("kind"), F.btrim(F.col(c).cast("string")).alias("value")) for k, c in keys.items() if c in events.columns]
    values = values or [F.struct(F.lit("").alias("kind"), F.lit("").alias("value"))]
    rows = events.select(F.col(node).alias("node"), F.explode(F.array(*values)).alias("k")).select("node", "k.kind", "k.value")
    return rows.where("value <> '' AND NOT (kind = 'AppCorr' AND value = '0')")


def key_edges(events: DataFrame, keys: dict[str, str], node: str = "event_id") -> DataFrame:
    """Edges from each holder of a key to its smallest one. Keys are written, as making them may cost more than reading them twice."""
    rows = materialize(key_rows(events, keys, node), "keys")
    first = rows.groupBy("kind", "value").agg(F.min("node").alias("dst"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, ["kind", "value"]).where("node <> dst").select(F.col("node").alias("src"), "dst", F.concat_ws("=", "kind", "value").alias("reason"))


def proximity_edges(events: DataFrame, seconds: float = 30.0, node: str = "event_id", ts: str = "ts", calling: str = "calling_number", called: str = "called_number") -> DataFrame:
    """Edges between events next to each other in time that share both party numbers, at most ``seconds`` apart.

    All pairs within the gap need no edges: the events between them link them. A number pair's events are ordered within stretches of
    time, and the last event of each stretch is handed to the next, so a pair that calls all day is not in one task.
    """
    width = max(3600.0, 10 * seconds)
    rows = events.where(F.col(calling).isNotNull() & F.col(called).isNotNull()).select(F.col(node).alias("n"), F.col(ts).alias("t"), F.btrim(calling).alias("a"), F.btrim(called).alias("b"))
    rows = rows.withColumn("part", F.floor(F.unix_micros("t") / (width * 1e6)))
    me = F.struct("t", "n")
    w = Window.partitionBy("a", "b", "part").orderBy("t", "n")
    inside = rows.withColumn("p", F.lag(me).over(w))
    ends = rows.groupBy("a", "b", "part").agg(F.max(me).alias("last")).withColumn("p", F.lag("last").over(Window.partitionBy("a", "b").orderBy("part")))
    firsts = inside.where("p IS NULL").drop("p").join(ends.select("a", "b", "part", "p"), ["a", "b", "part"]).where("p IS NOT NULL")
    both = inside.where("p IS NOT NULL").unionByName(firsts)
    gap = (F.unix_micros("t") - F.unix_micros("p.t")) / 1e6
    both = both.withColumn("gap", gap).where(F.col("gap") <= seconds)
    return both.select(F.col("n").alias("src"), F.col("p.n").alias("dst"), F.format_string("number pair %s->%s (gap %.2fs)", "a", "b", "gap").alias("reason"))


def link_events(events: DataFrame, keys: dict[str, str] | None = None, seconds: float | None = 30.0, node: str = "event_id", **columns) -> DataFrame:
    """``(event_id, call_key)`` for every event: connected components, named by their smallest event."""
    edges = key_edges(events, SDL_KEYS if keys is None else keys, node)
    if seconds is not None:
        edges = edges.unionByName(proximity_edges(events, seconds, node, **columns))
    parts = connected_components(edges.select("src", "dst"))
    return events.select(F.col(node)).join(parts, F.col(node) == F.col("node"), "left").select(node, F.coalesce("component", node).alias("call_key"))


def link_reasons(events: DataFrame, keys: dict[str, str] | None = None, seconds: float = 30.0, node: str = "event_id") -> DataFrame:
    """``(event_id, reasons)``: why each event was linked."""
    edges = key_edges(events, SDL_KEYS if keys is None else keys, node).unionByName(proximity_edges(events, seconds, node))
    return edges.groupBy(F.col("src").alias(node)).agg(F.array_sort(F.collect_set(F.concat(F.lit("Linked via "), "reason"))).alias("reasons"))


def call_related(events: DataFrame, key: str = "call_key") -> DataFrame:
    """The events of clusters that hold a number, a CI, a Call-ID, a voice word or a voice protocol; timers alone are noise."""
    some = F.coalesce("calling_number", "called_number", "ci", "call_id").isNotNull() | has_any(F.lower("signal"), VOICE_WORDS) | F.col("protocol").isin(*VOICE_PROTOCOLS)
    kept = events.groupBy(key).agg(F.max(some).alias("ok")).where("ok").select(key)
    return events.join(kept, key, "left_semi")


def first_in_order(value: Column, *order: str) -> Column:
    """The first non-null value by the order columns."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct(*order)))


def build_calls(events: DataFrame, key: str = "call_key", order: tuple[str, ...] = ("ts", "source_file", "source_line")) -> DataFrame:
    """One row per call of call-related events with ``call_key``: bounds, sets, first identifiers and numbers in time order."""
    names = ("call_id", "ci", "cdcc", "calling_number", "called_number")
    sets = {"nodes": "node", "devices": "device", "protocols": "protocol"}
    out = call_related(events, key).groupBy(key).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("event_count"), *[first_in_order(F.col(c), *order).alias(c) for c in names],
        *[F.array_sort(F.collect_set(c)).alias(k) for k, c in sets.items()], F.array_sort(F.collect_set("ccb_id")).alias("ccb_ids"), F.array_sort(F.collect_set("source_file")).alias("source_files"),
        F.min("source_line").alias("min_line"), F.max("source_line").alias("max_line"),
    )
    reason = (
        F.when(F.col("ci").isNotNull(), F.concat(F.lit("Correlated by CUCM Call Identification CI="), "ci"))
        .when(F.col("call_id").isNotNull(), F.concat(F.lit("Correlated by SIP Call-ID="), "call_id"))
        .when(F.col("calling_number").isNotNull() & F.col("called_number").isNotNull(), F.concat(F.lit("Correlated by party numbers "), "calling_number", F.lit(" -> "), "called_number"))
        .otherwise("Correlated by signaling continuity")
    )
    pairs = [F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (("CI", "ci"), ("CDCC", "cdcc"), ("Call-ID", "call_id"))]
    found = F.concat(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()), F.transform("ccb_ids", lambda v: F.struct(F.lit("ccbID").alias("key"), v.alias("value"))))
    return out.withColumns({"correlation_reasons": F.array(reason), "identifiers": found, "duration_seconds": F.round((F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e6, 3)})


def correlate_sdl(events: DataFrame, seconds: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """``(calls, events with call_key)`` of ``sdl_events``."""
    linked = events.join(link_events(events, None, seconds), "event_id")
    return build_calls(linked), call_related(linked)
