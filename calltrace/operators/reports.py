"""Views and reports of sessions: lookups, listing totals, evidence packs, findings, summaries, texts to read.

``events`` are ``voice_events`` with a session key, ``sessions`` come from :func:`calltrace.operators.scored.build_sessions`. Lists of a
session's events hold what a reader needs of each event, not its raw text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltrace.functions.columns import display_duration, display_time

ORDER = ("ts", "source", "seq_in_source")
PROTOCOLS = ("ISDN", "MGCP", "SIP", "CUCM")


def by_id(rows: DataFrame, value: str, key: str = "session_id") -> DataFrame:
    """The session or event of one id."""
    return rows.where(F.col(key) == value)


def listing_totals(listing: DataFrame, kind: str = "trace_type") -> DataFrame:
    """``(trace_type, n, size_bytes)`` of parsed listings."""
    return listing.groupBy(kind).agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))


def files_by_protocol(events: DataFrame, key: str = "session_id") -> DataFrame:
    """Per session the trace files of each protocol, sorted; call-manager records count by their trace type too."""
    p, source = F.col("protocol"), F.nullif("source", F.lit(""))
    own = {n: p == n for n in ("ISDN", "SIP", "MGCP")} | {"CUCM": (p == "CUCM") | F.coalesce(F.col("trace_type") == "CUCM_SDL", F.lit(False))}
    return events.groupBy(key).agg(*[F.array_sort(F.collect_set(F.when(c, source))).alias(f"{n.lower()}_files") for n, c in own.items()])


def session_packs(sessions: DataFrame, events: DataFrame, found: DataFrame, key: str = "session_id") -> DataFrame:
    """One row per session: timeline, events by protocol, anomalies, messages that are missing, identifiers, why it was correlated."""
    at = F.struct(F.col("ts").isNull().alias("late"), *ORDER)
    line = F.struct(at.alias("at"), F.struct("event_id", "ts", "protocol", "direction", "message_type", "calling_number", "called_number", "source", F.col("seq_in_source").alias("line")).alias("e"))
    timeline = events.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["e"]).alias("timeline"))
    counts = events.groupBy(key, "protocol").agg(F.count("*").alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("protocol", "n")))).alias("protocol_summaries"))
    a = found.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("ts", "category", "protocol", "severity", "description"))).alias("anomalies"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("expected_message").isNotNull(), F.struct("ts", "expected_message")))), lambda x: x["expected_message"]).alias("missing_expected_messages"),
    )
    names = {"calling_party": "calling_number", "called_party": "called_number"} | {c: c for c in ("isdn_call_references", "sip_call_ids", "mgcp_call_ids", "mgcp_transaction_ids", "mgcp_connection_ids", "endpoints", "devices") if c in sessions.columns}
    head = sessions.select(key, "architecture", "correlation_evidence", F.struct(*[F.col(c).alias(k) for k, c in names.items()]).alias("important_identifiers"))
    out = head.join(timeline, key, "left").join(counts, key, "left").join(a, key, "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({"missing_expected_messages": F.coalesce("missing_expected_messages", empty), "correlation_evidence": F.coalesce("correlation_evidence", empty)})


def findings(found: DataFrame, key: str = "session_id") -> DataFrame:
    """Anomalies as a report lists them, a row each."""
    cited = F.when(F.size("evidence_event_ids") > 0, F.array_join("evidence_event_ids", ", ")).otherwise(F.col("description"))
    return found.select(
        key, "severity", display_time(F.col("ts"), fallback="N/A").alias("timestamp"), "protocol", "description", cited.alias("evidence"), F.concat("protocol", F.lit(" Call Leg")).alias("likely_location"), F.lit("High").alias("confidence")
    )


def reasoning(sessions: DataFrame, arch: DataFrame, latencies: DataFrame, found: DataFrame, key: str = "session_id") -> DataFrame:
    """Per session what is seen, what ties it together, what follows from it and what is only possible, as four lists."""
    slow = latencies.where("is_suspicious").groupBy(key).agg(F.count("*").alias("_slow"))
    at = F.struct("ts", "description")
    f = found.groupBy(key).agg(F.count("*").alias("_n"), F.min_by(F.struct("ts", "description"), F.when(F.col("severity") == "ERROR", at)).alias("_error"))
    x = sessions.select(key, "event_count", F.size("trace_sources").alias("_files"), "correlation_evidence").join(arch.select(key, "has_isdn", "has_mgcp", "has_sip", "has_cucm_sdl"), key, "left").join(slow, key, "left").join(f, key, "left")
    kept = lambda *items: F.filter(F.array(*items), lambda v: v.isNotNull())
    seen = kept(
        F.format_string("%d events in %d trace files", "event_count", "_files"), *[F.when(F.col(c), F.lit(t)) for c, t in (("has_isdn", "ISDN Q.931 frames on a primary rate interface"), ("has_mgcp", "MGCP commands between gateway and call manager"), ("has_sip", "SIP dialogs with endpoints"), ("has_cucm_sdl", "internal signals of the call manager"))],
        F.when(F.col("_error").isNotNull(), F.format_string("anomaly at %s: %s", display_time(F.col("_error.ts"), fallback="N/A"), "_error.description")),
    )
    follows = kept(F.when(F.col("has_isdn") & F.col("has_mgcp"), F.lit("the call came in over a gateway that the call manager controls by MGCP")), F.when(F.col("_slow") > 0, F.format_string("%d stages took longer than they should", "_slow")))
    possible = kept(F.when((F.coalesce("_n", F.lit(0)) > 0) & F.col("_error").isNull(), F.lit("a slow network or an endpoint that did not answer")))
    return x.select(key, seen.alias("facts"), F.coalesce("correlation_evidence", F.array().cast("array<string>")).alias("correlations"), follows.alias("inferences"), possible.alias("hypotheses"))


def summary(sessions: DataFrame, arch: DataFrame, found: DataFrame, key: str = "session_id") -> DataFrame:
    """``(key, text)``: a session in a few sentences."""
    f = found.groupBy(key).agg(F.count("*").alias("_n"), F.min_by("description", F.struct("ts", "description")).alias("_first"))
    x = sessions.join(arch.select(key, "architecture_name"), key, "left").join(f, key, "left")
    rest = F.when(F.coalesce("_n", F.lit(0)) == 0, F.lit("No anomaly was found.")).otherwise(F.format_string("%d anomalies were found, the first of them: %s", "_n", "_first"))
    return x.select(key, F.concat(F.format_string("%d signaling events over the path %s. ", "event_count", F.coalesce("architecture_name", F.lit("UNKNOWN"))), rest).alias("text"))


def cross_protocol_text(sessions: DataFrame, events: DataFrame, first: int = 15, key: str = "session_id") -> DataFrame:
    """``(key, text)``: the first events of all protocols in order, and what ties them into one call."""
    w = Window.partitionBy(key).orderBy(F.col("ts").asc_nulls_last(), *ORDER[1:])
    x = events.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= first) & F.col("ts").isNotNull() & F.col("message_type").isNotNull())
    line = F.format_string("%s %s at %s in %s", "protocol", "message_type", F.date_format(F.from_utc_timestamp("ts", "Asia/Kolkata"), "HH:mm:ss"), "source")
    facts = x.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))), lambda v: v["line"]), "\n").alias("_facts"))
    several = lambda c, label: F.when(F.size(c) > 0, F.concat(F.lit(f"{label} "), F.array_join(c, ", ")))
    number = lambda c, label: F.when(F.coalesce(c, F.lit("Unknown")) != "Unknown", F.concat(F.lit(f"{label} "), c))
    ties = F.concat_ws("; ", several("isdn_call_references", "call reference"), several("mgcp_transaction_ids", "MGCP transaction"), several("sip_call_ids", "Call-ID"), number("calling_number", "calling number"), number("called_number", "called number"))
    tied = F.when(ties != "", F.format_string("Session %s is tied together by %s (confidence %s).", key, ties, "confidence_level")).otherwise(F.format_string("Session %s is tied together by time alone.", key))
    return sessions.join(facts, key, "left").select(key, F.concat_ws("\n\n", "_facts", tied).alias("text"))


def session_reports(sessions: DataFrame, verdicts: DataFrame, texts: dict[str, DataFrame], key: str = "session_id") -> DataFrame:
    """``(key, value)``: a markdown report per session; ``texts``: heading to ``(key, text)``, in order."""
    x = sessions.join(verdicts.select(key, "root_cause", "confidence"), key, "left")
    parts = [
        F.format_string("# Session %s", key), F.format_string("From %s to %s, %s, %s", "calling_number", "called_number", display_time(F.col("start_time")), display_duration(F.col("duration_seconds"))),
        F.concat(F.lit("## Cause\n"), F.coalesce("root_cause", F.lit("-")), F.lit("\nConfidence: "), F.coalesce("confidence", F.lit("-"))),
    ]
    for k, (heading, rows) in enumerate(texts.items()):
        x = x.join(rows.select(key, F.col("text").alias(f"_text_{k}")), key, "left")
        parts.append(F.concat(F.lit(f"## {heading}\n"), F.coalesce(f"_text_{k}", F.lit("-"))))
    return x.select(key, F.concat_ws("\n\n", *parts).alias("value"))


def chosen_session(sessions: DataFrame, session_id: str | None = None, key: str = "session_id") -> DataFrame:
    """The chosen session; the earliest one where none is chosen or the chosen one is not there."""
    rank = F.struct((F.col(key) != F.lit(session_id)).alias("other") if session_id is not None else F.lit(True).alias("other"), F.col("start_time").isNull().alias("late"), "start_time", key)
    return sessions.agg(F.min_by(F.struct(*sessions.columns), rank).alias("s")).where("s IS NOT NULL").select("s.*")


def observation_rows(observations: DataFrame) -> DataFrame:
    """Observations as a table shows them, missing values as N/A."""
    have = set(observations.columns)

    def first(*names: str, default: str = "N/A") -> Column:
        return F.coalesce(*[F.col(n).cast("string") for n in names if n in have], F.lit(default))

    return observations.select(
        first("timestamp").alias("Timestamp"), first("timestamp_ist").alias("IST Timestamp"), first("correlation_tag").alias("Correlation Tag"), first("sending_process", "process_name").alias("Sending Process"), first("receiving_process").alias("Receiving Process"),
        first("signal", "event_name").alias("Signal"), first("trace_type", default="SdlSig").alias("Trace Type"), first("app_name", default="CCM").alias("Application Name"), first("device").alias("Device"), first("peer_ip").alias("IP"), first("raw_evidence").alias("Raw SDL Line"),
    )


def timing_rows(latencies: DataFrame, key: str = "session_id") -> DataFrame:
    """Stage latencies as a table shows them."""
    return latencies.select(
        key, F.concat_ws(" ➔ ", "from_event", "to_event").alias("Transition"), display_time(F.col("from_time"), millis=True).alias("Start"), display_time(F.col("to_time"), millis=True).alias("End"), F.concat(F.col("delta_ms").cast("string"), F.lit(" ms")).alias("Delta"),
        F.when(F.col("is_suspicious"), "Slow").otherwise("Normal").alias("Status"), F.coalesce("note", F.lit("-")).alias("Note"),
    )


def call_rows(calls: DataFrame, key: str = "call_key") -> DataFrame:
    """Calls as a table shows them."""
    listed = lambda c, default: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit(default))
    return calls.select(
        F.col(key).alias("Call ID"), F.coalesce("calling_number", F.lit("Unknown")).alias("CALLING"), F.coalesce("called_number", F.lit("Unknown")).alias("CALLED"), display_time(F.col("start_time")).alias("TIMESTAMP IST"), listed("nodes", "-").alias("CUCM NODE"),
        listed("protocols", "CUCM").alias("PROTOCOL"), F.col("event_count").alias("EVENT COUNT"),
    )


def session_rows(sessions: DataFrame, found: DataFrame, key: str = "session_id") -> DataFrame:
    """Sessions as a table shows them, with events by protocol and anomalies counted."""
    n = found.groupBy(key).agg(F.count("*").alias("_n"))
    return sessions.join(n, key, "left").select(
        F.col(key).alias("Call ID"), F.coalesce("calling_number", F.lit("Unknown")).alias("Calling Number"), F.coalesce("called_number", F.lit("Unknown")).alias("Called Number"), display_time(F.col("start_time")).alias("Call Start Time (IST)"),
        display_time(F.col("end_time")).alias("Call End Time (IST)"), display_duration(F.col("duration_seconds")).alias("Duration"), F.col("architecture").alias("Architecture"), *[F.col(p.lower()).alias(p) for p in PROTOCOLS], F.coalesce("_n", F.lit(0)).cast("long").alias("Anomalies"),
    )


def command_package(rows: DataFrame) -> DataFrame:
    """``rows`` with ``value``, a command's output under a head of its circumstances, and ``file_name``.

    Reads ``device_type``, ``ip``, ``command``, ``status``, ``output``, ``prompt`` and ``timestamp``.
    """
    rule = lambda n: "=" * n
    command, out = F.btrim("command"), F.btrim(F.coalesce("output", F.lit("")), F.lit(" \t\r\n"))
    prompt = F.coalesce("prompt", F.lit(""))
    none = F.lit("(No output or command returned empty)")
    answer = (
        F.when((prompt != "") & (out != ""), F.when(out.startswith(prompt), out).otherwise(F.concat(prompt, command, F.lit("\n\n"), out))).when(prompt != "", F.concat(prompt, command, F.lit("\n"), none)).when(out != "", out).otherwise(none)
    )
    head = F.format_string("Device Type : %s\nDevice IP   : %s\nTimestamp   : %s\nCommand     : %s\nStatus      : %s", "device_type", "ip", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), command, "status")
    text = F.concat(F.lit(f"{rule(50)}\nDevice Command Output\n{rule(35)}\n\n"), head, F.lit(f"\n\n{rule(50)}\nREQUEST\n{rule(7)}\n\n"), command, F.lit(f"\n\n{rule(50)}\nRESPONSE\n{rule(8)}\n\n"), answer, F.lit("\n"))
    short = F.lower(F.btrim(F.regexp_replace(command, "[^a-zA-Z0-9]+", "-"), F.lit("-")))
    named = F.when(short == "", "cmd").otherwise(F.substring(short, 1, 40))
    file = F.concat_ws("_", F.upper(F.btrim("device_type")), F.regexp_replace(F.btrim("ip"), "[^a-zA-Z0-9.]+", "_"), named, F.concat(F.date_format("timestamp", "yyyyMMdd_HHmmss"), F.lit(".txt")))
    return rows.withColumns({"value": text, "file_name": file})
