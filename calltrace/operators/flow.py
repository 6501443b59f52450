"""Order within a call: steps, gaps, state machines, milestones, stage latencies, ladders.

Events need a call key, a time, a signal and, for some operators, protocol and raw text. State machines are closed forms over
windows; :mod:`calltrace.operators.machines` runs any transition table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltrace.functions.columns import has_any
from calltrace.operators.ranks import ranked

ORDER = ("ts", "source_file", "source_line")


def _windows(key: str, order: tuple[str, ...]):
    w = Window.partitionBy(key).orderBy(*order)
    return w, w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)


def steps(events: DataFrame, key: str = "call_key", order: tuple[str, ...] = ORDER, ts: str = "ts", signal: str = "signal") -> DataFrame:
    """``events`` with ``step_number``, ``time_delta_ms`` to the event before (not below 0) and ``prior_signal``."""
    w, _, _ = _windows(key, order)
    delta = F.greatest(F.lit(0.0), F.round((F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))) / 1000.0, 2))
    return events.withColumns({"step_number": F.row_number().over(w), "time_delta_ms": F.coalesce(delta, F.lit(0.0)), "prior_signal": F.lag(signal).over(w)})


def large_gaps(stepped: DataFrame, threshold_ms: float = 4000.0, key: str = "call_key", signal: str = "signal") -> DataFrame:
    return stepped.where(F.col("time_delta_ms") > threshold_ms).select(key, F.col("step_number").alias("step"), F.col("prior_signal").alias("prior_event"), F.col(signal).alias("current_event"), F.col("time_delta_ms").alias("gap_ms"), "ts")


def sip_class(signal: Column, raw: Column) -> Column:
    """The SIP machine's class of an event, in its order of tests."""
    s, r = F.upper(F.coalesce(signal, F.lit(""))), F.upper(F.coalesce(raw, F.lit("")))
    any_of = lambda *words: has_any(s, words) | has_any(r, words)
    return (
        F.when(s.contains("INVITE") | r.contains("INVITE SIP:"), "INVITE")
        .when(s.contains("100 TRYING") | r.contains("SIP/2.0 100"), "TRYING")
        .when(has_any(s, ("180 RINGING", "183 SESSION PROGRESS")) | has_any(r, ("SIP/2.0 180", "SIP/2.0 183")), "RINGING")
        .when(s.contains("200 OK") | r.contains("SIP/2.0 200 OK"), "OK")
        .when(s.contains("ACK") | r.contains("ACK SIP:"), "ACK")
        .when(s.contains("BYE") | r.contains("BYE SIP:"), "BYE")
        .when(any_of("404 NOT FOUND", "486 BUSY", "503 SERVICE", "500 SERVER", "CANCEL"), "REJECT")
    )


def q931_class(signal: Column) -> Column:
    s = F.upper(F.coalesce(signal, F.lit("")))
    return (
        F.when(s.contains("SETUP"), "SETUP")
        .when(has_any(s, ("CALL PROCEEDING", "CCPROCEEDINGIND", "CCPROCEEDINGREQ")), "PROCEEDING")
        .when(has_any(s, ("CCALERTIND", "CCALERTREQ", "ALERTING")), "ALERTING")
        .when(s.contains("DISCONNECT"), "DISCONNECT")
        .when(has_any(s, ("CCRELEASECOMPLETE", "RELEASE COMPLETE")), "COMPLETE")
        .when(s.contains("RELEASE"), "RELEASE")
        .when(s.contains("CONNECT"), "CONNECT")
    )


def mgcp_class(signal: Column, raw: Column) -> Column:
    s, r = F.upper(F.coalesce(signal, F.lit(""))), F.upper(F.coalesce(raw, F.lit("")))
    return (
        F.when(r.contains("NTFY") | s.contains("MGCPNOTIFY"), "NTFY")
        .when(r.contains("CRCX"), "CRCX")
        .when(r.contains("RQNT"), F.when(r.contains("RG") | r.contains("RING"), "RING").otherwise("RQNT"))
        .when(r.contains("MDCX"), "MDCX")
        .when(r.contains("DLCX"), "DLCX")
        .when(r.contains("200 "), "200")
    )


def _map(table: dict[str, str], col: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out


#: States each class leads to. Fixed values.
SIP_STATES = {"INVITE": "CALL_SETUP", "TRYING": "CALL_SETUP", "RINGING": "ALERTING", "OK": "CONNECT", "ACK": "ACTIVE", "BYE": "DISCONNECT", "REJECT": "CALL_END"}
Q931_STATES = {"SETUP": "CALL_SETUP", "PROCEEDING": "ROUTE_SELECTION", "ALERTING": "ALERTING", "DISCONNECT": "DISCONNECT", "COMPLETE": "CALL_END", "RELEASE": "RELEASE", "CONNECT": "ACTIVE"}
MGCP_STATES = {"CRCX": "CALL_SETUP", "RING": "ALERTING", "MDCX": "ACTIVE", "DLCX": "DISCONNECT"}
#: States a class may come from, and what is said of others. Fixed values.
SIP_FROM = {
    "INVITE": (("IDLE", "CALL_START"), "Unexpected re-INVITE or duplicate INVITE while in state %s"),
    "TRYING": (("CALL_SETUP",), "100 Trying received while in unexpected state %s"),
    "RINGING": (("CALL_SETUP",), "Alerting received outside setup phase from %s"),
    "ACK": (("CONNECT",), "ACK received in unexpected state %s"),
    "BYE": (("ACTIVE", "CONNECT", "ALERTING"), "Premature BYE received during state %s"),
}
Q931_FROM = {
    "ALERTING": (("CALL_SETUP", "ROUTE_SELECTION", "DEVICE_SELECTION"), "Alerting in unexpected state %s"),
    "CONNECT": (("ALERTING", "CALL_SETUP", "ROUTE_SELECTION"), "Connect in unexpected state %s"),
}


def machine_name(protocols: Column) -> Column:
    has = lambda *names: F.exists(protocols, lambda p: F.upper(p).isin(*names))
    return F.when(has("SIP"), "SIP").when(has("Q931", "ISDN"), "Q931").when(has("MGCP"), "MGCP").otherwise("SIP")


def _moves(events: DataFrame, machine: str, key: str, order: tuple[str, ...], signal: str, raw: str) -> tuple[DataFrame, Column, Column, Column]:
    """``events`` with working columns of a machine, and its from-state, to-state and reason."""
    w, before, upto = _windows(key, order)
    name = lambda c: f"_{machine}_{c}"
    c = F.col(name("c"))
    if machine == "MGCP":
        x = events.withColumn(name("c"), mgcp_class(F.col(signal), F.col(raw))).withColumn(name("n"), F.row_number().over(w))
        strong = _map(MGCP_STATES, c)
        n = F.col(name("n"))
        x = x.withColumns({name("s"): F.last(strong, True).over(upto), name("sn"): F.max(F.when(strong.isNotNull(), n)).over(upto), name("ok"): F.max(F.when(c == "200", n)).over(upto), name("nt"): F.max((c == "NTFY").cast("int")).over(upto)})
        s = F.col(name("s"))
        state = F.when(s.isNull(), F.when(F.col(name("nt")) == 1, "CALL_START").otherwise("IDLE")).when((s == "DISCONNECT") & (F.col(name("ok")) > F.col(name("sn"))), "CALL_END").otherwise(s)
        valid: dict = {}
    else:
        x = events.withColumn(name("c"), sip_class(F.col(signal), F.col(raw)) if machine == "SIP" else q931_class(F.col(signal)))
        to = _map(SIP_STATES if machine == "SIP" else Q931_STATES, c)
        if machine == "SIP":
            x = x.withColumn(name("p"), F.last(c, True).over(before))
            to = F.when((c == "OK") & (F.col(name("p")) == "BYE"), "CALL_END").otherwise(to)
        x = x.withColumn(name("t"), to)
        state = F.coalesce(F.last(name("t"), True).over(upto), F.lit("IDLE"))
        valid = SIP_FROM if machine == "SIP" else Q931_FROM
    x = x.withColumn(name("to"), state)
    x = x.withColumn(name("from"), F.coalesce(F.lag(name("to")).over(w), F.lit("IDLE")))
    came = F.col(name("from"))
    reason = F.lit(None).cast("string")
    for k, (allowed, text) in valid.items():
        reason = F.when((c == k) & ~came.isin(*allowed), F.format_string(text, came)).otherwise(reason)
    if machine == "SIP":
        reason = F.when(c == "REJECT", "Call rejected or cancelled").otherwise(reason)
    return x, came, F.col(name("to")), reason


def _told(x: DataFrame, names: list[str], came: Column, to: Column, reason: Column) -> DataFrame:
    valid = reason.isNull() | (reason == "Call rejected or cancelled")
    return x.select(*names, came.alias("from_state"), to.alias("to_state"), valid.alias("is_valid"), reason.alias("reason"))


def transitions(events: DataFrame, machine: str, key: str = "call_key", order: tuple[str, ...] = ORDER, signal: str = "signal", raw: str = "raw_text") -> DataFrame:
    """``events`` with ``from_state``, ``to_state``, ``is_valid`` and ``reason`` of one machine: SIP, Q931 or MGCP."""
    return _told(*(lambda x, *moves: (x, events.columns, *moves))(*_moves(events, machine, key, order, signal, raw)))


def call_transitions(events: DataFrame, key: str = "call_key", order: tuple[str, ...] = ORDER, signal: str = "signal", raw: str = "raw_text") -> DataFrame:
    """Transitions of every call by the machine that its protocols ask for; all machines run over one ordering of the events."""
    x = events.withColumn("_m", machine_name(F.collect_set("protocol").over(Window.partitionBy(key))))
    picked: list[Column | None] = [None, None, None]
    for m in ("SIP", "Q931", "MGCP"):
        x, *moves = _moves(x, m, key, order, signal, raw)
        picked = [F.when(F.col("_m") == m, v) if p is None else p.when(F.col("_m") == m, v) for p, v in zip(picked, moves, strict=True)]
    return _told(x, events.columns, *picked)


def milestones(events: DataFrame, key: str = "call_key", signal: str = "signal", strict_connect: bool = False) -> DataFrame:
    """``(key, expected, missing)`` per call. ``strict_connect``: DISCONNECT does not count as CONNECT."""
    s = F.upper(F.coalesce(F.col(signal), F.col("protocol"), F.lit("UNKNOWN")))
    has = lambda *words: F.max(has_any(s, words))
    x = events.groupBy(key).agg(
        machine_name(F.collect_set("protocol")).alias("m"), F.max(F.upper("protocol").isin("SIP", "Q931", "ISDN")).alias("known"), has("INVITE").alias("invite"), has("180", "RINGING").alias("ring"), has("200", "OK").alias("ok"),
        has("ACK").alias("ack"), has("BYE").alias("bye"), has("SETUP").alias("setup"), has("ALERT").alias("alert"), F.max(s.contains("CONNECT") & (~s.contains("DISCONNECT") if strict_connect else F.lit(True))).alias("connect"), has("DISCONNECT").alias("disc"),
    )
    sip, q931 = (F.col("m") == "SIP") & F.col("known") & F.col("invite"), (F.col("m") == "Q931") & F.col("setup")
    rules = [
        (sip & ~F.col("ring") & ~F.col("ok"), "180 Ringing (No ringback signal observed)"),
        (sip & F.col("ring") & ~F.col("ok") & ~F.col("bye"), "200 OK (Call alerted but never answered or terminated without 200 OK)"),
        (sip & F.col("ok") & ~F.col("ack"), "ACK (200 OK received without final SIP ACK)"),
        (q931 & ~F.col("alert") & ~F.col("connect"), "ALERTING (Setup initiated but no alerting received)"),
        (q931 & F.col("alert") & ~F.col("connect") & ~F.col("disc"), "CONNECT (Call alerting but no answer/connect received)"),
    ]
    lists = {"SIP": ["INVITE", "100 TRYING", "180 RINGING", "200 OK", "ACK"], "Q931": ["SETUP", "CALL PROCEEDING", "ALERTING", "CONNECT", "DISCONNECT", "RELEASE", "RELEASE COMPLETE"]}
    arr = lambda v: F.array(*map(F.lit, v))
    expected = F.when((F.col("m") == "SIP") & F.col("known"), arr(lists["SIP"])).when(F.col("m") == "Q931", arr(lists["Q931"])).otherwise(F.array().cast("array<string>"))
    return x.select(key, expected.alias("expected"), F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in rules]), lambda v: v.isNotNull()).alias("missing"))


def flow_steps(events: DataFrame, key: str = "call_key") -> DataFrame:
    """One row per step of a call: state, signal, processes, delta, summary."""
    x = steps(call_transitions(events, key), key)
    name = F.coalesce("signal", "protocol", F.lit("UNKNOWN"))
    both = F.col("calling_number").isNotNull() & F.col("called_number").isNotNull()
    summary = F.concat_ws(" ", "direction", name, F.when(both, F.format_string("(%s -> %s)", "calling_number", "called_number")))
    return x.select(
        key, "step_number", "ts", F.col("to_state").alias("state"), "from_state", "is_valid", "reason", name.alias("signal"), F.coalesce("protocol", F.lit("CUCM")).alias("protocol"), F.coalesce("direction", F.lit("INTERNAL")).alias("direction"),
        F.coalesce("sending_process", "process").alias("source_process"), F.col("receiving_process").alias("dest_process"), "time_delta_ms", summary.alias("summary"), "source_file", "source_line",
    )


def flow_reports(events: DataFrame, key: str = "call_key", gap_ms: float = 4000.0, strict_connect: bool = False) -> DataFrame:
    """One row per call: steps, observed, expected and missing events, unexpected ones, large gaps."""
    s = flow_steps(events, key)
    prior = F.lag("signal").over(Window.partitionBy(key).orderBy("step_number"))
    s = s.withColumn("_prior", prior)
    node = F.struct("step_number", "ts", "state", "signal", "protocol", "direction", "source_process", "dest_process", "time_delta_ms", "summary", "source_file", "source_line")
    gap = F.when(F.col("time_delta_ms") > gap_ms, F.struct(F.col("step_number").alias("step"), F.col("_prior").alias("prior_event"), F.col("signal").alias("current_event"), F.col("time_delta_ms").alias("gap_ms"), "ts"))
    odd = F.when(~F.col("is_valid") & F.col("reason").isNotNull(), F.struct("step_number", F.format_string("Step %d (%s): %s", "step_number", "signal", "reason").alias("text")))
    text = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda v: v["text"])
    out = s.groupBy(key).agg(
        F.array_sort(F.collect_list(node)).alias("nodes"), F.transform(F.array_sort(F.collect_list(F.struct("step_number", F.col("signal").alias("text")))), lambda v: v["text"]).alias("observed_events"),
        text(odd).alias("unexpected_events"), F.array_sort(F.collect_list(gap)).alias("large_time_gaps"),
    )
    return out.join(milestones(events, key, strict_connect=strict_connect).select(key, F.col("expected").alias("expected_events"), F.col("missing").alias("missing_events")), key)


#: Stage pairs: first event, second event, threshold in ms, note. Fixed values.
STAGES = (
    ("setup", "crcx", "ISDN", "MGCP", 2000.0, "Inbound PSTN SETUP to Gateway MGCP Connection Creation (CRCX)"),
    ("crcx", "invite", "MGCP", "SIP", 1500.0, "Gateway MGCP Creation to CUCM SIP Egress INVITE"),
    ("invite", "ring", "SIP", "SIP", 3000.0, "SIP INVITE dispatched to destination endpoint 180 Ringing indication"),
    ("invite", "ok", "SIP", "SIP", 30000.0, "Call answer time (INVITE to 200 OK connect)"),
)


def stage_latencies(events: DataFrame, key: str = "session_id", ts: str = "ts", name: str = "message_type", order: tuple[str, ...] = ("ts", "source", "seq_in_source"), strict_connect: bool = False) -> DataFrame:
    """``(key, from_event, to_event, from_time, to_time, delta_ms, threshold_ms, is_suspicious, note)``.

    The first event of each stage, and the four deltas between them that are not negative; a session without any gets those
    between its first six events.
    """
    m = F.upper(F.col(name))
    x = events.where(F.col(ts).isNotNull() & F.col(name).isNotNull())
    tests = {
        "setup": m.isin("SETUP", "ISDN_SETUP"), "crcx": m.contains("CRCX"), "invite": m.contains("INVITE") & (F.col("protocol") == "SIP"), "ring": m.contains("180") | m.contains("RINGING"),
        "ok": m.contains("200") | (m.contains("CONNECT") & (~m.contains("DISCONNECT") if strict_connect else F.lit(True))),
    }
    at = F.struct(*order)
    g = x.groupBy(key).agg(F.count("*").alias("n"), *[F.min_by(F.struct(F.col(ts).alias("t"), F.col(name).alias("m")), F.when(c, at)).alias(k) for k, c in tests.items()])
    ms = lambda a, b: F.round((F.unix_micros(b) - F.unix_micros(a)) / 1000.0, 1)
    rows = []
    for a, b, pa, pb, limit, note in STAGES:
        d = ms(F.col(f"{a}.t"), F.col(f"{b}.t"))
        row = F.struct(
            F.concat(F.lit(f"{pa} "), F.col(f"{a}.m")).alias("from_event"), F.concat(F.lit(f"{pb} "), F.col(f"{b}.m")).alias("to_event"), F.col(f"{a}.t").alias("from_time"), F.col(f"{b}.t").alias("to_time"),
            d.alias("delta_ms"), F.lit(limit).alias("threshold_ms"), (d > limit).alias("is_suspicious"), F.lit(note).alias("note"),
        )
        rows.append(F.when(F.col(f"{b}.t") >= F.col(f"{a}.t"), row))
    staged = g.where("n >= 2").select(key, F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select(key, "r.*")
    w = Window.partitionBy(key).orderBy(*order)
    label = F.concat_ws(" ", "protocol", F.col(name))
    pairs = x.withColumns({"_n": F.row_number().over(w), "_t": F.lead(ts).over(w), "_m": F.lead(label).over(w)}).where("_n <= 5 AND _t IS NOT NULL")
    d = ms(F.col(ts), F.col("_t"))
    rest = pairs.join(staged.select(key).distinct(), key, "left_anti").select(
        key, label.alias("from_event"), F.col("_m").alias("to_event"), F.col(ts).alias("from_time"), F.col("_t").alias("to_time"), d.alias("delta_ms"), F.lit(5000.0).alias("threshold_ms"), (d > 5000.0).alias("is_suspicious"),
        F.lit("Consecutive signaling event progression delta").alias("note"),
    )
    return staged.unionByName(rest)


RIGHT, LEFT, INSIDE = "──────▶", "◀──────", "│── [SDL Internal]"


def ladder(events: DataFrame, key: str = "session_id", order: tuple[str, ...] = ("source", "seq_in_source")) -> DataFrame:
    """Steps of a session's ladder: order, offset from the first event, actors, arrow, snippet. Events without a time come last."""
    w = Window.partitionBy(key).orderBy(F.col("ts").asc_nulls_last(), *order)
    base = F.first("ts").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    offset = F.coalesce(F.greatest(F.lit(0.0), F.round((F.unix_micros("ts") - F.unix_micros(base)) / 1000.0, 1)), F.lit(0.0))
    raw = F.coalesce("raw", F.lit(""))
    rx, p = F.col("direction") == "RX", F.col("protocol")
    own = F.coalesce(F.col("device_type") == "CUCM", F.lit(False))
    sdl = F.coalesce(F.col("trace_type") == "CUCM_SDL", F.lit(False)) | raw.contains("SdlSig") | raw.contains("FileHead") | F.coalesce(F.map_contains_key("metadata", F.lit("receiving_process")), F.lit(False))
    phone = F.coalesce(has_any(F.col("device"), ("SEP", "CSF", "BOT")), F.lit(False)) | F.coalesce(F.col("device_type") == "SIP_ENDPOINT", F.lit(False))
    legs = [
        (sdl | ((p == "CUCM") & own), ("CUCM", "CUCM", INSIDE)),
        ((p == "ISDN") & rx, ("PSTN", "Voice Gateway", RIGHT)),
        (p == "ISDN", ("Voice Gateway", "PSTN", LEFT)),
        ((p == "MGCP") & rx, ("CUCM", "Voice Gateway", LEFT)),
        (p == "MGCP", ("Voice Gateway", "CUCM", RIGHT)),
        ((p == "SIP") & phone & rx, ("Phone", "CUCM", RIGHT)),
        ((p == "SIP") & phone, ("CUCM", "Phone", RIGHT)),
        ((p == "SIP") & rx & own, ("Voice Gateway", "CUCM", RIGHT)),
        ((p == "SIP") & rx, ("CUCM", "Voice Gateway", LEFT)),
        ((p == "SIP") & own, ("CUCM", "Voice Gateway", RIGHT)),
        (F.lit(True), ("Voice Gateway", "CUCM", RIGHT)),
    ]
    leg = None
    for cond, names in legs:
        value = F.struct(*[F.lit(v).alias(k) for k, v in zip(("actor_from", "actor_to", "arrow"), names, strict=True)])
        leg = F.when(cond, value) if leg is None else leg.when(cond, value)
    first_line = F.get(F.split(F.btrim(raw, F.lit(" \t\r\n")), "\r?\n"), F.lit(0))
    x = events.withColumns({"step_number": F.row_number().over(w), "time_offset_ms": offset, "_leg": leg})
    return x.select(
        key, "step_number", "ts", "time_offset_ms", "_leg.*", F.coalesce("message_type", F.lit("SIGNAL")).alias("message"), "protocol", (F.col("_leg.arrow") == INSIDE).alias("is_internal_cucm"), F.coalesce("source", F.lit("unknown")).alias("source_file"),
        F.col("seq_in_source").alias("source_line"), F.coalesce("device", "device_name", F.lit("Unknown")).alias("device"), F.substring(first_line, 1, 120).alias("raw_snippet"),
    )


def ladder_text(rungs: DataFrame, key: str = "session_id") -> DataFrame:
    """``(key, text)``: a diagram line per step under a header."""
    head = "  Time (IST)   |  Offset | PSTN                Voice Gateway             CUCM                      Phone\n" + "-" * 15 + "+" + "-" * 9 + "+" + "-" * 80
    at = {"PSTN": 0, "Voice Gateway": 22, "CUCM": 48}
    a, b = F.col("actor_from"), F.col("actor_to")
    pads = {("PSTN", "Voice Gateway"): (0, 46, True), ("Voice Gateway", "PSTN"): (0, 46, False), ("Voice Gateway", "CUCM"): (22, 23, True), ("CUCM", "Voice Gateway"): (22, 23, False), ("CUCM", "Phone"): (at["CUCM"], 0, True), ("Phone", "CUCM"): (at["CUCM"], 0, False)}
    row = F.when(F.col("is_internal_cucm"), F.concat(F.lit(" " * 48 + "│ ├── "), "message", F.lit(" ["), "source_file", F.lit("]")))
    for (x, y), (left, right, named_first) in pads.items():
        words = F.concat_ws(" ", "message", "arrow") if named_first else F.concat_ws(" ", "arrow", "message")
        row = row.when((a == x) & (b == y), F.concat(F.lit(" " * left + "|  "), words, F.lit("  |" + " " * right + " ["), "source_file", F.lit("]")))
    row = row.otherwise(F.concat(F.lit(" " * 22 + "|  "), "message", F.lit("  | ["), "source_file", F.lit("]")))
    clock = F.coalesce(F.date_format(F.from_utc_timestamp("ts", "Asia/Kolkata"), "HH:mm:ss"), F.lit("Unknown"))
    line = F.concat_ws(" | ", F.rpad(clock, 14, " "), F.lpad(F.concat(F.lit("+"), F.round("time_offset_ms").cast("long").cast("string"), F.lit("ms")), 7, " "), row)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("step_number", line.alias("line")))), lambda v: v["line"])
    return rungs.groupBy(key).agg(F.concat(F.lit(head + "\n"), F.array_join(ordered, "\n")).alias("text"))


def timeline(events: DataFrame, start: DataFrame, key: str = "call_key") -> DataFrame:
    """Events with ``offset_seconds`` from their call's start, in order; those without a time last."""
    x = events.join(start.select(key, "start_time"), key)
    return x.withColumn("offset_seconds", F.round((F.unix_micros("ts") - F.unix_micros("start_time")) / 1e6, 3)).orderBy(F.col("ts").asc_nulls_last(), *[c for c in ORDER[1:] if c in events.columns])


def unified_timeline(events: DataFrame, order: tuple[str, ...] = ("source_file", "source_line")) -> DataFrame:
    """All events with their ``rank`` in time over all calls, those without a time last; no task holds the whole order."""
    return ranked(events, None, [F.col("ts").asc_nulls_last(), *order])
