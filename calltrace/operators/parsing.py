"""From framed records to event tables, by column expressions alone.

``sdl_events`` and ``voice_events`` have the columns of :data:`SDL_COLUMNS` and :data:`VOICE_COLUMNS`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltrace.functions import patterns as P
from calltrace.functions.columns import capture, first_capture, has_any, sdl_timestamp, split_lines, trace_timestamp
from calltrace.operators import framing

SDL_COLUMNS = (
    "event_id ts node process signal direction call_id ci cdcc calling_number called_number device ip_address protocol raw_text source_file source_line "
    "trace_type sequence_num state receiving_process sending_process process_ids params ccb_id app_corr tcp_handle"
).split()
VOICE_COLUMNS = (
    "event_id ts timestamp_raw protocol direction source interface message_type call_reference transaction_id call_id calling_number called_number source_ip destination_ip "
    "source_port destination_port endpoint device destination trace_type device_type device_name device_ip trace_id timestamp_timezone cause_code raw correlation_ids metadata codecs seq_in_source"
).split()
_INTS = {"source_port", "destination_port", "seq_in_source"}


def event_id(file_name: Column, line_no: Column) -> Column:
    return F.sha2(F.concat_ws("\n", file_name, line_no.cast("string")).cast("binary"), 256)


def infer_protocol(signal: Column, process: Column, text: Column) -> Column:
    """The first protocol whose words the signal or process contains, or whose marks the text does; else CUCM."""
    names = F.concat_ws("\n", F.lower(signal), F.lower(process))
    low = F.lower(text)
    return (
        F.when(has_any(names, P.SIP_WORDS) | low.contains("sip/2.0"), "SIP")
        .when(has_any(names, P.Q931_WORDS) | low.contains("q931"), "Q931")
        .when(has_any(names, P.MGCP_WORDS) | low.contains("mgcp 0.1") | low.contains("mgcp 1.0"), "MGCP")
        .when(has_any(names, P.SCCP_WORDS) | low.contains("skinny"), "SCCP")
        .otherwise("CUCM")
    )


def infer_direction(header: Column, text: Column) -> Column:
    low = F.lower(text)
    return F.when(header.contains("[R:") | low.contains("received msg from"), "INBOUND").when(header.contains("[T:") | low.contains("send msg") | low.contains("sending msg"), "OUTBOUND").otherwise("INTERNAL")


def identifiers(text: Column, ci: str = P.CI) -> dict[str, Column]:
    """Correlation identifiers, party numbers, device and first address in a record; ``ci``: the pattern of its CI."""
    return {
        "call_id": capture(text, P.CALL_ID),
        "ci": capture(text, ci),
        "cdcc": first_capture(text, (P.CDCC, P.CDCC_PROCESS)),
        "calling_number": first_capture(text, P.CALLING),
        "called_number": first_capture(text, P.CALLED),
        "device": capture(text, P.DEVICE),
        "ip_address": capture(text, P.IPV4),
        "ccb_id": capture(text, P.CCB_ID),
        "app_corr": capture(text, P.APP_CORR),
        "tcp_handle": capture(text, P.TCP_HANDLE),
    }


def parse_sdl(records: DataFrame, ci: str = P.CI) -> DataFrame:
    """``sdl_events`` from :func:`framing.frame_sdl`."""
    text, kind, rest = F.col("raw_text"), F.col("type"), F.col("rest")
    parts = F.split(rest, "\\|")
    part = lambda i: F.nullif(F.btrim(F.get(parts, F.lit(i))), F.lit(""))
    sig, app = kind.startswith("SdlSig"), kind.startswith("AppInfo")
    head = kind == "FileHead"
    stat = kind.startswith("SdlStat")
    token = F.coalesce(capture(F.btrim(rest), r"^(\S+)"), F.lit("AppInfo"))
    verb = F.coalesce(F.upper(capture(text, P.APPINFO_SIP_REQUEST)), F.btrim(capture(text, P.APPINFO_SIP_STATUS)), F.upper(capture(text, P.APPINFO_MGCP)), token)
    signal = F.when(sig, part(0)).when(app, verb).when(head, "FileHead").when(stat, "SdlStat").otherwise(kind)
    process = F.when(sig, F.substring_index(part(2), "(", 1)).when(app, token).when(head | stat, "TraceService").otherwise(kind)
    x = records.withColumns({"signal": signal, "process": process})
    only = lambda i: F.when(sig, part(i))
    found = identifiers(text, ci)
    return x.select(
        event_id(F.col("file_name"), F.col("source_line")).alias("event_id"), sdl_timestamp(F.col("time"), F.col("base_date"), F.col("offset")).alias("ts"), "node", "process", "signal",
        infer_direction(F.col("header_line"), text).alias("direction"), *[found[k].alias(k) for k in ("call_id", "ci", "cdcc", "calling_number", "called_number", "device", "ip_address")],
        infer_protocol(F.col("signal"), F.col("process"), text).alias("protocol"), "raw_text", F.col("file_name").alias("source_file"), "source_line",
        kind.alias("trace_type"), F.col("seq").alias("sequence_num"), only(1).alias("state"), only(2).alias("receiving_process"), only(3).alias("sending_process"), only(4).alias("process_ids"),
        only(5).alias("params"), *[found[k].alias(k) for k in ("ccb_id", "app_corr", "tcp_handle")],
    )


def sdl_events(lines: DataFrame, ci: str = P.CI, **options) -> DataFrame:
    return parse_sdl(framing.frame_sdl(lines, **options), ci)


def bad_timestamps(records: DataFrame) -> DataFrame:
    """``(file_name, line_no, text, reason)`` of records whose stamp is not a time of day."""
    bad = F.try_to_timestamp(F.substring(F.regexp_extract("time", r"(\d{2}:\d{2}:\d{2})", 1), 1, 8), F.lit("HH:mm:ss")).isNull()
    return records.where(bad).select("file_name", F.col("source_line").alias("line_no"), F.substring("raw_text", 1, 200).alias("text"), F.lit("Timestamp parsing failed").alias("reason"))


def short_direction(direction: Column) -> Column:
    """Directions of ``sdl_events`` as ``voice_events`` name them."""
    return F.when(direction == "INBOUND", "RX").when(direction == "OUTBOUND", "TX").otherwise(direction)


def _voice(rows: DataFrame, protocol: str, columns: dict[str, Column], metadata: dict[str, Column], year: int) -> DataFrame:
    """``voice_events`` of one protocol: given columns, others null."""
    given = {
        "event_id": event_id(F.concat(F.col("file_name"), F.lit(f"/{protocol}")), F.col("source_line")),
        "ts": trace_timestamp(columns["timestamp_raw"], year),
        "protocol": F.lit(protocol),
        "source": F.col("file_name"),
        "correlation_ids": F.create_map().cast("map<string,string>"),
        "metadata": F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in metadata.items()]), lambda e: e["value"].isNotNull())),
        "codecs": F.lit(None).cast("array<string>"),
        "seq_in_source": F.col("source_line").cast("long"),
        **columns,
    }
    given["direction"] = short_direction(given["direction"])
    return rows.select(*[given[c].alias(c) if c in given else F.lit(None).cast("int" if c in _INTS else "string").alias(c) for c in VOICE_COLUMNS])


def isdn_events(lines: DataFrame, year: int = 2026, **options) -> DataFrame:
    rows = framing.frame_isdn(lines, **options)
    head, raw = F.col("header_line"), F.col("raw")
    strict = head.rlike(P.ISDN_STRICT)
    pick = lambda i, j: F.when(strict, capture(head, P.ISDN_STRICT, i)).otherwise(capture(head, P.ISDN_FLEXIBLE, j)) if j else F.when(strict, capture(head, P.ISDN_STRICT, i))
    name = F.upper(F.coalesce(pick(4, 2), F.lit("Q931_EVENT")))
    names = F.create_map(*[F.lit(x) for pair in P.ISDN_NAMES.items() for x in pair])
    way = F.upper(F.coalesce(pick(3, 1), F.lit("")))
    return _voice(
        rows, "ISDN",
        {
            "timestamp_raw": F.btrim(pick(1, 0), F.lit(": ")), "interface": pick(2, 0), "message_type": F.coalesce(F.try_element_at(names, name), name), "call_reference": pick(6, 3),
            "direction": F.when(way.contains("RX") | way.contains("<-") | way.contains("INBOUND"), "INBOUND").when(way.contains("TX") | way.contains("->") | way.contains("OUTBOUND"), "OUTBOUND").otherwise("UNKNOWN"),
            "calling_number": F.btrim(capture(raw, P.ISDN_CALLING)), "called_number": F.btrim(capture(raw, P.ISDN_CALLED)), "cause_code": F.btrim(capture(raw, P.ISDN_CAUSE)), "raw": raw,
        },
        {"protocol_discriminator": pick(5, 0), "raw_message_type": name, "channel_id": capture(raw, P.ISDN_CHANNEL_ID), "b_channel": capture(raw, P.ISDN_CHANNEL), "bearer_capability": capture(raw, P.ISDN_BEARER)}, year,
    )


def sip_events(lines: DataFrame, year: int = 2026, **options) -> DataFrame:
    rows = framing.frame_sip(lines, **options)
    head, raw = F.col("header_line"), F.col("raw")
    request = head.rlike(P.SIP_REQUEST)
    code, reason = capture(head, P.SIP_STATUS), F.btrim(F.coalesce(capture(head, P.SIP_STATUS, 2), F.lit("")))
    method = F.when(request, F.upper(capture(head, P.SIP_REQUEST)))
    cseq, cseq_method = capture(raw, P.SIP_CSEQ_NUMBER), F.upper(capture(raw, P.SIP_CSEQ_METHOD))
    every = lambda g: F.regexp_extract_all(raw, F.lit(P.SDP_RTPMAP), F.lit(g))
    codecs = F.transform(F.arrays_zip(every(1).alias("p"), every(2).alias("e"), every(3).alias("c")), lambda x: F.concat(x["e"], F.lit("/"), x["c"], F.lit(" ("), x["p"], F.lit(")")))
    return _voice(
        rows, "SIP",
        {
            "timestamp_raw": F.col("timestamp_raw"), "direction": F.col("direction"), "message_type": F.coalesce(method, F.btrim(F.concat_ws(" ", code, reason))), "call_id": capture(raw, P.SIP_CALL_ID),
            "transaction_id": F.when(cseq.isNotNull(), F.concat_ws(" ", cseq, cseq_method)), "calling_number": capture(capture(raw, P.SIP_FROM), P.SIP_USER), "called_number": capture(capture(raw, P.SIP_TO), P.SIP_USER),
            "source_ip": capture(raw, P.SIP_VIA), "source_port": capture(raw, P.SIP_VIA, 2).try_cast("int"), "cause_code": F.when(~request, F.btrim(F.concat_ws(" ", F.lit("SIP"), code, reason))), "raw": raw,
            "codecs": F.when(F.size(codecs) > 0, codecs),
        },
        {"sip_method": F.coalesce(method, cseq_method), "sip_response_code": F.when(~request, code), "cseq_number": cseq, "rtp_ip": capture(raw, P.SDP_ADDRESS), "rtp_port": capture(raw, P.SDP_AUDIO), "rtp_proto": capture(raw, P.SDP_AUDIO, 2)}, year,
    )


def mgcp_events(lines: DataFrame, year: int = 2026, **options) -> DataFrame:
    rows = framing.frame_mgcp(lines, **options)
    raw = F.col("raw")
    # the first command or response line decides
    lead = F.get(F.filter(split_lines(raw), lambda x: (x.rlike(P.MGCP_COMMAND) | x.rlike(P.MGCP_RESPONSE)) & ~x.rlike(P.MGCP_BANNER)), F.lit(0))
    rows = rows.withColumn("lead", F.btrim(lead))
    lead = F.col("lead")
    command = lead.rlike(P.MGCP_COMMAND)
    verb, code, comment = F.upper(capture(lead, P.MGCP_COMMAND)), capture(lead, P.MGCP_RESPONSE), F.btrim(F.coalesce(capture(lead, P.MGCP_RESPONSE, 3), F.lit("")))
    inbound, outbound = F.col("direction") == "INBOUND", F.col("direction") == "OUTBOUND"
    trim = lambda p: F.btrim(capture(raw, p))
    return _voice(
        rows, "MGCP",
        {
            "timestamp_raw": F.col("timestamp_raw"), "direction": F.col("direction"), "message_type": F.when(command, verb).otherwise(F.btrim(F.concat_ws(" ", code, comment))),
            "transaction_id": F.when(command, capture(lead, P.MGCP_COMMAND, 2)).otherwise(capture(lead, P.MGCP_RESPONSE, 2)), "call_id": trim(P.MGCP_CALL_ID), "endpoint": F.when(command, capture(lead, P.MGCP_COMMAND, 3)),
            "source_ip": F.when(inbound, F.col("peer_ip")), "destination_ip": F.when(outbound, F.col("peer_ip")), "source_port": F.when(inbound, F.col("peer_port")), "destination_port": F.when(outbound, F.col("peer_port")),
            "cause_code": F.when(~command, F.btrim(F.concat_ws(" ", F.lit("MGCP"), code, comment))), "raw": raw,
        },
        {
            "command": F.when(command, verb).otherwise("RESPONSE"), "mgcp_version": F.when(command, capture(lead, P.MGCP_COMMAND, 4)), "response_code": F.when(~command, code), "connection_id": trim(P.MGCP_CONNECTION), "mode": trim(P.MGCP_MODE),
            "local_options": trim(P.MGCP_OPTIONS), "request_identifier": trim(P.MGCP_REQUEST), "rtp_ip": capture(raw, P.SDP_ADDRESS), "rtp_port": capture(raw, P.SDP_AUDIO_PORT),
        }, year,
    )


def sdl_as_voice(events: DataFrame) -> DataFrame:
    """``sdl_events`` as ``voice_events``: Q931 becomes ISDN, SCCP becomes CUCM; identifiers become correlation ids."""
    ids = F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (("ci", "ci"), ("cdcc", "cdcc"), ("ccb_id", "ccb_id"), ("app_corr", "app_corr"), ("tcp_handle", "tcp_handle"))]), lambda e: e["value"].isNotNull()
    )
    given = {
        "event_id": F.col("event_id"), "ts": F.col("ts"), "timestamp_raw": F.col("ts").cast("string"), "source": F.col("source_file"), "message_type": F.coalesce("signal", F.lit("SDL_EVENT")),
        "protocol": F.when(F.col("protocol") == "Q931", "ISDN").when(F.col("protocol") == "SCCP", "CUCM").otherwise(F.col("protocol")),
        "direction": short_direction(F.col("direction")), "call_id": F.col("call_id"), "calling_number": F.col("calling_number"), "called_number": F.col("called_number"), "source_ip": F.col("ip_address"), "device": F.col("device"),
        "raw": F.col("raw_text"), "correlation_ids": F.map_from_entries(ids), "trace_type": F.lit("CUCM_SDL"), "device_name": F.col("node"),
        "metadata": F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in ("process", "state", "sequence_num")]), lambda e: e["value"].isNotNull())),
        "codecs": F.lit(None).cast("array<string>"), "seq_in_source": F.col("source_line").cast("long"),
    }
    return events.select(*[given[c].alias(c) if c in given else F.lit(None).cast("int" if c in _INTS else "string").alias(c) for c in VOICE_COLUMNS])


def log_events(lines: DataFrame, ci: str = P.CI) -> DataFrame:
    """Call-manager logs line by line: every non-blank line is an event."""
    line = F.btrim("line")
    parts = F.split(line, "\\|")
    part = lambda i: F.nullif(F.btrim(F.get(parts, F.lit(i))), F.lit(""))
    found = capture(line, ci)
    given = {
        "event_id": event_id(F.concat(F.col("file_name"), F.lit("/CUCM")), F.col("line_no")), "ts": trace_timestamp(part(1), reference_date=F.lit("2026-09-20")), "timestamp_raw": part(1), "protocol": F.when(line.rlike(P.SEGMENT["ISDN"]), "ISDN").otherwise("CUCM"),
        "direction": short_direction(infer_direction(line, line)), "source": F.col("file_name"), "message_type": F.coalesce(part(3), part(2), F.lit("LOG")), "call_id": F.when(found.isNotNull(), F.concat(F.lit("CI_"), found)),
        "calling_number": first_capture(line, P.CALLING), "called_number": first_capture(line, P.CALLED), "raw": F.col("line"), "correlation_ids": F.create_map().cast("map<string,string>"),
        "metadata": F.create_map().cast("map<string,string>"), "codecs": F.lit(None).cast("array<string>"), "seq_in_source": F.col("line_no").cast("long"),
    }
    return lines.where(line != "").select(*[given[c].alias(c) if c in given else F.lit(None).cast("int" if c in _INTS else "string").alias(c) for c in VOICE_COLUMNS])


#: Protocol to its lines-to-events function; callers may add their own.
PARSERS = {"ISDN": isdn_events, "SIP": sip_events, "MGCP": mgcp_events, "CUCM_SDL": lambda lines: sdl_as_voice(sdl_events(lines)), "CUCM": log_events}


def parse_mixed(lines: DataFrame, protocols: DataFrame, parsers: dict | None = None, whole: DataFrame | None = None) -> DataFrame:
    """``voice_events`` of files by every protocol detected in each: ``protocols`` is ``(file_name, protocol)``.

    ``whole``: ``(file_name, content)``; its files without any event become one RAW_TRACE event each.
    """
    out = None
    for name, parse in (parsers or PARSERS).items():
        own = lines.join(protocols.where(F.col("protocol") == name).select("file_name"), "file_name", "left_semi")
        out = parse(own) if out is None else out.unionByName(parse(own))
    if whole is None:
        return out
    given = {
        "event_id": event_id(F.col("file_name"), F.lit(0)), "source": F.col("file_name"), "protocol": F.lit("UNKNOWN"), "direction": F.lit("UNKNOWN"), "message_type": F.lit("RAW_TRACE"), "raw": F.col("content"),
        "correlation_ids": F.create_map().cast("map<string,string>"), "metadata": F.create_map().cast("map<string,string>"), "codecs": F.lit(None).cast("array<string>"), "seq_in_source": F.lit(0).cast("long"), "ts": F.lit(None).cast("timestamp"),
    }
    rest = whole.join(out.select(F.col("source").alias("file_name")).distinct(), "file_name", "left_anti")
    return out.unionByName(rest.select(*[given[c].alias(c) if c in given else F.lit(None).cast("int" if c in _INTS else "string").alias(c) for c in VOICE_COLUMNS]))


def stamped(events: DataFrame, classes: DataFrame) -> DataFrame:
    """Provenance columns filled from a classification by file (``source``), only where missing."""
    names = ["trace_type", "device_type", "device_name", "device_ip"]
    c = classes.select(F.col("file_name").alias("source"), *[F.col(n).alias(f"_{n}") for n in names if n in classes.columns])
    out = events.join(c, "source", "left")
    return out.select(*[F.coalesce(F.col(n), F.col(f"_{n}")).alias(n) if f"_{n}" in out.columns else F.col(n) for n in events.columns])


def overridden(classes: DataFrame, overrides: DataFrame, columns: tuple[str, ...] = ("trace_type", "device_type", "device_name", "device_ip")) -> DataFrame:
    """A classification with user overrides: those of the file, else the global row (null file); blank and Auto Detect count as none."""
    clean = lambda c: F.when((F.btrim(c) != "") & (F.lower(F.btrim(c)) != "auto detect"), F.regexp_replace(F.upper(F.btrim(c)), "[ -]+", "_") if c in ("trace_type", "device_type") else F.btrim(c))
    names = [c for c in columns if c in overrides.columns]
    own = overrides.where("file_name IS NOT NULL").select("file_name", *[clean(c).alias(f"_o_{c}") for c in names])
    every = overrides.where("file_name IS NULL").agg(*[F.first(clean(c), True).alias(f"_g_{c}") for c in names])
    out = classes.join(own, "file_name", "left").join(F.broadcast(every))  # one row
    return out.select(*[F.coalesce(F.col(f"_o_{c}"), F.col(f"_g_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in classes.columns])
