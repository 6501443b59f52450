"""Queries over traces of ISDN, SIP and MGCP, of mixed files, and over what is told of a call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltrace.functions.columns import display_duration, display_range, display_time, seconds_between
from calltrace.functions.work import materialize
from calltrace.operators import anomalies, classify, correlate, evidence, flow, framing, parsing, reports, scored, search, sessions, slices
from calltrace.plans.base import query
from calltrace.plans.rendered import CI, SIG, isdn_rows, mgcp_rows, numbered_lines, rendered_lines, sdl_table, signal_events, sip_rows, voice_table, whole_files
from calltrace.streaming import ingest, monitor


def _ms(c):
    return F.unix_millis(c)


def _meta(k: str):
    return F.try_element_at("metadata", F.lit(k))


def _named_sql(pairs: str) -> str:
    return "CASE message_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in (p.split("=") for p in pairs.split(";"))) + " END"


_ISDN = _named_sql("INVITE=SETUP;180 Ringing=ALERTING;200 OK=CONNECT;ACK=CONNECT ACKNOWLEDGE;BYE=DISCONNECT;503 Service Unavailable=RELEASE COMPLETE")
_Q931 = _named_sql("INVITE=SETUP;180 Ringing=ALERTING;200 OK=CONNECT;ACK=CALL PROCEEDING;BYE=DISCONNECT;503 Service Unavailable=RELEASE COMPLETE")
_MGCP = _named_sql("INVITE=CRCX;180 Ringing=250 Connection deleted;200 OK=200 OK;ACK=MDCX;BYE=DLCX;503 Service Unavailable=510 Protocol error")
_REQUEST = "message_type IN ('INVITE', 'ACK', 'BYE')"


# --- other protocols' traces ----------------------------------------------------------------------------------------------
@query(f"""WITH {SIG} SELECT event_id, epoch_ms(ts) AS ts_ms, {_ISDN} AS message_type, format('0x{{:04x}}', CASE WHEN event_id % 2 = 0 THEN 0 ELSE 32768 END + user_id % 32768) AS call_reference, CASE WHEN event_id % 2 = 0 THEN 'RX' ELSE 'TX' END AS direction,
  CASE WHEN message_type = 'INVITE' THEN calling_number END AS calling_number, CASE WHEN message_type = 'INVITE' THEN called_number END AS called_number,
  CASE WHEN message_type = 'BYE' THEN '0x8090 - Normal call clearing' WHEN message_type LIKE '503%' THEN '0x80A2 - No circuit available' END AS cause_code, format('0x{{:04x}}', user_id % 32768) AS callref FROM sig""")
def q_isdn_events(spark, sf_dir):
    """Q.931 messages of several lines, framed and parsed; call references without their direction bit."""
    e = parsing.isdn_events(numbered_lines(isdn_rows(signal_events(spark, sf_dir))), year=2024, chunk=700)
    return e.select(_meta("b_channel").cast("long").alias("event_id"), _ms("ts").alias("ts_ms"), "message_type", "call_reference", "direction", "calling_number", "called_number", "cause_code", scored.normal_callref(F.col("call_reference")).alias("callref"))


@query(f"""WITH {SIG} SELECT event_id, epoch_ms(ts) AS ts_ms, message_type, CASE WHEN event_id % 2 = 0 THEN 'RX' ELSE 'TX' END AS direction, call_id, calling_number, called_number, '10.1.1.' || (user_id % 200) AS source_ip, 5060 AS source_port,
  CASE WHEN message_type IN ('ACK', 'BYE') THEN message_type ELSE 'INVITE' END AS cseq_method, CASE WHEN NOT {_REQUEST} THEN 'SIP ' || message_type END AS cause_code,
  CASE WHEN message_type = 'INVITE' THEN 'PCMU/8000 (0);PCMA/8000 (8)' END AS codecs, CASE WHEN message_type = 'INVITE' THEN CAST(16384 + event_id % 1000 AS VARCHAR) END AS rtp_port FROM sig""")
def q_sip_events(spark, sf_dir):
    """SIP messages with and without a closing delimiter."""
    e = parsing.sip_events(numbered_lines(sip_rows(signal_events(spark, sf_dir))), year=2024, chunk=900)
    return e.select(
        F.substring_index("transaction_id", " ", 1).cast("long").alias("event_id"), _ms("ts").alias("ts_ms"), "message_type", "direction", "call_id", "calling_number", "called_number", "source_ip", "source_port",
        F.substring_index("transaction_id", " ", -1).alias("cseq_method"), "cause_code", F.array_join("codecs", ";").alias("codecs"), _meta("rtp_port").alias("rtp_port"),
    )


@query(f"""WITH {SIG} SELECT event_id, epoch_ms(ts) AS ts_ms, {_MGCP} AS message_type, CASE WHEN event_id % 2 = 0 THEN 'RX' ELSE 'TX' END AS direction, CASE WHEN {_REQUEST} THEN 'D' || user_id END AS call_id,
  CASE WHEN {_REQUEST} THEN 'S0/SU0/DS1-0/' || (user_id % 24) || '@vg.example.com' END AS endpoint, CASE WHEN event_id % 2 = 0 THEN '10.2.' || (user_id % 200) || '.1' END AS source_ip, CASE WHEN event_id % 2 = 1 THEN '10.2.' || (user_id % 200) || '.1' END AS destination_ip,
  CASE WHEN NOT {_REQUEST} THEN 'MGCP ' || {_MGCP} END AS cause_code, CAST(event_id % 100 AS VARCHAR) AS connection_id, CASE WHEN {_REQUEST} THEN {_MGCP} ELSE 'RESPONSE' END AS command FROM sig""")
def q_mgcp_events(spark, sf_dir):
    """MGCP commands and responses with and without a closing delimiter."""
    e = parsing.mgcp_events(numbered_lines(mgcp_rows(signal_events(spark, sf_dir))), year=2024, chunk=800)
    return e.select(
        F.col("transaction_id").cast("long").alias("event_id"), _ms("ts").alias("ts_ms"), "message_type", "direction", "call_id", "endpoint", "source_ip", "destination_ip", "cause_code", _meta("connection_id").alias("connection_id"), _meta("command").alias("command")
    )


def _gateway_lines(spark, sf_dir) -> DataFrame:
    """A file a day with messages of three protocols in turn."""
    e = signal_events(spark, sf_dir)
    part = lambda k: e.where(F.col("event_id") % 3 == k)
    return numbered_lines(isdn_rows(part(0), "GW_").unionByName(sip_rows(part(1), "GW_", True)).unionByName(mgcp_rows(part(2), "GW_", True)))


@query(f"""WITH {SIG} SELECT 'GW_' || substr(source, 5) AS source, CASE event_id % 3 WHEN 0 THEN 'ISDN' WHEN 1 THEN 'SIP' ELSE 'MGCP' END AS protocol, CASE event_id % 3 WHEN 0 THEN {_ISDN} WHEN 1 THEN message_type ELSE {_MGCP} END AS message_type, count(*) AS n FROM sig GROUP BY ALL
  UNION ALL SELECT 'empty.txt', 'UNKNOWN', 'RAW_TRACE', 1""")
def q_parse_mixed(spark, sf_dir):
    """Files that hold three protocols, each found and parsed; a file without any message is one raw event."""
    lines = materialize(_gateway_lines(spark, sf_dir), "gateway-lines")
    files = whole_files(lines).unionByName(spark.createDataFrame([("empty.txt", "nothing here")], "file_name string, content string"))
    protocols = materialize(classify.protocols_of_lines(lines), "protocols")  # a row a file and protocol, read by every parser
    e = parsing.parse_mixed(lines, protocols, {k: parsing.PARSERS[k] for k in ("ISDN", "SIP", "MGCP")}, files)
    return e.groupBy("source", "protocol", "message_type").agg(F.count("*").alias("n"))


@query(f"""WITH {SIG}, d AS (SELECT DISTINCT substr(source, 5) AS day FROM sig), k AS (SELECT * FROM (VALUES ('SDL_', 'CUCM_SDL', 'CUCM'), ('ISDN_', 'ISDN_Q931', 'VOICE_GATEWAY'), ('SIP_', 'SIP', 'VOICE_GATEWAY'), ('MGCP_', 'MGCP', 'VOICE_GATEWAY'), ('GW_', 'MIXED', 'VOICE_GATEWAY')) AS k(prefix, trace_type, device_type))
  SELECT prefix || day AS file_name, trace_type, device_type, CASE WHEN prefix = 'SDL_' THEN 'NODE' || substr(day, 7, 2) ELSE CASE WHEN prefix = 'SIP_' THEN 'VG01' ELSE 'VoiceGateway' END END AS device_name FROM d, k""")
def q_classify_traces(spark, sf_dir):
    """Trace files of five kinds by their content."""
    e = signal_events(spark, sf_dir)
    lines = rendered_lines(e).unionByName(_gateway_lines(spark, sf_dir))
    for rows in (isdn_rows(e), sip_rows(e), mgcp_rows(e)):
        lines = lines.unionByName(numbered_lines(rows))
    return classify.classify_lines(lines).select("file_name", "trace_type", "device_type", "device_name")


@query(f"""WITH {SIG}, l AS (SELECT 'GW_' || substr(source, 5) AS file_name, CASE event_id % 3 WHEN 0 THEN 'ISDN' WHEN 1 THEN 'SIP' ELSE 'MGCP' END AS p FROM sig) SELECT file_name, array_to_string(list_sort(list(DISTINCT p)), ',') AS protocols FROM l GROUP BY file_name""")
def q_protocols_of_files(spark, sf_dir):
    found = classify.protocols_of_lines(_gateway_lines(spark, sf_dir)).withColumnRenamed("protocol", "p")
    return found.groupBy("file_name").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("protocols"))


@query(f"""WITH {SIG}, f AS (SELECT source AS file_name, count(*) + 1 AS event_count, epoch_ms(max(ts)) AS end_ms FROM sig GROUP BY source) SELECT file_name, 'CUCM_SDL' AS trace_type, event_count, end_ms FROM f""")
def q_file_inventory(spark, sf_dir):
    """One row per trace file: class, events and last stamp."""
    lines = rendered_lines(signal_events(spark, sf_dir))
    files = whole_files(lines)
    out = classify.inventory(files, classify.classify_lines(lines), parsing.sdl_as_voice(parsing.sdl_events(lines)))
    return out.select("file_name", "trace_type", "event_count", _ms("end_time").alias("end_ms"))


@query(f"""WITH {SIG} SELECT event_id, message_type, call_id, 'CUCM_SDL' AS trace_type, 'NODE' || substr(source, 11, 2) AS device_name, ci, CASE WHEN message_type = 'INVITE' THEN 'RX' ELSE 'INTERNAL' END AS direction FROM sig""")
def q_sdl_as_voice(spark, sf_dir):
    """Call-manager events among those of the other protocols."""
    v = parsing.sdl_as_voice(parsing.sdl_events(rendered_lines(signal_events(spark, sf_dir)), CI)).where("message_type <> 'FileHead'")
    return v.select(F.substring_index(_meta("sequence_num"), ".", 1).cast("long").alias("event_id"), "message_type", "call_id", "trace_type", "device_name", F.try_element_at("correlation_ids", F.lit("ci")).alias("ci"), "direction")


@query(f"""WITH {SIG} SELECT event_id, message_type, 'CI_' || ci AS call_id, calling_number, called_number FROM sig WHERE message_type <> 'INVITE'""")
def q_log_events(spark, sf_dir):
    """The same records read line by line as a plain call-manager log."""
    e = parsing.log_events(rendered_lines(signal_events(spark, sf_dir)), CI).where(F.col("raw").contains("|SdlSig |"))
    return e.select(F.regexp_extract("raw", r"^0*(\d+)\.", 1).cast("long").alias("event_id"), "message_type", "call_id", "calling_number", "called_number")


@query(f"""WITH {SIG} SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'SIP' WHEN event_id % 4 = 1 THEN 'ISDN_Q931' ELSE 'OTHER' END AS trace_type, CASE WHEN event_id % 2 = 0 THEN 'gw' ELSE 'all' END AS device_name FROM sig""")
def q_stamped(spark, sf_dir):
    """Provenance of events from a classification by file, with overrides by file and for all."""
    e = voice_table(signal_events(spark, sf_dir)).withColumns({"source": F.col("event_id").cast("string"), "trace_type": F.when(F.col("event_id") % 4 == 0, "SIP"), "device_ip": F.lit(None).cast("string")})
    classes = e.select(F.col("source").alias("file_name"), F.lit("OTHER").alias("trace_type"), F.lit("cls").alias("device_name"))
    k = F.col("event_id") % 4
    own = e.where((k == 1) | (F.col("event_id") % 2 == 0)).select(F.col("source").alias("file_name"), F.when(k == 1, " isdn q931 ").when(k == 2, "Auto Detect").otherwise("").alias("trace_type"), F.when(F.col("event_id") % 2 == 0, "gw").otherwise(" ").alias("device_name"))
    every = spark.createDataFrame([(None, "", "all")], "file_name string, trace_type string, device_name string")
    return parsing.stamped(e, parsing.overridden(classes, own.unionByName(every))).select("event_id", "trace_type", "device_name")


# --- machines -------------------------------------------------------------------------------------------------------------
@query(f"""WITH {SIG}, m AS (SELECT event_id, call_id, ts, {_Q931} AS m FROM sig), s AS (SELECT *, CASE m WHEN 'SETUP' THEN 'CALL_SETUP' WHEN 'CALL PROCEEDING' THEN 'ROUTE_SELECTION' WHEN 'ALERTING' THEN 'ALERTING' WHEN 'CONNECT' THEN 'ACTIVE' WHEN 'DISCONNECT' THEN 'DISCONNECT' ELSE 'CALL_END' END AS st FROM m),
  f AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY call_id ORDER BY ts, event_id), 'IDLE') AS fs FROM s)
  SELECT event_id, fs AS from_state, st AS to_state, CASE m WHEN 'ALERTING' THEN fs IN ('CALL_SETUP', 'ROUTE_SELECTION') WHEN 'CONNECT' THEN fs IN ('ALERTING', 'CALL_SETUP', 'ROUTE_SELECTION') ELSE true END AS is_valid FROM f""")
def q_state_q931(spark, sf_dir):
    m = F.col("signal")
    name = F.when(m == "INVITE", "SETUP").when(m == "180 Ringing", "ALERTING").when(m == "200 OK", "CONNECT").when(m == "ACK", "CALL PROCEEDING").when(m == "BYE", "DISCONNECT").otherwise("RELEASE COMPLETE")
    e = sdl_table(signal_events(spark, sf_dir)).withColumns({"signal": name, "protocol": F.lit("Q931")})
    return flow.call_transitions(e).select(F.col("event_id").cast("long").alias("event_id"), "from_state", "to_state", "is_valid")


@query(f"""WITH RECURSIVE {SIG}, n AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY ts, event_id) AS i FROM sig),
  f AS (SELECT call_id, i, event_id, message_type, 'IDLE' AS was, CASE message_type WHEN 'INVITE' THEN 'CALL_SETUP' WHEN '180 Ringing' THEN 'ALERTING' WHEN 'ACK' THEN 'ACTIVE' WHEN 'BYE' THEN 'DISCONNECT' WHEN '503 Service Unavailable' THEN 'CALL_START' ELSE 'IDLE' END AS st FROM n WHERE i = 1
    UNION ALL SELECT n.call_id, n.i, n.event_id, n.message_type, f.st, CASE n.message_type WHEN 'INVITE' THEN 'CALL_SETUP' WHEN '180 Ringing' THEN 'ALERTING' WHEN 'ACK' THEN 'ACTIVE' WHEN 'BYE' THEN 'DISCONNECT'
      WHEN '200 OK' THEN CASE WHEN f.st = 'DISCONNECT' THEN 'CALL_END' ELSE f.st END ELSE CASE WHEN f.st = 'IDLE' THEN 'CALL_START' ELSE f.st END END FROM f JOIN n ON n.call_id = f.call_id AND n.i = f.i + 1)
  SELECT event_id, was AS from_state, st AS to_state FROM f""")
def q_state_mgcp(spark, sf_dir):
    m = F.col("signal")
    raw = F.when(m == "INVITE", "CRCX 1").when(m == "180 Ringing", "RQNT 2 RG").when(m == "200 OK", "200 3 OK").when(m == "ACK", "MDCX 4").when(m == "BYE", "DLCX 5").otherwise("NTFY 6")
    e = sdl_table(signal_events(spark, sf_dir)).withColumns({"raw_text": raw, "signal": F.lit("x"), "protocol": F.lit("MGCP")})
    return flow.call_transitions(e).select(F.col("event_id").cast("long").alias("event_id"), "from_state", "to_state")


@query(f"""WITH {SIG}, f AS (SELECT call_id, bool_or(message_type = 'INVITE') AS s, bool_or(message_type = '180 Ringing') AS a, bool_or(message_type = '200 OK') AS c, bool_or(message_type = 'BYE') AS d, bool_or(message_type LIKE '503%') AS r, bool_or(message_type = 'ACK') AS p,
    min(ts) FILTER (WHERE message_type = 'INVITE') AS ts_s, min(ts) FILTER (WHERE message_type = '180 Ringing') AS ts_a, min(ts) FILTER (WHERE message_type = 'BYE') AS ts_d FROM sig GROUP BY call_id)
  SELECT call_id AS session_id, 'MISSING_MESSAGE' AS category, 'ERROR' AS severity, 'CALL PROCEEDING or ALERTING' AS expected_message, epoch_ms(ts_s) AS ts_ms FROM f WHERE s AND NOT (p OR a OR c OR d) UNION ALL
  SELECT call_id, 'MISSING_MESSAGE', 'WARNING', 'CONNECT or DISCONNECT', epoch_ms(ts_a) FROM f WHERE a AND NOT (c OR d) UNION ALL SELECT call_id, 'MISSING_MESSAGE', 'WARNING', 'RELEASE or RELEASE COMPLETE', epoch_ms(ts_d) FROM f WHERE d AND NOT r UNION ALL
  SELECT call_id, 'CAUSE_CODE', 'ERROR', NULL, epoch_ms(ts) FROM sig WHERE message_type LIKE '503%'""")
def q_rules_isdn(spark, sf_dir):
    m = F.col("message_type")
    name = F.when(m == "INVITE", "SETUP").when(m == "180 Ringing", "ALERTING").when(m == "200 OK", "CONNECT").when(m == "ACK", "CALL PROCEEDING").when(m == "BYE", "DISCONNECT").otherwise("RELEASE COMPLETE")
    cause = F.when(m == "BYE", "0x8090 - Normal call clearing").when(m.startswith("503"), "0x80A2 - No circuit")
    e = voice_table(signal_events(spark, sf_dir)).withColumns({"session_id": F.col("call_id"), "protocol": F.lit("ISDN"), "cause_code": cause, "message_type": name})
    return anomalies.session_anomalies(e).select("session_id", "category", "severity", "expected_message", _ms("ts").alias("ts_ms"))


@query(f"""WITH {SIG}, c AS (SELECT call_id, count(*) AS n, count(*) FILTER (WHERE message_type LIKE '503%') AS bad FROM sig GROUP BY call_id)
  SELECT call_id, 'REFUSED' AS rule, 'ERROR' AS severity, bad || ' refused' AS description FROM c WHERE bad > 0 UNION ALL SELECT call_id, 'LONG', 'WARNING', n || ' events' FROM c WHERE n >= 8""")
def q_rule_table(spark, sf_dir):
    """Anomalies by a table of rules."""
    c = signal_events(spark, sf_dir).groupBy("call_id").agg(F.count("*").alias("n"), F.count_if(F.col("message_type").startswith("503")).alias("bad"))
    return anomalies.apply_rules(c, [("REFUSED", "bad > 0", "ERROR", "concat(bad, ' refused')"), ("LONG", "n >= 8", "WARNING", "concat(n, ' events')")], "call_id")


# --- scored correlation -------------------------------------------------------------------------------------------------------
def _one_number(spark, sf_dir) -> DataFrame:
    """Events whose called number is not told: of all that scoring sees, Call-IDs alone can tie them."""
    e = voice_table(signal_events(spark, sf_dir)).withColumn("called_number", F.lit(None).cast("string"))
    return e.withColumns({"seq_in_source": F.col("event_id"), "event_id": F.lpad(F.col("event_id").cast("string"), 12, "0")})


@query(f"""WITH {SIG} SELECT event_id, first_value(event_id) OVER (PARTITION BY call_id ORDER BY ts, event_id) AS session_id FROM sig""")
def q_scored_sessions(spark, sf_dir):
    """The greedy correlation: sessions are named by their first event."""
    x = scored.correlate_scored(_one_number(spark, sf_dir))
    return x.select(F.col("event_id").cast("long").alias("event_id"), F.col("session_id").cast("long").alias("session_id"))


@query(f"""WITH {SIG} SELECT event_id, min(event_id) OVER (PARTITION BY call_id) AS session_id FROM sig""")
def q_pair_links(spark, sf_dir):
    """Sessions as components of scored neighbours."""
    x = scored.pair_links(_one_number(spark, sf_dir))
    return x.select(F.col("event_id").cast("long").alias("event_id"), F.col("session_id").cast("long").alias("session_id"))


@query(f"""WITH {SIG} SELECT call_id, 1::BIGINT AS n_blocks, count(*) AS n FROM sig GROUP BY call_id""")
def q_scored_blocks(spark, sf_dir):
    """Blocks of events that can be worked on by themselves hold each call whole."""
    e = _one_number(spark, sf_dir)
    b = scored.blocks(materialize(scored.prepared(e), "prepared"))
    return e.select("event_id", "call_id").join(b, "event_id").groupBy("call_id").agg(F.count_distinct("block").alias("n_blocks"), F.count("*").alias("n"))


@query(f"""WITH {SIG}, g AS (SELECT *, lag(ts) OVER (PARTITION BY call_id ORDER BY ts) AS p FROM sig), i AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_ms(ts) - epoch_ms(p) >= 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY ts, event_id) AS k FROM g)
  SELECT call_id, epoch_ms(min(ts)) AS start_ms, epoch_ms(max(ts)) AS end_ms, count(*) AS event_count FROM i GROUP BY call_id, k""")
def q_live_sessions(spark, sf_dir):
    """Sessions by silence, as the stream builds them."""
    s = ingest.live_sessions(signal_events(spark, sf_dir), gap="1 hour")
    return s.select("call_id", _ms("start_time").alias("start_ms"), _ms("end_time").alias("end_ms"), "event_count")


def _numbered(spark, sf_dir) -> DataFrame:
    """Events that numbers and time alone can tie: each has a calling and one of two called numbers, in a time that runs 4,000 times as fast."""
    e = voice_table(signal_events(spark, sf_dir)).withColumns({"ts": F.expr("timestamp_micros(unix_micros(ts) div 4000)"), "called_number": (F.col("called_number").cast("int") % 2).cast("string"), "call_id": F.lit(None).cast("string")})
    return e.withColumns({"seq_in_source": F.col("event_id"), "event_id": F.lpad(F.col("event_id").cast("string"), 12, "0")})


#: Both numbers weigh 0.55 and time up to 0.15; another called number counts 0.60 against.
_BY_NUMBERS = f"""WITH {SIG}, e AS (SELECT event_id, source, calling_number AS a, called_number::INT % 2 AS b, (epoch_us(ts) // 4000) / 1e6 AS t FROM sig),
  g AS (SELECT *, 0.55::DOUBLE + 0.15::DOUBLE * (1 - (t - lag(t) OVER w) / 45.0::DOUBLE) >= 0.65::DOUBLE AS tied FROM e WINDOW w AS (PARTITION BY a, b ORDER BY t, source, event_id)),
  i AS (SELECT *, sum(CASE WHEN coalesce(tied, false) THEN 0 ELSE 1 END) OVER (PARTITION BY a, b ORDER BY t, source, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT event_id, first_value(event_id) OVER (PARTITION BY a, b, k ORDER BY t, source, event_id) AS session_id FROM i"""


@query(_BY_NUMBERS)
def q_scored_numbers(spark, sf_dir):
    """The greedy correlation where weights decide: numbers agree or conflict, and time takes a pair over the threshold or not."""
    x = scored.correlate_scored(_numbered(spark, sf_dir))
    return x.select(F.col("event_id").cast("long").alias("event_id"), F.col("session_id").cast("long").alias("session_id"))


@query(_BY_NUMBERS)
def q_scored_slices(spark, sf_dir):
    """The same in slices of time, 24 events of a block at once."""
    x = slices.correlate_sliced(_numbered(spark, sf_dir), size=24)
    return x.select(F.col("event_id").cast("long").alias("event_id"), F.col("session_id").cast("long").alias("session_id"))


@query(f"""WITH {SIG}, e AS (SELECT call_id, epoch_us(ts) AS us, CASE WHEN message_type = 'BYE' OR message_type LIKE '503%' THEN 'finish' WHEN message_type LIKE '180%' THEN 'ring' WHEN message_type = '200 OK' THEN 'answer' END AS sign FROM sig),
  g AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY call_id ORDER BY us) > 1800000000, true)::INT AS new FROM e), i AS (SELECT *, sum(new) OVER (PARTITION BY call_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS k FROM g),
  s AS (SELECT call_id, min(us) AS a, max(us) AS b, count(*) AS n, min(us) FILTER (WHERE sign = 'ring') AS ring, min(us) FILTER (WHERE sign = 'answer') AS answer, min(us) FILTER (WHERE sign = 'finish') AS finish FROM i GROUP BY call_id, k)
  SELECT call_id AS key, 'CLOSED' AS kind, b + 1800000000 AS at, n AS events FROM s
  UNION ALL SELECT call_id, 'NO_ANSWER', ring + 600000000, n FROM s WHERE ring IS NOT NULL AND NOT coalesce(answer <= ring + 600000000, false) AND NOT coalesce(finish <= ring + 600000000, false)""")
def q_call_findings(spark, sf_dir):
    """What the timers of the watched stream tell, of the whole table: sessions that closed, and calls that rang without an answer."""
    return monitor.session_findings(signal_events(spark, sf_dir), wait=600.0, gap=1800.0).select("key", "kind", "at", "events")


# --- what is told of a call -------------------------------------------------------------------------------------------------
@query(f"""WITH {SIG}, c AS (SELECT call_id, min(ts) AS s FROM sig GROUP BY call_id) SELECT event_id, call_id AS call_key, round((epoch_ms(ts) - epoch_ms(s)) / 1000.0, 3) AS offset_seconds FROM sig JOIN c USING (call_id)""")
def q_timeline(spark, sf_dir):
    e = sdl_table(signal_events(spark, sf_dir))
    return flow.timeline(e, e.groupBy("call_key").agg(F.min("ts").alias("start_time"))).select(F.col("event_id").cast("long").alias("event_id"), "call_key", "offset_seconds")


@query(f"""WITH {SIG} SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 50 <> 0 THEN ts END NULLS LAST, source, event_id) AS rank FROM sig""")
def q_unified_timeline(spark, sf_dir):
    """The place of every event among all events of all calls; those without a time come last."""
    e = sdl_table(signal_events(spark, sf_dir)).withColumn("ts", F.when(F.col("event_id").cast("long") % 50 != 0, F.col("ts")))
    return flow.unified_timeline(e).select(F.col("event_id").cast("long").alias("event_id"), "rank")


_IST = "strftime({} + INTERVAL 330 MINUTE, '%d-%b-%Y %H:%M:%S{}') || ' IST'"


@query(f"""WITH {SIG}, s AS (SELECT call_id, min(ts) AS a, max(ts) AS b FROM sig GROUP BY call_id) SELECT call_id, {_IST.format("a", "")} || ' → ' || {_IST.format("b", "")} AS time_range, round((epoch_ms(b) - epoch_ms(a)) / 1000.0, 3) AS seconds FROM s""")
def q_display_times(spark, sf_dir):
    """Times of calls in another zone, as ranges and lengths."""
    s = signal_events(spark, sf_dir).groupBy("call_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return s.select("call_id", display_range(F.col("a"), F.col("b")).alias("time_range"), seconds_between(F.col("a"), F.col("b")).alias("seconds"))


@query("""WITH d AS (SELECT event_id, event_id % 500 AS c FROM events) SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'N/A' WHEN c < 100 THEN (c * 10) || 'ms' ELSE printf('%d.%02ds', c // 100, c % 100) END AS text FROM d""")
def q_display_durations(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return e.select("event_id", display_duration(F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 500) / 100.0)).alias("text"))


_SECONDS = "printf('%d.%02ds', ((epoch_ms({b}) - epoch_ms({a}) + 5) // 10) // 100, ((epoch_ms({b}) - epoch_ms({a}) + 5) // 10) % 100)"


@query(f"""WITH {SIG}, n AS (SELECT *, row_number() OVER w AS i, epoch_ms(ts) - epoch_ms(lag(ts) OVER w) AS d, CASE message_type WHEN 'INVITE' THEN 'CALL_SETUP' WHEN '180 Ringing' THEN 'ALERTING' WHEN 'ACK' THEN 'ACTIVE' WHEN 'BYE' THEN 'DISCONNECT' WHEN '200 OK' THEN CASE WHEN lag(message_type) OVER w = 'BYE' THEN 'CALL_END' ELSE 'CONNECT' END ELSE 'CALL_END' END AS state
    FROM sig WINDOW w AS (PARTITION BY call_id ORDER BY ts, source, event_id))
  SELECT call_id AS call_key, sha256('### CALL METADATA' || chr(10) || '- Calling Party: ' || arg_min(calling_number, i) || chr(10) || '- Called Party: ' || arg_min(called_number, i) || chr(10) || '- Start Time (IST): ' || {_IST.format("min(ts)", "")} || chr(10) || '- End Time (IST): ' || {_IST.format("max(ts)", "")}
    || chr(10) || '- Duration: ' || {_SECONDS.format(a="min(ts)", b="max(ts)")} || chr(10) || '- CUCM Node(s): NODE1' || chr(10) || '- Protocol(s): SIP' || chr(10) || '- Device(s): None' || chr(10) || chr(10) || '### CORRELATED IDENTIFIERS' || chr(10) || '- CI: ' || arg_min(ci, i) || chr(10) || '- Call-ID: ' || call_id
    || chr(10) || chr(10) || '### CHRONOLOGICAL CALL FLOW' || chr(10) || string_agg('Step ' || i || ': [' || state || '] ' || message_type || ' (INTERNAL) (' || CASE WHEN i > 1 THEN '+' || d || 'ms' ELSE 'start' END || ') - ' || source || ':' || event_id, chr(10) ORDER BY i)
    || chr(10) || chr(10) || '### DETERMINISTIC ANOMALIES OBSERVED' || chr(10) || '- None detected.' || chr(10) || chr(10) || '### SUPPORTING RAW SDL EVIDENCE (EXACT TRACE LINES)' || chr(10)
    || string_agg('[' || source || ':' || event_id || ' @ ' || {_IST.format("ts", ".%g")} || '] Signal: ' || message_type || chr(10) || '```' || chr(10) || CASE WHEN message_type LIKE '503%' THEN 'SIP/2.0 ' ELSE '' END || message_type || chr(10) || '```', chr(10) ORDER BY i)) AS sha FROM n GROUP BY call_id""")
def q_pack_text(spark, sf_dir):
    """Whole texts of evidence packs, by their hashes; their anomalies, which other queries check, are left out here."""
    e = sdl_table(signal_events(spark, sf_dir))
    p = evidence.evidence_packs(correlate.build_calls(e), e).withColumn("anomalies", F.slice("anomalies", 1, 0))
    return evidence.pack_text(p, e).select("call_key", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))


@query(f"""WITH {SIG}, e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'SIP' WHEN event_id % 3 = 1 THEN 'ISDN' ELSE 'MGCP' END AS p FROM sig),
  s AS (SELECT call_id, arg_min(calling_number, (ts, source, event_id)) AS a, arg_min(called_number, (ts, source, event_id)) AS b, min(ts) AS t0, max(ts) AS t1, count(*) AS n, count(*) FILTER (WHERE p = 'SIP') AS sip, count(*) FILTER (WHERE p = 'ISDN') AS isdn, count(*) FILTER (WHERE p = 'MGCP') AS mgcp,
    string_agg(DISTINCT p, ', ' ORDER BY p) AS protocols, min(source) AS source, count(*) FILTER (WHERE message_type = 'BYE') AS found FROM e GROUP BY call_id)
  SELECT call_id AS session_id, call_id, CASE WHEN isdn > 0 AND mgcp > 0 THEN 'ISDN_MGCP' WHEN isdn > 0 AND sip > 0 THEN 'ISDN_SIP' WHEN sip > 0 AND mgcp = 0 THEN 'DIRECT_SIP' ELSE 'UNKNOWN' END AS architecture, a AS calling, a AS calling_number, b AS called, b AS called_number,
    {_IST.format("t0", "")} AS start, {_IST.format("t0", "")} AS start_time_ist, {_IST.format("t1", "")} AS "end", {_IST.format("t1", "")} AS end_time_ist, CASE WHEN epoch_ms(t1) - epoch_ms(t0) < 1000 THEN (epoch_ms(t1) - epoch_ms(t0)) || 'ms' ELSE {_SECONDS.format(a="t0", b="t1")} END AS duration,
    round((epoch_ms(t1) - epoch_ms(t0)) / 1000.0, 3) AS duration_seconds, protocols, source AS trace_sources, CASE WHEN sip + mgcp > 0 THEN 'High' ELSE 'Medium' END AS confidence_level, isdn, mgcp, sip, 0::BIGINT AS cucm, n AS event_count, '90%' AS confidence, found AS anomalies,
    CASE WHEN found > 0 THEN 'Anomalous' ELSE 'Normal' END AS status, 0::BIGINT AS ambiguities FROM s""")
def q_session_summaries(spark, sf_dir):
    """All summary fields of sessions of three protocols."""
    k = F.col("event_id") % 3
    e = voice_table(signal_events(spark, sf_dir)).withColumn("protocol", F.when(k == 0, "SIP").when(k == 1, "ISDN").otherwise("MGCP"))
    e = e.withColumns({"event_id": F.col("event_id").cast("string"), "seq_in_source": F.col("event_id")})
    links = e.select("event_id", F.col("call_id").alias("session_id"), F.lit(0.9).alias("confidence"), F.array(F.lit("one Call-ID")).alias("evidence"))
    return sessions.session_summaries(scored.build_sessions(e, links), e.join(links, "event_id").where("message_type = 'BYE'").select("session_id"))


@query(f"""WITH {SIG} SELECT call_id AS call_key, event_id AS source_line, message_type AS signal, {_IST.format("ts", ".%g")} AS timestamp_ist FROM sig""")
def q_key_evidence(spark, sf_dir):
    return evidence.key_evidence(sdl_table(signal_events(spark, sf_dir))).select("call_key", F.col("source_line").cast("long").alias("source_line"), "signal", "timestamp_ist")


@query(f"""WITH {SIG} SELECT CAST(event_id AS VARCHAR) AS event_id, {_IST.format("ts", ".%g")} AS time, 'SIP' AS protocol, 'INTERNAL' AS direction, message_type, calling_number, called_number, call_id, source, '-' AS device FROM sig""")
def q_event_rows(spark, sf_dir):
    e = voice_table(signal_events(spark, sf_dir)).withColumn("event_id", F.col("event_id").cast("string"))
    return evidence.event_rows(e)


@query(f"""WITH {SIG}, k AS (SELECT event_id, 'CI' AS kind, ci AS v FROM sig UNION ALL SELECT event_id, 'Call-ID', call_id FROM sig), f AS (SELECT kind, v, min(event_id) AS dst FROM k GROUP BY kind, v HAVING count(*) > 1),
  r AS (SELECT event_id, 'Linked via ' || kind || '=' || v AS reason FROM k JOIN f USING (kind, v) WHERE event_id <> dst) SELECT event_id, string_agg(reason, ';' ORDER BY reason) AS reasons FROM r GROUP BY event_id""")
def q_link_reasons(spark, sf_dir):
    """Why events are linked, by shared keys."""
    e = signal_events(spark, sf_dir).withColumn("called_number", F.lit(None).cast("string"))
    return correlate.link_reasons(e, {"Call-ID": "call_id", "CI": "ci"}).select("event_id", F.array_join("reasons", ";").alias("reasons"))


@query(f"""WITH {SIG}, s AS (SELECT call_id, epoch_ms(min(ts)) AS t FROM sig GROUP BY call_id), p AS (SELECT a.call_id AS a, b.call_id AS b FROM s a JOIN s b ON a.call_id < b.call_id AND abs(a.t - b.t) <= 30000)
  SELECT session_id, count(*) AS n_notes FROM (SELECT a AS session_id FROM p UNION ALL SELECT b FROM p) GROUP BY session_id""")
def q_simultaneous_notes(spark, sf_dir):
    s = signal_events(spark, sf_dir).groupBy(F.col("call_id").alias("session_id")).agg(F.min("ts").alias("start_time"))
    return sessions.noted(s, 30.0).select("session_id", F.size("notes").cast("long").alias("n_notes"))


@query(f"""WITH {SIG}, l AS (SELECT DISTINCT '+1 (800) 555-' || called_number AS a FROM sig), r AS (SELECT DISTINCT '1800555' || called_number AS b FROM sig WHERE event_id % 2 = 0)
  SELECT a, b FROM l JOIN r ON right(regexp_replace(a, '[^0-9]', '', 'g'), 7) = right(b, 7)""")
def q_number_pairs(spark, sf_dir):
    """Party numbers written in two ways."""
    e = signal_events(spark, sf_dir)
    left = e.select(F.concat(F.lit("+1 (800) 555-"), "called_number").alias("n")).distinct()
    right = e.where("event_id % 2 = 0").select(F.concat(F.lit("1800555"), "called_number").alias("n")).distinct()
    return sessions.number_pairs(left, right, "n", "n").select(F.col("left.n").alias("a"), F.col("right.n").alias("b"))


@query(f"""WITH {SIG}, c AS (SELECT call_id, min(ts) AS s, max(ts) AS e, arg_min(calling_number, (ts, event_id)) AS calling_number, arg_min(called_number, (ts, event_id)) AS called_number FROM sig GROUP BY call_id)
  SELECT call_id FROM c WHERE (calling_number LIKE '%03%' OR called_number LIKE '%03%') AND (strftime(s, '%Y-%m-%dT%H:%M:%S') LIKE '%01-0%' OR strftime(s, '%d-%b-%Y %H:%M:%S') LIKE '%01-0%')""")
def q_session_filter(spark, sf_dir):
    c = correlate.build_calls(sdl_table(signal_events(spark, sf_dir)))
    return search.session_filter(c, number="03", start="01-0").select(F.col("call_key").alias("call_id"))


@query(f"""WITH {SIG} SELECT event_id, epoch_ms(ts) AS ts_ms FROM sig ORDER BY ts, CAST(event_id AS BIGINT) LIMIT 50""")
def q_protocol_view(spark, sf_dir):
    """The first 50 events of a protocol, as a page shows them."""
    return search.protocol_view(signal_events(spark, sf_dir), "SIP").select("event_id", _ms("ts").alias("ts_ms"))


# --- reports --------------------------------------------------------------------------------------------------------------
def _sessions(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sessions, events with their session, anomalies)``: the Call-ID names the session."""
    e = voice_table(signal_events(spark, sf_dir)).withColumns({"event_id": F.col("event_id").cast("string"), "seq_in_source": F.col("event_id")})
    links = e.select("event_id", F.col("call_id").alias("session_id"), F.lit(0.9).alias("confidence"), F.array(F.lit("one Call-ID")).alias("evidence"))
    x = e.join(links, "event_id")
    return scored.build_sessions(e, links), x, anomalies.session_anomalies(x)


@query(f"""WITH {SIG} SELECT call_id AS session_id, arg_min(calling_number, (ts, source, event_id)) AS calling_number, arg_min(called_number, (ts, source, event_id)) AS called_number, epoch_ms(min(ts)) AS start_ms, count(*) AS event_count, count(*) AS sip, 0::BIGINT AS isdn,
  'DIRECT_SIP' AS architecture, 'High' AS confidence_level, 1 AS n_files, string_agg(DISTINCT call_id, ',') AS sip_call_ids, round((epoch_ms(max(ts)) - epoch_ms(min(ts))) / 1000.0, 3) AS duration_seconds FROM sig GROUP BY call_id""")
def q_session_table(spark, sf_dir):
    """Sessions from given links: numbers, bounds, sets of identifiers, counts, confidence."""
    s, _, _ = _sessions(spark, sf_dir)
    return s.select("session_id", "calling_number", "called_number", _ms("start_time").alias("start_ms"), "event_count", "sip", "isdn", "architecture", "confidence_level", F.size("trace_sources").alias("n_files"), F.array_join("sip_call_ids", ",").alias("sip_call_ids"), "duration_seconds")


@query(f"""WITH {SIG}, m AS (SELECT call_id, string_agg(message_type, '>' ORDER BY ts, event_id) AS timeline, count(*) AS n_sip FROM sig GROUP BY call_id),
  f AS (SELECT call_id, bool_or(message_type = 'INVITE') AS inv, bool_or(message_type = '180 Ringing') AS prov, bool_or(message_type = '200 OK') AS ok, bool_or(message_type = 'ACK') AS ack, bool_or(message_type = 'BYE') AS bye, min((ts, event_id)) FILTER (WHERE message_type = 'BYE') AS t_bye, max((ts, event_id)) FILTER (WHERE message_type = '200 OK') AS l_ok FROM sig GROUP BY call_id)
  SELECT call_id AS session_id, timeline, n_sip, CAST(inv AND NOT prov AND NOT ok AS BIGINT) + CAST(inv AND ok AND NOT ack AS BIGINT) + CAST(bye AND NOT coalesce(l_ok > t_bye, false) AS BIGINT) AS n_missing FROM m JOIN f USING (call_id)""")
def q_session_packs(spark, sf_dir):
    """Evidence of each session as nested columns."""
    p = reports.session_packs(*_sessions(spark, sf_dir))
    return p.select("session_id", F.array_join(F.transform("timeline", lambda e: e["message_type"]), ">").alias("timeline"), F.element_at("protocol_summaries", "SIP").alias("n_sip"), F.size("missing_expected_messages").cast("long").alias("n_missing"))


@query(f"""WITH {SIG} SELECT call_id AS session_id, string_agg(DISTINCT CASE WHEN event_id % 3 = 0 THEN source END, ',') AS sip_files, string_agg(DISTINCT CASE WHEN event_id % 3 = 1 THEN source END, ',') AS isdn_files, string_agg(DISTINCT CASE WHEN event_id % 3 = 2 THEN source END, ',') AS cucm_files FROM sig GROUP BY call_id""")
def q_files_by_protocol(spark, sf_dir):
    _, x, _ = _sessions(spark, sf_dir)
    k = F.col("event_id").cast("long") % 3
    f = reports.files_by_protocol(x.withColumns({"protocol": F.when(k == 0, "SIP").when(k == 1, "ISDN").otherwise("MGCP"), "trace_type": F.when(k == 2, "CUCM_SDL")}))
    text = lambda c: F.nullif(F.array_join(c, ","), F.lit("")).alias(c)
    return f.select("session_id", text("sip_files"), text("isdn_files"), text("cucm_files"))


_RULES = f"""{SIG}, f AS (SELECT call_id, bool_or(message_type = 'INVITE') AS inv, bool_or(message_type = '180 Ringing') AS prov, bool_or(message_type = '200 OK') AS ok, bool_or(message_type = 'ACK') AS ack, bool_or(message_type = 'BYE') AS bye,
  count(*) FILTER (WHERE message_type LIKE '503%') AS refused, count(*) AS n, min((ts, event_id)) FILTER (WHERE message_type = 'BYE') AS t_bye, max((ts, event_id)) FILTER (WHERE message_type = '200 OK') AS l_ok FROM sig GROUP BY call_id),
  a AS (SELECT *, CAST(inv AND NOT prov AND NOT ok AS BIGINT) + CAST(inv AND ok AND NOT ack AS BIGINT) + CAST(bye AND NOT coalesce(l_ok > t_bye, false) AS BIGINT) + refused AS anomalies, (inv AND ok AND NOT ack) OR refused > 0 AS bad FROM f)"""


@query(f"""WITH {_RULES} SELECT call_id AS session_id, anomalies AS n_anomalies, CASE WHEN anomalies = 0 OR bad THEN 'High' ELSE 'Low' END AS confidence, CASE WHEN anomalies = 0 THEN 'clean' WHEN bad THEN 'error' ELSE 'open' END AS verdict FROM a""")
def q_session_verdicts(spark, sf_dir):
    """Clean sessions, those with an error, and those without a known cause."""
    s, x, found = _sessions(spark, sf_dir)
    v = evidence.session_verdicts(s, found, evidence.architecture(x))
    kind = F.when(F.col("root_cause").startswith("Detected anomaly"), "error").when(F.col("n_anomalies") == 0, "clean").otherwise("open")
    return v.select("session_id", "n_anomalies", "confidence", kind.alias("verdict"))


@query(f"""WITH {_RULES} SELECT call_id AS session_id, CAST(2 + CAST(bad AS INT) AS BIGINT) AS n_facts, 1::BIGINT AS n_correlations, CAST(anomalies > 0 AND NOT bad AS BIGINT) AS n_hypotheses FROM a""")
def q_reasoning(spark, sf_dir):
    """What is seen, what ties it together, what is only possible."""
    s, x, found = _sessions(spark, sf_dir)
    r = reports.reasoning(s, evidence.architecture(x), flow.stage_latencies(x), found)
    return r.select("session_id", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("facts", "correlations", "hypotheses")])


@query(f"""WITH {_RULES} SELECT call_id AS session_id, n || ' signaling events over the path SIP → CUCM → SIP Phone. ' || CASE WHEN anomalies = 0 THEN 'No anomaly was found.' ELSE anomalies || ' anomalies were found' END AS text FROM a""")
def q_summary_text(spark, sf_dir):
    s, x, found = _sessions(spark, sf_dir)
    t = reports.summary(s, evidence.architecture(x), found)
    return t.select("session_id", F.regexp_replace("text", ", the first of them: .*$", "").alias("text"))


@query(f"""WITH {SIG}, n AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY ts, source, event_id) AS i FROM sig),
  l AS (SELECT call_id, string_agg('SIP ' || message_type || ' at ' || strftime(ts + INTERVAL 330 MINUTE, '%H:%M:%S') || ' in ' || source, chr(10) ORDER BY i) AS facts FROM n WHERE i <= 15 GROUP BY call_id),
  h AS (SELECT call_id, arg_min(calling_number, (ts, source, event_id)) AS a, arg_min(called_number, (ts, source, event_id)) AS b FROM sig GROUP BY call_id)
  SELECT call_id AS session_id, facts || chr(10) || chr(10) || 'Session ' || call_id || ' is tied together by Call-ID ' || call_id || '; calling number ' || a || '; called number ' || b || ' (confidence High).' AS text FROM l JOIN h USING (call_id)""")
def q_cross_protocol_text(spark, sf_dir):
    s, x, _ = _sessions(spark, sf_dir)
    return reports.cross_protocol_text(s, x)


@query(f"""WITH {_RULES} SELECT call_id AS "Call ID", n AS "SIP", anomalies AS "Anomalies" FROM a""")
def q_session_rows(spark, sf_dir):
    s, _, found = _sessions(spark, sf_dir)
    return reports.session_rows(s, found).select("Call ID", "SIP", "Anomalies")


@query(f"""WITH {_RULES} SELECT session_id, severity, likely_location, evidence FROM (SELECT call_id AS session_id, 'ERROR' AS severity, 'SIP Call Leg' AS likely_location, CAST(event_id AS VARCHAR) AS evidence FROM sig WHERE message_type LIKE '503%')""")
def q_findings(spark, sf_dir):
    """Refused calls as a report lists them."""
    _, _, found = _sessions(spark, sf_dir)
    return reports.findings(found.where("category = 'CAUSE_CODE'")).select("session_id", "severity", "likely_location", "evidence")


@query(f"""WITH {SIG}, c AS (SELECT call_id, min(ts) AS s, count(*) AS n, arg_min(calling_number, (ts, event_id)) AS a, arg_min(called_number, (ts, event_id)) AS b FROM sig GROUP BY call_id)
  SELECT call_id AS "Call ID", a AS "CALLING", b AS "CALLED", {_IST.format("s", "")} AS "TIMESTAMP IST", 'NODE1' AS "CUCM NODE", 'SIP' AS "PROTOCOL", n AS "EVENT COUNT" FROM c""")
def q_call_rows(spark, sf_dir):
    return reports.call_rows(correlate.build_calls(sdl_table(signal_events(spark, sf_dir))))


@query(f"""WITH {SIG}, f AS (SELECT call_id, min(ts) FILTER (WHERE message_type = 'INVITE') AS i, min(ts) FILTER (WHERE message_type = '200 OK') AS o FROM sig GROUP BY call_id)
  SELECT call_id AS session_id, 'SIP INVITE ➔ SIP 200 OK' AS "Transition", {_IST.format("i", ".%g")} AS "Start", {_IST.format("o", ".%g")} AS "End", CASE WHEN epoch_ms(o) - epoch_ms(i) > 30000 THEN 'Slow' ELSE 'Normal' END AS "Status" FROM f WHERE o >= i""")
def q_timing_rows(spark, sf_dir):
    _, x, _ = _sessions(spark, sf_dir)
    return reports.timing_rows(flow.stage_latencies(x)).where("Transition = 'SIP INVITE ➔ SIP 200 OK' AND Note LIKE 'Call answer%'").select("session_id", "Transition", "Start", "End", "Status")


@query(f"""WITH {SIG}, s AS (SELECT call_id, min(ts) AS t FROM sig GROUP BY call_id) (SELECT call_id AS session_id, 'earliest' AS kind FROM s ORDER BY t, call_id LIMIT 1) UNION ALL (SELECT max(call_id), 'chosen' FROM s)""")
def q_chosen_session(spark, sf_dir):
    """The session that a report is scoped to: the chosen one, else the earliest."""
    s, _, _ = _sessions(spark, sf_dir)
    last = s.agg(F.max("session_id").alias("m")).head().m
    one = lambda kind, value: reports.chosen_session(s, value).select("session_id", F.lit(kind).alias("kind"))
    return one("earliest", "no such session").unionByName(one("chosen", last))


@query(f"""WITH {_RULES} SELECT call_id AS session_id, CASE WHEN anomalies = 0 OR bad THEN 'High' ELSE 'Low' END AS confidence, n AS n_lines FROM a""")
def q_session_reports(spark, sf_dir):
    """A report per session: its stated confidence and the lines of its events."""
    s, x, found = _sessions(spark, sf_dir)
    arch = evidence.architecture(x)
    r = reports.session_reports(s, evidence.session_verdicts(s, found, arch), {"Summary": reports.summary(s, arch, found), "Events": reports.cross_protocol_text(s, x, first=1_000_000)})
    return r.select("session_id", F.regexp_extract("value", r"Confidence: (\w+)", 1).alias("confidence"), F.regexp_count("value", F.lit(r"(?m)^SIP .* in SDL_\d+\.txt$")).cast("long").alias("n_lines"))


# --- several protocols in one session -----------------------------------------------------------------------------------------
_ARCH = f"""{SIG}, p AS (SELECT call_id, CASE event_id % 5 WHEN 0 THEN 'ISDN' WHEN 1 THEN 'MGCP' WHEN 3 THEN 'CUCM' ELSE 'SIP' END AS p, event_id % 5 = 4 AS sdl FROM sig),
  f AS (SELECT call_id, count(*) FILTER (WHERE p = 'ISDN') AS n_isdn, count(*) FILTER (WHERE p = 'MGCP') AS n_mgcp, count(*) FILTER (WHERE p = 'SIP') AS n_sip, bool_or(p = 'ISDN') AS i, bool_or(p = 'MGCP') AS m, bool_or(p = 'SIP') AS s, bool_or(sdl) AS c FROM p GROUP BY call_id),
  k AS (SELECT *, CASE WHEN i AND m THEN 'ISDN_MGCP' WHEN i AND s THEN 'ISDN_SIP' WHEN s AND NOT m THEN 'DIRECT_SIP' WHEN m AND s THEN 'MGCP_SIP' WHEN m THEN 'MGCP_ONLY' ELSE 'UNKNOWN' END AS kind FROM f)"""


def _several(spark, sf_dir) -> DataFrame:
    """Events of four protocols in turn, some with a mark of call-manager records."""
    k = F.col("event_id") % 5
    e = voice_table(signal_events(spark, sf_dir)).withColumns({"session_id": F.col("call_id"), "protocol": F.when(k == 0, "ISDN").when(k == 1, "MGCP").when(k == 3, "CUCM").otherwise("SIP")})
    return e.withColumns({"raw": F.when(k == 4, "x |SdlSig |y").otherwise("plain"), "event_id": F.col("event_id").cast("string")})


@query(f"""WITH {_ARCH} SELECT call_id AS session_id, CASE WHEN kind LIKE 'MGCP%' THEN 'ISDN_MGCP' ELSE kind END AS architecture, n_isdn, n_mgcp, n_sip,
  round(CASE WHEN kind = 'ISDN_MGCP' THEN 0.9 + CASE WHEN s THEN 0.05 ELSE 0 END + CASE WHEN c THEN 0.05 ELSE 0 END WHEN kind = 'ISDN_SIP' THEN 0.9 + CASE WHEN c THEN 0.05 ELSE 0 END WHEN kind = 'DIRECT_SIP' THEN CASE WHEN c THEN 0.85 ELSE 0.7 END
    WHEN kind LIKE 'MGCP%' THEN CASE WHEN c THEN 0.7 ELSE 0.55 END ELSE 0.2 END, 2)::DOUBLE AS confidence_score,
  CASE WHEN kind LIKE 'ISDN%' THEN 'High' WHEN kind = 'DIRECT_SIP' THEN CASE WHEN c THEN 'High' ELSE 'Medium' END WHEN kind LIKE 'MGCP%' AND c THEN 'Medium' ELSE 'Low' END AS confidence FROM k""")
def q_architecture_mixed(spark, sf_dir):
    """All architectures: which protocols a session's events have."""
    return evidence.architecture(_several(spark, sf_dir)).select("session_id", "architecture", "n_isdn", "n_mgcp", "n_sip", "confidence_score", "confidence")


@query(f"""WITH {_ARCH} SELECT call_id AS session_id, concat_ws(';', CASE WHEN i THEN 'show isdn status;show voice port summary' END, CASE WHEN m THEN 'show mgcp endpoint;show ccm-manager' END, CASE WHEN s THEN 'show sip-ua status;show sip-ua calls' END) AS commands FROM k""")
def q_recommended_commands(spark, sf_dir):
    s, _, found = _sessions(spark, sf_dir)
    v = evidence.session_verdicts(s, found, evidence.architecture(_several(spark, sf_dir)))
    return v.select("session_id", F.array_join("recommended_commands", ";").alias("commands"))


@query(f"""WITH {_RULES} SELECT call_id AS session_id, concat_ws(';', CASE WHEN inv AND NOT prov AND NOT ok THEN '100 Trying or 180 Ringing' END, CASE WHEN bye AND NOT coalesce(l_ok > t_bye, false) THEN '200 OK' END, CASE WHEN inv AND ok AND NOT ack THEN 'ACK' END) AS missing FROM a WHERE anomalies > 0""")
def q_missing_messages(spark, sf_dir):
    s, x, found = _sessions(spark, sf_dir)
    v = evidence.session_verdicts(s, found, evidence.architecture(x)).where("n_anomalies > 0")
    return v.select("session_id", F.array_join("missing_messages", ";").alias("missing"))


@query(f"""WITH {SIG} SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN message_type IN ('INVITE', 'BYE') THEN call_id ELSE 'Uncorrelated' END AS session, message_type FROM sig""")
def q_event_json(spark, sf_dir):
    """Events as JSON with their session."""
    e = voice_table(signal_events(spark, sf_dir)).withColumn("event_id", F.col("event_id").cast("string"))
    links = e.where("message_type IN ('INVITE', 'BYE')").select("event_id", F.col("call_id").alias("session_id"))
    j = evidence.event_json(e, links)
    return j.select("event_id", F.get_json_object("value", "$.related_session").alias("session"), F.get_json_object("value", "$.message_type").alias("message_type"))


@query(f"""WITH {SIG}, n AS (SELECT *, row_number() OVER (PARTITION BY call_id, event_id % 5 = 0 ORDER BY ts, source, event_id) AS i FROM sig)
  SELECT call_id AS session_id, event_id % 5 = 0 AS isdn, string_agg('- ' || strftime(ts, '%H:%M:%S.%g') || ' INTERNAL ' || message_type, chr(10) ORDER BY i) AS text FROM n WHERE i <= 2 GROUP BY ALL""")
def q_protocol_digest(spark, sf_dir):
    """The first messages of each protocol in a session, a line each."""
    k = F.col("event_id") % 5
    e = voice_table(signal_events(spark, sf_dir)).withColumns({"session_id": F.col("call_id"), "protocol": F.when(k == 0, "ISDN").otherwise("SIP"), "seq_in_source": F.col("event_id")})
    return evidence.protocol_digest(e, first=2).select("session_id", (F.col("protocol") == "ISDN").alias("isdn"), "text")


@query(f"""WITH {SIG}, l AS (SELECT *, event_id % 4 AS k, row_number() OVER (PARTITION BY call_id ORDER BY ts, source, event_id) AS step_number FROM sig)
  SELECT call_id AS session_id, step_number, CASE k WHEN 0 THEN 'PSTN' WHEN 1 THEN 'Voice Gateway' WHEN 2 THEN 'CUCM' ELSE 'Voice Gateway' END AS actor_from, CASE k WHEN 0 THEN 'Voice Gateway' WHEN 1 THEN 'PSTN' WHEN 2 THEN 'Voice Gateway' ELSE 'CUCM' END AS actor_to,
    CASE k WHEN 0 THEN '──────▶' WHEN 1 THEN '◀──────' WHEN 2 THEN '◀──────' ELSE '──────▶' END AS arrow FROM l""")
def q_ladder_actors(spark, sf_dir):
    """Who speaks to whom, by protocol and direction."""
    k = F.col("event_id") % 4
    e = voice_table(signal_events(spark, sf_dir)).withColumns({"session_id": F.col("call_id"), "protocol": F.when(k < 2, "ISDN").when(k == 2, "MGCP").otherwise("SIP"), "direction": F.when(k % 2 == 0, "RX").otherwise("TX"), "seq_in_source": F.col("event_id")})
    return flow.ladder(e).select("session_id", "step_number", "actor_from", "actor_to", "arrow")


@query(f"""WITH {SIG} SELECT call_id AS session_id, count(*) + 2 AS n_lines FROM sig GROUP BY call_id""")
def q_ladder_text(spark, sf_dir):
    """A session's diagram: a head of two lines and a line per step."""
    _, x, _ = _sessions(spark, sf_dir)
    t = flow.ladder_text(flow.ladder(x))
    return t.select("session_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


# --- more of a call -------------------------------------------------------------------------------------------------------------
@query(f"""WITH {SIG} SELECT call_id AS call_key, row_number() OVER (PARTITION BY call_id ORDER BY ts, source, event_id) AS step_number, 'INTERNAL ' || message_type || ' (' || calling_number || ' -> ' || called_number || ')' AS summary FROM sig""")
def q_flow_steps(spark, sf_dir):
    return flow.flow_steps(sdl_table(signal_events(spark, sf_dir))).select("call_key", "step_number", "summary")


@query(f"""WITH {SIG}, g AS (SELECT *, (epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY call_id ORDER BY ts, source, event_id))) * 1.0 AS d FROM sig)
  SELECT call_id AS call_key, count(*) AS n_steps, count(*) AS n_evidence, coalesce(max(d) FILTER (WHERE d > 4000), 0)::DOUBLE AS max_gap_ms, min(event_id) AS first_line, max(event_id) AS last_line FROM g GROUP BY call_id""")
def q_evidence_packs(spark, sf_dir):
    """Evidence of each call as nested columns: flow, cited records, largest gap, lines."""
    e = sdl_table(signal_events(spark, sf_dir))
    p = evidence.evidence_packs(correlate.build_calls(e), e)
    return p.select("call_key", F.size("flow").cast("long").alias("n_steps"), F.size("evidence").cast("long").alias("n_evidence"), "timing.max_gap_ms", F.col("source_line_range.min_line").cast("long").alias("first_line"), F.col("source_line_range.max_line").cast("long").alias("last_line"))


@query(f"""WITH {SIG}, n AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY ts, source, event_id) AS i FROM sig), l AS (SELECT call_id, arg_max((i, message_type, ts, source, event_id), (ts, source, event_id)) AS v FROM n WHERE message_type = 'BYE' OR message_type LIKE '503%' GROUP BY call_id)
  SELECT call_id AS call_key, 'Step ' || v[1] || ' (' || v[2] || ') at ' || strftime(v[3], '%H:%M:%S.%g') || ' in ' || v[4] || ':' || v[5] AS failure_point FROM l""")
def q_failure_points(spark, sf_dir):
    """The last record that clears or refuses a call."""
    v = evidence.call_verdicts(sdl_table(signal_events(spark, sf_dir)))
    return v.where(F.col("failure_point").startswith("Step ")).select("call_key", "failure_point")


@query(f"""WITH {SIG}, l AS (SELECT call_id, count(*) AS n FROM sig GROUP BY call_id) SELECT call_id AS call_key, n AS n_steps FROM l""")
def q_call_reports(spark, sf_dir):
    """A report per call: its numbered steps."""
    e = sdl_table(signal_events(spark, sf_dir))
    r = evidence.call_reports(evidence.evidence_packs(correlate.build_calls(e), e), evidence.call_verdicts(e))
    return r.select("call_key", F.regexp_count("value", F.lit(r"(?m)^\d+\. \[")).cast("long").alias("n_steps"))


@query(f"""WITH {SIG}, c AS (SELECT call_id, min(ts) AS s, max(ts) AS e, arg_min(called_number, (ts, source, event_id)) AS called, arg_min(ci, (ts, source, event_id)) AS ci FROM sig GROUP BY call_id)
  SELECT call_id AS call_key FROM c WHERE called LIKE '%3%' AND (CAST(s AS DATE) = DATE '2024-01-05' OR CAST(e AS DATE) = DATE '2024-01-05')""")
def q_find_calls_of_day(spark, sf_dir):
    """Calls by called number and day."""
    return search.find_calls(correlate.build_calls(sdl_table(signal_events(spark, sf_dir))), called="3", date="2024-01-05").select("call_key")


@query(f"""WITH {SIG} SELECT DISTINCT source AS file_name, 2::BIGINT AS line_no, 'garbage' AS text FROM sig""")
def q_malformed_lines(spark, sf_dir):
    """Lines before the first record of a file, blank ones left out."""
    x = rendered_lines(signal_events(spark, sf_dir)).withColumn("line_no", F.col("line_no") + 3)
    junk = x.select("file_name").distinct().select("file_name", F.posexplode(F.array(F.lit("  "), F.lit("garbage"), F.lit(""))).alias("pos", "line")).select("file_name", (F.col("pos") + 1).alias("line_no"), "line")
    return framing.malformed_sdl(x.unionByName(junk), chunk=400).select("file_name", F.col("line_no").cast("long").alias("line_no"), "text")


@query(f"""WITH {SIG} SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ISDN' WHEN 1 THEN 'SIP' ELSE 'MGCP' END AS protocol FROM sig""")
def q_segments(spark, sf_dir):
    """The protocol of each message by itself."""
    e = signal_events(spark, sf_dir)
    part = lambda k: e.where(F.col("event_id") % 3 == k)
    x = isdn_rows(part(0)).unionByName(sip_rows(part(1))).unionByName(mgcp_rows(part(2)))
    return x.select("event_id", classify.segment_protocol(F.array_join("lines", "\n")).alias("protocol"))


@query(f"""WITH {SIG} SELECT event_id, array_to_string(list_sort(list_distinct(['0', 'x' || user_id, ci])), ',') AS plain, 'cdcc=x' || user_id || ',ci=' || ci AS named FROM sig""")
def q_correlation_tags(spark, sf_dir):
    """Tags of events, by value alone and with their kinds."""
    e = voice_table(signal_events(spark, sf_dir))
    user = F.concat(F.lit("x"), (F.col("calling_number").cast("long") - 1000).cast("string"))
    e = e.withColumns({"metadata": F.create_map(F.lit("ci"), F.col("ci"), F.lit("other"), F.lit("z")), "correlation_ids": F.create_map(F.lit("cdcc"), user, F.lit("app_corr"), F.lit("0"))})
    text = lambda compat: F.array_join(F.array_sort(scored.tags(compat)), ",")
    return e.select("event_id", text(True).alias("plain"), text(False).alias("named"))


@query(f"""WITH {SIG} SELECT event_id, message_type IN ('INVITE', '180 Ringing', '200 OK', 'BYE') AS seed FROM sig""")
def q_seed_events(spark, sf_dir):
    """Events that may begin a session by their message alone."""
    null = F.lit(None).cast("string")
    e = voice_table(signal_events(spark, sf_dir)).withColumns({"calling_number": null, "called_number": null, "call_id": null})
    return e.select("event_id", scored.seed_candidate().alias("seed"))


@query(f"""WITH {SIG} SELECT count(*) AS total_events, count(*) FILTER (WHERE event_id % 5 = 0) AS isdn_events, count(*) FILTER (WHERE event_id % 5 IN (2, 4)) AS sip_events, count(*) FILTER (WHERE event_id % 5 = 1) AS mgcp_events, count(*) FILTER (WHERE event_id % 5 = 3) AS cucm_events,
  epoch_ms(min(ts)) AS earliest_ms, epoch_ms(max(ts)) AS latest_ms FROM sig""")
def q_totals(spark, sf_dir):
    """Totals of a table of events of four protocols, and its bounds."""
    e = _several(spark, sf_dir)
    s = sessions.statistics(e, e.limit(0).select("event_id", "session_id"))
    return s.select("total_events", "isdn_events", "sip_events", "mgcp_events", "cucm_events", _ms("earliest").alias("earliest_ms"), _ms("latest").alias("latest_ms"))
