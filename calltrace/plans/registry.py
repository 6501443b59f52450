"""Registered queries of the trace operators and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calltrace.functions.columns import split_lines
from calltrace.functions.work import new_path
from calltrace.operators import anomalies, classify, correlate, evidence, flow, framing, machines, parsing, scored, search, sessions
from calltrace.plans import listings, voice  # noqa: F401 - they register their queries
from calltrace.plans.base import ORACLES, QUERIES, query  # noqa: F401
from calltrace.plans.base import table as _table
from calltrace.plans.rendered import CI, SIG, rendered_lines, sdl_table, signal_events, voice_table, whole_files
from calltrace.sources import trace_source, traces


def _ms(c: str):
    return F.unix_millis(c)


# --- framing and parsing ------------------------------------------------------------------------------------------------
@query(f"""WITH {SIG} SELECT event_id, epoch_ms(ts) AS ts_ms, message_type AS signal, call_id, ci, calling_number, called_number, source AS source_file,
  CASE WHEN message_type = 'INVITE' THEN 'INBOUND' ELSE 'INTERNAL' END AS direction, 'SIP' AS protocol FROM sig""")
def q_parse_roundtrip(spark, sf_dir):
    """Rendered traces, framed and parsed, give the events back."""
    out = parsing.sdl_events(rendered_lines(signal_events(spark, sf_dir)), CI).where("trace_type <> 'FileHead'")
    return out.select(F.substring_index("sequence_num", ".", 1).cast("long").alias("event_id"), _ms("ts").alias("ts_ms"), "signal", "call_id", "ci", "calling_number", "called_number", "source_file", "direction", "protocol")


_LINES = f"""WITH {SIG}, l AS (SELECT source, ts, event_id, CASE WHEN message_type = 'INVITE' THEN 5 ELSE 1 END AS n FROM sig)"""


@query(f"""{_LINES} SELECT source AS file_name, CAST(2 + sum(n) OVER (PARTITION BY source ORDER BY ts, event_id) - n AS BIGINT) AS source_line, CAST(n AS BIGINT) AS n_lines FROM l
  UNION ALL SELECT source, 1, 1 FROM l GROUP BY source""")
def q_frame_multiline(spark, sf_dir):
    """Records of one and of several lines, framed in chunks of a file."""
    x = framing.frame_sdl(rendered_lines(signal_events(spark, sf_dir)), chunk=500)
    return x.select("file_name", F.col("source_line").cast("long").alias("source_line"), F.size(split_lines(F.col("raw_text"))).cast("long").alias("n_lines"))


@query(f"""WITH {SIG} SELECT source AS file_name, event_id, CASE WHEN message_type = 'INVITE' THEN 5 ELSE 1 END::BIGINT AS n_lines, 'record' AS kind FROM sig""")
def q_source_records(spark, sf_dir):
    """Rendered traces written as files and read back by the trace source in ranges of 64 KB."""
    folder = new_path(spark, "trace-files")
    whole = whole_files(rendered_lines(signal_events(spark, sf_dir)))
    whole.select("file_name", F.col("content").alias("value")).write.partitionBy("file_name").text(folder)
    trace_source.register(spark)
    r = spark.read.format("calltrace").option("split_bytes", 65536).load(folder).where(~F.col("record").contains("|FileHead |"))
    return r.select(F.regexp_extract("path", "file_name=([^/]+)/", 1).alias("file_name"), F.substring_index("record", ".", 1).cast("long").alias("event_id"), "n_lines", "kind")


@query(f"""WITH {SIG} SELECT source AS file_name, 'NODE' || substr(source, 11, 2) AS node, substr(source, 5, 4) || '-' || substr(source, 9, 2) || '-' || substr(source, 11, 2) AS base_date, count(*) + 1 AS n FROM sig GROUP BY source""")
def q_filehead_ffill(spark, sf_dir):
    """Date and node of the FileHead, carried to every record of its file."""
    return framing.frame_sdl(rendered_lines(signal_events(spark, sf_dir))).groupBy("file_name", "node", "base_date").agg(F.count("*").alias("n"))


#: A pattern table for plain texts, in place of the trace formats'.
TEXT_PATTERNS = {"CONTACT": (r"[a-z0-9.]+@[a-z0-9.]+", r"\+[0-9]", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), "SECRET": (r"token = ", r"[0-9a-f]{32}"), "TABLE": (r" \| ",), "SHOUT": (r"[A-Z]{4,}!!", r"!!")}


def _counts_sql(column: str, table: dict) -> str:
    return ", ".join("(" + " + ".join(f"CAST(regexp_matches(coalesce({column}, ''), '{p}') AS INT)" for p in ps) + f") AS {k}" for k, ps in table.items())


@query(f"""WITH c AS (SELECT doc_id, {_counts_sql("text", TEXT_PATTERNS)} FROM documents)
  SELECT doc_id, CASE WHEN greatest(CONTACT, SECRET, "TABLE", SHOUT) < 1 THEN 'UNKNOWN' WHEN CONTACT = greatest(CONTACT, SECRET, "TABLE", SHOUT) THEN 'CONTACT' WHEN SECRET = greatest(CONTACT, SECRET, "TABLE", SHOUT) THEN 'SECRET'
    WHEN "TABLE" = greatest(CONTACT, SECRET, "TABLE", SHOUT) THEN 'TABLE' ELSE 'SHOUT' END AS label FROM c""".replace(") AS TABLE", ') AS "TABLE"'))
def q_classify_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", classify.primary_protocol(F.col("text"), TEXT_PATTERNS).alias("label"))


PAGE_PATTERNS = {"SCRIPT": ("<script",), "STYLE": ("<style",), "NAV": ("<nav", "<ul>"), "FRENCH": ('lang="fr"',), "ENTITY": ("&[a-z]+;",)}


@query(f"""WITH c AS (SELECT page_id, {_counts_sql("html", PAGE_PATTERNS)} FROM pages)
  SELECT page_id, array_to_string([x FOR x IN [CASE WHEN SCRIPT > 0 THEN 'SCRIPT' END, CASE WHEN STYLE > 0 THEN 'STYLE' END, CASE WHEN NAV > 0 THEN 'NAV' END, CASE WHEN FRENCH > 0 THEN 'FRENCH' END, CASE WHEN ENTITY > 0 THEN 'ENTITY' END] IF x IS NOT NULL], ',') AS markers FROM c""")
def q_detect_markers(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.array_join(classify.protocols_present(F.col("html"), PAGE_PATTERNS), ",").alias("markers"))


# --- correlation --------------------------------------------------------------------------------------------------------
@query(f"""WITH RECURSIVE {SIG}, keys AS (SELECT event_id, 'c' || call_id AS k FROM sig UNION ALL SELECT event_id, 'i' || ci FROM sig),
  near AS (SELECT DISTINCT a.event_id AS a, b.event_id AS b FROM keys a JOIN keys b USING (k) WHERE a.event_id <> b.event_id),
  reach AS (SELECT event_id, event_id AS other FROM sig UNION SELECT r.event_id, n.b FROM reach r JOIN near n ON r.other = n.a)
  SELECT event_id, min(other) AS component FROM reach GROUP BY event_id""")
def q_components(spark, sf_dir):
    """Connected components over Call-ID and CI."""
    out = correlate.link_events(signal_events(spark, sf_dir), {"Call-ID": "call_id", "CI": "ci"}, None)
    return out.select("event_id", F.col("call_key").alias("component"))


@query(f"""WITH {SIG} SELECT call_id AS call_key, epoch_ms(min(ts)) AS start_ms, epoch_ms(max(ts)) AS end_ms, count(*) AS event_count, arg_min(ci, (ts, event_id)) AS ci, arg_min(calling_number, (ts, event_id)) AS calling_number,
  arg_min(called_number, (ts, event_id)) AS called_number, round((epoch_ms(max(ts)) - epoch_ms(min(ts))) / 1000.0, 3) AS duration_seconds, 'Correlated by CUCM Call Identification CI=' || arg_min(ci, (ts, event_id)) AS reason FROM sig GROUP BY call_id""")
def q_calls(spark, sf_dir):
    c = correlate.build_calls(sdl_table(signal_events(spark, sf_dir)))
    return c.select("call_key", _ms("start_time").alias("start_ms"), _ms("end_time").alias("end_ms"), "event_count", "ci", "calling_number", "called_number", "duration_seconds", F.col("correlation_reasons")[0].alias("reason"))


@query(f"""WITH {SIG}, g AS (SELECT *, lag(ts) OVER w AS p FROM sig WINDOW w AS (PARTITION BY calling_number, called_number ORDER BY ts, event_id)),
  i AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_ms(ts) - epoch_ms(p) > 86400000 THEN 1 ELSE 0 END) OVER (PARTITION BY calling_number, called_number ORDER BY ts, event_id) AS island FROM g)
  SELECT min(event_id) AS island_id, count(*) AS n, calling_number, called_number, epoch_ms(min(ts)) AS start_ms FROM i GROUP BY calling_number, called_number, island""")
def q_proximity_islands(spark, sf_dir):
    """Events of one number pair linked over gaps of at most a day."""
    e = signal_events(spark, sf_dir)
    x = e.join(correlate.link_events(e, {}, 86400.0).withColumnRenamed("event_id", "_e"), F.col("event_id") == F.col("_e"))
    return x.groupBy("call_key", "calling_number", "called_number").agg(F.count("*").alias("n"), _ms(F.min("ts")).alias("start_ms"), F.min("event_id").alias("island_id")).drop("call_key")


def _voice(spark, sf_dir) -> DataFrame:
    return voice_table(signal_events(spark, sf_dir))


@query(f"""WITH {SIG}, n AS (SELECT *, lag(event_id) OVER w AS a, lag(called_number) OVER w AS c, lag(ts) OVER w AS t FROM sig WINDOW w AS (PARTITION BY call_id ORDER BY ts, event_id)),
  p AS (SELECT a, event_id AS b, CASE WHEN called_number = c THEN 0.55 ELSE -0.60 END AS num, abs(epoch_ms(ts) - epoch_ms(t)) / 1000.0 AS gap FROM n WHERE a IS NOT NULL)
  SELECT a, b, round(greatest(0, least(1, 0.65 + 0.55 + num + CASE WHEN gap <= 45 THEN 0.15 * (1 - gap / 45.0) ELSE -0.5 END)), 6) AS score FROM p""")
def q_pair_score(spark, sf_dir):
    """Affinity of each event and the one before it in its call."""
    rows = scored.prepared(_voice(spark, sf_dir))
    last = rows.select("event_id", F.lag("event_id").over(Window.partitionBy("call_id").orderBy("ts", "event_id")).alias("before")).where("before IS NOT NULL")
    pairs = last.alias("p").join(rows.alias("x"), F.col("p.before") == F.col("x.event_id")).join(rows.alias("y"), F.col("p.event_id") == F.col("y.event_id"))
    return pairs.select(F.col("x.event_id").alias("a"), F.col("y.event_id").alias("b"), F.round(scored.pair_score("x", "y"), 6).alias("score"))


def _links(e: DataFrame) -> DataFrame:
    """INVITE and BYE events belong to their call, the others to none."""
    own = e.where("message_type IN ('INVITE', 'BYE')")
    return own.select("event_id", F.col("call_id").alias("session_id"))


@query(f"""WITH {SIG}, own AS (SELECT * FROM sig WHERE message_type IN ('INVITE', 'BYE')), b AS (SELECT call_id, min(ts) AS s, max(ts) AS e FROM own GROUP BY call_id)
  SELECT call_id AS session_id, event_id, true AS own FROM own UNION ALL
  SELECT b.call_id, f.event_id, false FROM b JOIN sig f ON f.message_type NOT IN ('INVITE', 'BYE') AND epoch_ms(f.ts) BETWEEN epoch_ms(b.s) - 60000 AND epoch_ms(b.e) + 60000""")
def q_scoped_window(spark, sf_dir):
    e = signal_events(spark, sf_dir)
    links = _links(e)
    bounds = e.join(links, "event_id").groupBy("session_id").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    return sessions.scoped_events(e, links, bounds, 60)


@query(f"""WITH {SIG}, s AS (SELECT call_id, epoch_ms(min(ts)) AS t FROM sig GROUP BY call_id) SELECT a.call_id AS a, b.call_id AS b, round(abs(a.t - b.t) / 1000.0, 3) AS delta FROM s a JOIN s b ON a.call_id < b.call_id AND abs(a.t - b.t) <= 30000""")
def q_simultaneous(spark, sf_dir):
    s = signal_events(spark, sf_dir).groupBy(F.col("call_id").alias("session_id")).agg(F.min("ts").alias("start_time"))
    return sessions.simultaneous(s, 30.0)


@query(f"""WITH {SIG}, s AS (SELECT call_id, epoch_ms(min(ts)) AS t FROM sig GROUP BY call_id), p AS (SELECT a.call_id AS session_id, abs(a.t - b.t) AS d FROM s a JOIN s b ON a.call_id <> b.call_id AND abs(a.t - b.t) <= 600000),
  n AS (SELECT session_id, count(*) AS n, round(min(d) / 1000.0, 3) AS nearest FROM p GROUP BY session_id) SELECT call_id AS session_id, coalesce(n, 0) AS n, nearest FROM s LEFT JOIN n ON s.call_id = n.session_id""")
def q_simultaneous_counts(spark, sf_dir):
    """How many calls begin within ten minutes of each, without their pairs."""
    s = signal_events(spark, sf_dir).groupBy(F.col("call_id").alias("session_id")).agg(F.min("ts").alias("start_time"))
    return sessions.simultaneous_counts(s, 600.0)


# --- searches -----------------------------------------------------------------------------------------------------------
@query(f"""WITH {SIG}, c AS (SELECT call_id, min(ts) AS s, max(ts) AS e, arg_min(calling_number, (ts, event_id)) AS calling_number FROM sig GROUP BY call_id)
  SELECT call_id AS call_key, calling_number, epoch_ms(s) AS start_ms FROM c WHERE calling_number LIKE '%10%' AND e >= TIMESTAMP '2024-01-03' AND s <= TIMESTAMP '2024-01-20'""")
def q_find_calls(spark, sf_dir):
    c = correlate.build_calls(sdl_table(signal_events(spark, sf_dir)))
    found = search.find_calls(c, calling="10", node="node1", protocol="sip", start=F.lit("2024-01-03").cast("timestamp"), end=F.lit("2024-01-20").cast("timestamp"))
    return found.select("call_key", "calling_number", _ms("start_time").alias("start_ms"))


@query(f"WITH {SIG} SELECT event_id, message_type FROM sig WHERE lower(message_type) LIKE '%50%' OR calling_number LIKE '%50%' OR called_number LIKE '%50%' OR call_id LIKE '%50%'")
def q_timeline_filter(spark, sf_dir):
    e = signal_events(spark, sf_dir)
    return search.timeline_filter(e, ["SIP"], ["INTERNAL"], "50", ("message_type", "calling_number", "called_number", "call_id")).select("event_id", "message_type")


# --- order within a call --------------------------------------------------------------------------------------------------
_CLASS = "CASE message_type WHEN 'INVITE' THEN 'INVITE' WHEN '180 Ringing' THEN 'RINGING' WHEN '200 OK' THEN 'OK' WHEN 'ACK' THEN 'ACK' WHEN 'BYE' THEN 'BYE' ELSE 'REJECT' END"


@query(f"""WITH {SIG}, c AS (SELECT *, {_CLASS} AS c FROM sig), p AS (SELECT *, lag(c) OVER w AS pc FROM c WINDOW w AS (PARTITION BY call_id ORDER BY ts, event_id)),
  s AS (SELECT *, CASE c WHEN 'INVITE' THEN 'CALL_SETUP' WHEN 'RINGING' THEN 'ALERTING' WHEN 'OK' THEN CASE WHEN pc = 'BYE' THEN 'CALL_END' ELSE 'CONNECT' END WHEN 'ACK' THEN 'ACTIVE' WHEN 'BYE' THEN 'DISCONNECT' ELSE 'CALL_END' END AS st FROM p),
  f AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY call_id ORDER BY ts, event_id), 'IDLE') AS fs FROM s)
  SELECT event_id, call_id AS call_key, fs AS from_state, st AS to_state,
    CASE c WHEN 'INVITE' THEN fs IN ('IDLE', 'CALL_START') WHEN 'RINGING' THEN fs = 'CALL_SETUP' WHEN 'ACK' THEN fs = 'CONNECT' WHEN 'BYE' THEN fs IN ('ACTIVE', 'CONNECT', 'ALERTING') ELSE true END AS is_valid FROM f""")
def q_state_sip(spark, sf_dir):
    x = flow.call_transitions(sdl_table(signal_events(spark, sf_dir)))
    return x.select(F.col("event_id").cast("long").alias("event_id"), "call_key", "from_state", "to_state", "is_valid")


_TURNS = [("START", "system", "PRIMED"), ("START", "user", "ASKED"), ("PRIMED", "user", "ASKED"), ("ASKED", "assistant", "ANSWERED"), ("ANSWERED", "user", "ASKED")]


@query("""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS i FROM conversations)
  SELECT conv_id, count(*) AS n, CASE arg_max(role, i) FILTER (WHERE role IN ('user', 'assistant')) WHEN 'user' THEN 'ASKED' WHEN 'assistant' THEN CASE WHEN bool_or(role = 'user') THEN 'ANSWERED' END END AS last_state FROM t GROUP BY conv_id""")
def q_state_turns(spark, sf_dir):
    """A user-defined machine over the turns of conversations; turns without a transition leave the state."""
    table = spark.createDataFrame(_TURNS, "from_state string, symbol string, to_state string")
    x = machines.run_machine(_table(spark, sf_dir, "conversations"), table, "conv_id", ("turn", "role"), "role")
    return x.select("conv_id", F.col("n").cast("long").alias("n"), F.when(F.col("final_state").isin("ASKED", "ANSWERED"), F.col("final_state")).alias("last_state"))


#: A machine whose state depends on all that came before: a refused call is free only after a new call was answered.
_LINE = [
    ("FREE", "INVITE", "TRYING"), ("TRYING", "180 Ringing", "RINGING"), ("TRYING", "200 OK", "UP"), ("RINGING", "200 OK", "UP"), ("UP", "BYE", "FREE"), ("TRYING", "503 Service Unavailable", "REFUSED"), ("RINGING", "503 Service Unavailable", "REFUSED"),
    ("REFUSED", "INVITE", "AGAIN"), ("AGAIN", "200 OK", "UP"), ("AGAIN", "BYE", "REFUSED"),
]
_MOVED = "coalesce(CASE {s} || '>' || {m} " + " ".join(f"WHEN '{a}>{b}' THEN '{c}'" for a, b, c in _LINE) + " END, {s})"


@query(f"""WITH RECURSIVE {SIG}, s AS (SELECT event_id, k, message_type, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS i FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'trunk' ELSE calling_number END AS k FROM sig)),
  r AS (SELECT event_id, k, i, 'FREE' AS from_state, {_MOVED.format(s="'FREE'", m="message_type")} AS to_state FROM s WHERE i = 1
    UNION ALL SELECT s.event_id, s.k, s.i, r.to_state, {_MOVED.format(s="r.to_state", m="s.message_type")} FROM r JOIN s ON s.k = r.k AND s.i = r.i + 1)
  SELECT event_id, k AS line, from_state, to_state FROM r""")
def q_machine_rows(spark, sf_dir):
    """Every event's state before and after it; one line carries a third of all events."""
    e = signal_events(spark, sf_dir).select("event_id", "ts", "message_type", F.when(F.col("event_id") % 3 == 0, "trunk").otherwise(F.col("calling_number")).alias("line"))
    table = spark.createDataFrame(_LINE, "from_state string, symbol string, to_state string")
    return machines.machine_states(e, table, "line", ("ts", "event_id"), "message_type", "FREE").select("event_id", "line", "from_state", "to_state")


@query(f"""WITH {SIG}, g AS (SELECT *, row_number() OVER w AS step, lag(message_type) OVER w AS prior, (epoch_ms(ts) - epoch_ms(lag(ts) OVER w)) * 1.0 AS gap FROM sig WINDOW w AS (PARTITION BY call_id ORDER BY ts, event_id))
  SELECT call_id AS call_key, step, prior AS prior_event, message_type AS current_event, gap AS gap_ms FROM g WHERE gap > 4000""")
def q_flow_gaps(spark, sf_dir):
    return flow.large_gaps(flow.steps(sdl_table(signal_events(spark, sf_dir)))).drop("ts")


@query(f"""WITH {SIG}, f AS (SELECT call_id, bool_or(message_type = 'INVITE') AS i, bool_or(message_type = '180 Ringing') AS r, bool_or(message_type = '200 OK') AS o, bool_or(message_type = 'ACK') AS a, bool_or(message_type = 'BYE') AS b FROM sig GROUP BY call_id)
  SELECT call_id AS call_key, concat_ws(';', CASE WHEN i AND NOT r AND NOT o THEN '180 Ringing (No ringback signal observed)' END,
    CASE WHEN i AND r AND NOT o AND NOT b THEN '200 OK (Call alerted but never answered or terminated without 200 OK)' END, CASE WHEN i AND o AND NOT a THEN 'ACK (200 OK received without final SIP ACK)' END) AS missing FROM f""")
def q_milestones(spark, sf_dir):
    return flow.milestones(sdl_table(signal_events(spark, sf_dir))).select("call_key", F.array_join("missing", ";").alias("missing"))


@query(f"""WITH {SIG}, f AS (SELECT call_id, min(ts) FILTER (WHERE message_type = 'INVITE') AS i, min(ts) FILTER (WHERE message_type = '180 Ringing') AS r, min(ts) FILTER (WHERE message_type = '200 OK') AS o FROM sig GROUP BY call_id)
  SELECT call_id AS session_id, '180 Ringing' AS stage, round((epoch_ms(r) - epoch_ms(i)) * 1.0, 1) AS delta_ms, (epoch_ms(r) - epoch_ms(i)) > 3000 AS is_suspicious FROM f WHERE r >= i UNION ALL
  SELECT call_id, '200 OK', round((epoch_ms(o) - epoch_ms(i)) * 1.0, 1), (epoch_ms(o) - epoch_ms(i)) > 30000 FROM f WHERE o >= i""")
def q_stage_latency(spark, sf_dir):
    e = signal_events(spark, sf_dir).withColumn("session_id", F.col("call_id"))
    x = flow.stage_latencies(e).where(F.col("from_event").startswith("SIP INVITE") & ~F.col("note").startswith("Consecutive"))
    return x.select("session_id", F.regexp_replace("to_event", "^SIP ", "").alias("stage"), "delta_ms", "is_suspicious")


@query(f"""WITH {SIG} SELECT call_id AS session_id, row_number() OVER w AS step_number, (epoch_ms(ts) - epoch_ms(first_value(ts) OVER w)) * 1.0 AS time_offset_ms, 'Voice Gateway' AS actor_from, 'CUCM' AS actor_to, message_type AS message
  FROM sig WINDOW w AS (PARTITION BY call_id ORDER BY ts, event_id)""")
def q_ladder(spark, sf_dir):
    e = _voice(spark, sf_dir).withColumn("session_id", F.col("call_id"))
    return flow.ladder(e).select("session_id", "step_number", "time_offset_ms", "actor_from", "actor_to", "message")


# --- rules and verdicts ---------------------------------------------------------------------------------------------------
_FLAGS = """f AS (SELECT call_id, bool_or(message_type = 'INVITE') AS inv, bool_or(message_type = '180 Ringing') AS prov, bool_or(message_type = '200 OK') AS ok, bool_or(message_type = 'ACK') AS ack, bool_or(message_type = 'BYE') AS bye,
  min(ts) FILTER (WHERE message_type = 'INVITE') AS t_inv, min(ts) FILTER (WHERE message_type = '200 OK') AS t_ok, min((ts, event_id)) FILTER (WHERE message_type = 'BYE') AS t_bye, max((ts, event_id)) FILTER (WHERE message_type = '200 OK') AS l_ok FROM sig GROUP BY call_id)"""


@query(f"""WITH {SIG}, {_FLAGS}
  SELECT call_id AS session_id, 'MISSING_MESSAGE' AS category, 'WARNING' AS severity, '100 Trying or 180 Ringing' AS expected_message, epoch_ms(t_inv) AS ts_ms FROM f WHERE inv AND NOT prov AND NOT ok UNION ALL
  SELECT call_id, 'SEQUENCE_ERROR', 'ERROR', 'ACK', epoch_ms(t_ok) FROM f WHERE inv AND ok AND NOT ack UNION ALL
  SELECT call_id, 'MISSING_MESSAGE', 'WARNING', '200 OK', epoch_ms(t_bye[1]) FROM f WHERE bye AND NOT coalesce(l_ok > t_bye, false) UNION ALL
  SELECT call_id, 'CAUSE_CODE', 'ERROR', NULL, epoch_ms(ts) FROM sig WHERE message_type LIKE '503%'""")
def q_rules_sip(spark, sf_dir):
    e = _voice(spark, sf_dir).withColumn("session_id", F.col("call_id"))
    return anomalies.session_anomalies(e).select("session_id", "category", "severity", "expected_message", _ms("ts").alias("ts_ms"))


@query(f"""WITH {SIG}, t AS (SELECT call_id, ci, count(*) AS n, bool_or(message_type IN ('INVITE', 'BYE')) AS req, bool_or(message_type IN ('200 OK', '180 Ringing', '503 Service Unavailable')) AS res FROM sig GROUP BY call_id, ci)
  SELECT call_id AS session_id, ci AS transaction_id, n FROM t WHERE req AND NOT res""")
def q_rules_txn(spark, sf_dir):
    """Transactions (CI within a call) with a request and no response, by the MGCP rule over renamed messages."""
    m = F.when(F.col("message_type") == "INVITE", "CRCX").when(F.col("message_type") == "BYE", "DLCX").when(F.col("message_type") == "ACK", "NTFY").otherwise(F.col("message_type"))
    e = _voice(spark, sf_dir).withColumns({"session_id": F.col("call_id"), "transaction_id": F.col("ci"), "protocol": F.lit("MGCP"), "message_type": m})
    x = anomalies.session_anomalies(e).where("category = 'RESPONSE_TIMEOUT'")
    return x.select("session_id", F.regexp_extract("description", r"transaction (.+?) \(", 1).alias("transaction_id"), F.size("observed_messages").cast("long").alias("n"))


@query(f"WITH {SIG}, {_FLAGS} SELECT call_id AS call_key, epoch_ms(t_bye[1]) AS ts_ms FROM f WHERE inv AND bye AND NOT ok")
def q_premature(spark, sf_dir):
    x = anomalies.call_anomalies(sdl_table(signal_events(spark, sf_dir))).where("type = 'PREMATURE_DISCONNECT'")
    return x.select("call_key", F.unix_millis(F.get("evidence", F.lit(0))["ts"]).alias("ts_ms"))


@query(f"""WITH {SIG}, f AS (SELECT call_id, bool_or(message_type LIKE '503%') AS rej, bool_or(message_type = 'INVITE') AND bool_or(message_type = 'BYE') AND NOT bool_or(message_type = '200 OK') AS pre,
    bool_or(message_type = 'INVITE') AS i, bool_or(message_type = '180 Ringing') AS r, bool_or(message_type = '200 OK') AS o, bool_or(message_type = 'ACK') AS a, bool_or(message_type = 'BYE') AS b FROM sig GROUP BY call_id)
  SELECT call_id AS call_key, CASE WHEN rej THEN 'High' WHEN pre THEN 'Medium' WHEN (i AND NOT r AND NOT o) OR (i AND r AND NOT o AND NOT b) OR (i AND o AND NOT a) THEN 'Low' ELSE 'High' END AS confidence,
    CASE WHEN rej THEN 'The call was rejected. SIP failure response received: 503 Service Unavailable.' WHEN pre THEN '{evidence.PREMATURE_CAUSE}'
      WHEN (i AND NOT r AND NOT o) OR (i AND r AND NOT o AND NOT b) OR (i AND o AND NOT a) THEN '{evidence.MISSING_CAUSE}' ELSE '{evidence.NORMAL_CAUSE}' END AS root_cause FROM f""")
def q_verdict(spark, sf_dir):
    return evidence.call_verdicts(sdl_table(signal_events(spark, sf_dir))).select("call_key", "confidence", "root_cause")


@query(f"""WITH {SIG} SELECT call_id AS session_id, CASE WHEN count(*) > 0 THEN 'DIRECT_SIP' END AS architecture, count(*) AS n_sip, 0.7 AS confidence_score, 'Medium' AS confidence FROM sig GROUP BY call_id""")
def q_architecture(spark, sf_dir):
    e = _voice(spark, sf_dir).withColumn("session_id", F.col("call_id"))
    return evidence.architecture(e).select("session_id", "architecture", "n_sip", "confidence_score", "confidence")


# --- aggregates -----------------------------------------------------------------------------------------------------------
@query(f"""WITH {SIG} SELECT call_id, count(*) FILTER (WHERE message_type = 'INVITE') AS invite, count(*) FILTER (WHERE message_type = '180 Ringing') AS "180_ringing", count(*) FILTER (WHERE message_type = '200 OK') AS "200_ok", count(*) FILTER (WHERE message_type = 'BYE') AS bye FROM sig GROUP BY call_id""")
def q_session_pivot(spark, sf_dir):
    return sessions.protocol_counts(signal_events(spark, sf_dir), "call_id", ("INVITE", "180 Ringing", "200 OK", "BYE"), "message_type")


@query(f"""WITH {SIG} SELECT call_id AS session_id, epoch_ms(min(ts)) AS start_ms, round((epoch_ms(max(ts)) - epoch_ms(min(ts))) / 1000.0, 3) AS duration_seconds, count(*) AS event_count, arg_min(message_type, (ts, event_id)) AS first_message,
  arg_max(message_type, (ts, event_id)) AS last_message, count(DISTINCT message_type) AS distinct_messages FROM sig GROUP BY call_id""")
def q_summary(spark, sf_dir):
    x = sessions.summaries(signal_events(spark, sf_dir).withColumn("session_id", F.col("call_id")), order=("ts", "event_id"))
    return x.select("session_id", _ms("start_time").alias("start_ms"), "duration_seconds", "event_count", "first_message", "last_message", "distinct_messages")


@query(f"""WITH {SIG}, own AS (SELECT * FROM sig WHERE message_type IN ('INVITE', 'BYE')) SELECT (SELECT count(*) FROM sig) AS total_events, (SELECT count(*) FROM sig) AS sip_events, (SELECT count(DISTINCT source) FROM sig) AS source_files,
  (SELECT count(DISTINCT call_id) FROM own) AS correlated_calls, (SELECT count(*) FROM own) AS events_assigned_to_calls, (SELECT count(*) FROM sig) - (SELECT count(*) FROM own) AS events_not_assigned""")
def q_stats(spark, sf_dir):
    e = signal_events(spark, sf_dir)
    return sessions.statistics(e, _links(e)).select("total_events", "sip_events", "source_files", "correlated_calls", "events_assigned_to_calls", "events_not_assigned")


@query(f"""WITH {SIG}, m AS (SELECT source, message_type, min((ts, event_id)) AS pos FROM sig GROUP BY source, message_type) SELECT source, string_agg(message_type, ';' ORDER BY pos) AS messages FROM m GROUP BY source""")
def q_messages(spark, sf_dir):
    x = sessions.distinct_messages(signal_events(spark, sf_dir), "source")
    return x.select("source", F.array_join("messages", ";").alias("messages"))


@query("""WITH o AS (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders)
  SELECT o_orderkey, o_custkey FROM o WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31' OR (o_orderdate < TIMESTAMP '1995-01-01' AND nx >= TIMESTAMP '1995-01-01')""")
def q_file_select(spark, sf_dir):
    """Files of a window and the one before it, per node: orders stand for files."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    o = _table(spark, sf_dir, "orders").withColumn("modified", F.col("o_orderdate").cast("timestamp"))
    ts = lambda d: F.lit(d).cast("timestamp")
    return sessions.files_in_window(o, ts("1995-01-01"), ts("1995-03-31"), node="o_custkey", tie="o_orderkey").select("o_orderkey", "o_custkey")


# --- knowledge, masking, inventory ------------------------------------------------------------------------------------------
@query("""WITH q AS (SELECT doc_id, [t FOR t IN regexp_extract_all(lower(coalesce(text, '')), '([\\p{L}\\p{N}_]+)', 1) IF length(t) > 2] AS ts FROM documents),
  tok AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(ts) AS t FROM q) GROUP BY doc_id, t),
  it AS (SELECT item_id, array_to_string([w FOR w IN regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)', 1) IF length(w) > 8], ' ') AS title, lower(text) AS d FROM benchmark),
  hit AS (SELECT t, item_id, CASE WHEN contains(title, t) THEN 5.0 ELSE 0 END + CASE WHEN contains(d, t) THEN 2.0 ELSE 0 END AS s FROM (SELECT DISTINCT t FROM tok), it WHERE contains(d, t)),
  sc AS (SELECT doc_id, item_id, sum(n * s) AS score FROM tok JOIN hit USING (t) GROUP BY doc_id, item_id),
  emp AS (SELECT doc_id, item_id, 0.0 AS score FROM q, (SELECT item_id FROM it ORDER BY item_id LIMIT 3) WHERE len(ts) = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rank FROM (SELECT * FROM sc UNION ALL SELECT * FROM emp))
  SELECT doc_id AS query_id, CAST(item_id AS VARCHAR) AS id, CAST(score AS DOUBLE) AS score, rank FROM r WHERE rank <= 3""")
def q_knowledge_topk(spark, sf_dir):
    """The three best benchmark items for each document; an item's long words are its title."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    b = _table(spark, sf_dir, "benchmark")
    title = F.array_join(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), F.lit(1)), lambda w: F.length(w) > 8), " ")
    items = b.select(F.col("item_id").cast("string").alias("id"), F.col("item_id").alias("item_order"), title.alias("title"), F.col("text").alias("description"), F.lit("").alias("details"), F.array().cast("array<string>").alias("tags"))
    return search.search_items(d, items, 3)


@query("""WITH q AS (SELECT conv_id * 1000 + turn AS id, [t FOR t IN regexp_extract_all(lower(coalesce(text, '')), '([\\p{L}\\p{N}_]+)', 1) IF length(t) > 2] AS ts FROM conversations),
  tok AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(ts) AS t FROM q) GROUP BY id, t), it AS (SELECT item_id, lower(text) AS d, 'tag' || (item_id % 10) AS tag FROM benchmark WHERE item_id % 2 = 0 AND item_id % 3 <> 0),
  hit AS (SELECT t, item_id, CASE WHEN contains(tag, t) THEN 3.0 ELSE 0 END + CASE WHEN contains(d, t) THEN 1.0 ELSE 0 END AS s FROM (SELECT DISTINCT t FROM tok), it WHERE contains(d, t) OR contains(tag, t)),
  sc AS (SELECT id, item_id, sum(n * s) AS score FROM tok JOIN hit USING (t) GROUP BY id, item_id), emp AS (SELECT id, item_id, 0.0 AS score FROM q, (SELECT item_id FROM it ORDER BY item_id LIMIT 2) WHERE len(ts) = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, item_id) AS rank FROM (SELECT * FROM sc UNION ALL SELECT * FROM emp)) SELECT id AS query_id, CAST(item_id AS VARCHAR) AS item, CAST(score AS DOUBLE) AS score FROM r WHERE rank <= 2""")
def q_knowledge_filtered(spark, sf_dir):
    """The two best items of a category and a confidence for each turn of a conversation, by details and tags."""
    c = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    k = F.col("item_id")
    items = _table(spark, sf_dir, "benchmark").select(
        k.cast("string").alias("id"), k.alias("item_order"), F.lit("").alias("title"), F.lit("").alias("description"), F.col("text").alias("details"), F.array(F.concat(F.lit("tag"), (k % 10).cast("string"))).alias("tags"),
        F.when(k % 2 == 0, "Signal").otherwise("flow").alias("category"), F.when(k % 3 == 0, "draft").otherwise("Verified").alias("confidence"),
    )
    return search.search_items(c, items, 2, category="signal", confidence="verified").select("query_id", F.col("id").alias("item"), "score")


@query("""SELECT doc_id, sha256(coalesce(text, '') || chr(10) || 'username admin password 7 ********' || chr(10) || 'snmp-server community ******** RO' || chr(10) || 'api_key=******** end') AS masked_sha256 FROM documents""")
def q_mask_secrets(spark, sf_dir):
    """Secrets appended to each document, masked."""
    d = _table(spark, sf_dir, "documents")
    pw = F.concat(F.lit("pw"), F.col("doc_id").cast("string"))
    lines = F.concat(F.lit("\nusername admin password 7 "), pw, F.lit("\nsnmp-server community "), pw, F.lit(" RO\napi_key='"), pw, F.lit("' end"))
    return d.select("doc_id", F.sha2(F.encode(search.mask_secrets(F.concat(F.coalesce("text", F.lit("")), lines)), "UTF-8"), 256).alias("masked_sha256"))


_BAD = " OR ".join(f"c = '{b}' OR starts_with(c, '{b} ')" for b in search.BLOCKED)


@query(f"""WITH t AS (SELECT conv_id, turn, role, lower(trim(CASE turn % 6 WHEN 0 THEN 'show ' WHEN 1 THEN 'configure ' WHEN 2 THEN 'no ' WHEN 3 THEN 'Reload' WHEN 4 THEN 'notify ' ELSE 'wr ' END || CASE WHEN turn % 6 = 3 THEN '' ELSE role END)) AS c FROM conversations)
  SELECT conv_id, turn, role, NOT ({_BAD}) AS is_safe FROM t""")
def q_command_safety(spark, sf_dir):
    """Commands rendered from conversation turns, allowed or blocked."""
    k = F.col("turn") % 6
    verb = F.when(k == 0, "show ").when(k == 1, "configure ").when(k == 2, "no ").when(k == 3, "Reload").when(k == 4, "notify ").otherwise("wr ")
    x = _table(spark, sf_dir, "conversations").withColumn("command", F.concat(verb, F.when(k == 3, "").otherwise(F.col("role"))))
    return search.command_safety(x).select("conv_id", "turn", "role", "is_safe")


@query("""SELECT doc_id AS request_id, strlen(coalesce(text, '')) AS extracted_size, sha256(coalesce(text, '')) AS extracted_sha256 FROM documents""")
def q_inventory(spark, sf_dir):
    """Manifest rows of texts as files."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("doc_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), F.coalesce("text", F.lit("")).alias("content"), F.col("n_chars").alias("size_bytes"), F.lit(None).cast("timestamp").alias("modified"))
    m = traces.manifests(d)
    return m.select(F.col("path").cast("long").alias("request_id"), "extracted_size", "extracted_sha256")


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Render traces, frame and parse them, link their events into calls."""
    events = parsing.sdl_events(rendered_lines(signal_events(spark, sf_dir)), CI).where("trace_type <> 'FileHead'")
    calls, _ = correlate.correlate_sdl(events)
    return calls.select("call_key", "call_id", "ci", "calling_number", "called_number", "start_time", "end_time", "event_count", "protocols")
