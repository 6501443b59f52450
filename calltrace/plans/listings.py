"""Queries over listings, manifests, commands and observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from calltrace.functions.work import new_path
from calltrace.operators import evidence, reports, search, sessions
from calltrace.plans.base import query, table
from calltrace.plans.rendered import SIG, signal_events, voice_table
from calltrace.sources import traces
from calltrace.sources.versioned import VersionedTable

# --- listings and manifests -------------------------------------------------------------------------------------------------
_LISTED = f"""WITH {SIG}, l AS (SELECT event_id, 1000 + event_id * 37 AS size, ts, CASE event_id % 4 WHEN 0 THEN 'SDL001_' || event_id || '.txt.gz' WHEN 1 THEN 'SDL001_' || event_id || '.index' WHEN 2 THEN 'sdl_' || event_id || '.gzo' ELSE 'other_' || event_id || '.txt' END AS filename FROM sig),
  k AS (SELECT *, CASE event_id % 4 WHEN 1 THEN 'SDL_INDEX' WHEN 3 THEN 'SDL' ELSE 'SDL_TRACE' END AS trace_type FROM l)"""


def _listing(spark, sf_dir):
    """Output of a listing command: a line per event, headers and totals between them."""
    e = signal_events(spark, sf_dir)
    k = F.col("event_id") % 4
    name = F.when(k == 0, F.format_string("SDL001_%d.txt.gz", "event_id")).when(k == 1, F.format_string("SDL001_%d.index", "event_id")).when(k == 2, F.format_string("sdl_%d.gzo", "event_id")).otherwise(F.format_string("other_%d.txt", "event_id"))
    line = F.format_string("%s     %s  %s", F.date_format("ts", "dd MMM,yyyy HH:mm:ss"), F.format_number(F.col("event_id") * 37 + 1000, 0), name)
    rows = e.select(F.explode(F.array(line, F.when(F.col("event_id") % 100 == 0, "count = 5 files"))).alias("line")).where("line IS NOT NULL")
    return traces.parse_listing(rows, base="activelog/")


@query(f"""{_LISTED} SELECT filename, 'activelog/' || filename AS path, size AS size_bytes, epoch_ms(date_trunc('second', ts)) AS modified_ms, trace_type FROM k""")
def q_listing(spark, sf_dir):
    """Listing output, parsed."""
    return _listing(spark, sf_dir).select("filename", "path", "size_bytes", F.unix_millis("modified").alias("modified_ms"), "trace_type")


@query(f"""{_LISTED} SELECT trace_type, count(*) AS n, CAST(sum(size) AS BIGINT) AS size_bytes FROM k GROUP BY trace_type""")
def q_listing_totals(spark, sf_dir):
    return reports.listing_totals(_listing(spark, sf_dir))


@query(f"""{_LISTED} SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS size_bytes, round(sum(size) / 1048576.0, 2) AS size_mb FROM k WHERE trace_type = 'SDL_TRACE'""")
def q_selection_totals(spark, sf_dir):
    return sessions.selection_totals(_listing(spark, sf_dir).where("trace_type = 'SDL_TRACE'"))


@query(f"""{_LISTED} SELECT filename, size AS size_bytes FROM k WHERE date_trunc('second', ts) = (SELECT max(date_trunc('second', ts)) FROM k)""")
def q_newest_file(spark, sf_dir):
    """The last file of a listing."""
    return search.newest(_listing(spark, sf_dir)).select("filename", "size_bytes")


def _manifests(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    files = d.select(F.concat(F.lit("/n1/"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".gz").otherwise(".txt")).alias("file_name"), F.coalesce("text", F.lit("")).alias("content"), F.col("n_chars").alias("size_bytes"), F.lit(None).cast("timestamp").alias("modified"), "doc_id")
    m = traces.manifests(files, node="n1")
    return files, m.withColumns({"doc_id": F.regexp_extract("path", r"(\d+)$", 1).cast("long")}).withColumns({"kind": F.when(F.col("doc_id") % 7 == 0, "analysis").otherwise("file"), "collection_timestamp": F.col("doc_id") * 13 % 1009})


@query("""SELECT doc_id, sha256('/n1/' || doc_id) AS request_id, CASE WHEN doc_id % 3 = 0 THEN 'plain' ELSE 'plain' END AS extraction_method, strlen(coalesce(text, '')) AS extracted_size FROM documents WHERE doc_id % 7 <> 0""")
def q_manifest_list(spark, sf_dir):
    """Manifests without those of analyses."""
    return traces.listed_manifests(_manifests(spark, sf_dir)[1]).select("doc_id", "request_id", "extraction_method", "extracted_size")


@query("""SELECT doc_id, strlen(coalesce(text, '')) AS extracted_size FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)""")
def q_manifest_lookup(spark, sf_dir):
    m = _manifests(spark, sf_dir)[1]
    wanted = m.agg(F.max_by("request_id", "doc_id").alias("r")).head().r
    return traces.manifest_of(m, wanted).select("doc_id", "extracted_size")


@query("""SELECT count(*) AS n, sum(strlen(coalesce(text, ''))) / 1048576 AS total_mb FROM documents""")
def q_manifest_totals(spark, sf_dir):
    return traces.manifest_totals(_manifests(spark, sf_dir)[1]).select("n", "total_mb")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def q_manifests_left(spark, sf_dir):
    """What stays when listed manifests are deleted."""
    m = _manifests(spark, sf_dir)[1]
    gone = table(spark, sf_dir, "labels").select(F.sha2(F.concat(F.lit("/n1/"), F.col("doc_id").cast("string")).cast("binary"), 256).alias("request_id"))
    return traces.without(m, gone).select("doc_id")


@query("""SELECT doc_id, strlen(coalesce(text, '')) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS extracted_size FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) OR doc_id % 5 = 0""")
def q_manifest_versions(spark, sf_dir):
    """A versioned table of manifests: two appends, deletes that the first reader sees, rows put back in a revised form, and a fold."""
    m = _manifests(spark, sf_dir)[1].select("doc_id", "request_id", "extracted_size")
    gone = table(spark, sf_dir, "labels").select("doc_id").unionByName(m.where("doc_id % 5 = 0").select("doc_id"))
    t = VersionedTable(spark, new_path(spark, "manifest-table"))
    t.append(m.where("doc_id % 2 = 0"))
    t.append(m.where("doc_id % 2 = 1"), batch="odd")
    t.append(m.where("doc_id % 2 = 1"), batch="odd")  # a repeated batch adds nothing
    t.delete(gone, "doc_id")
    t.append(m.where("doc_id % 5 = 0").withColumn("extracted_size", F.col("extracted_size") + 1))
    t.compact()
    return t.read().select("doc_id", "extracted_size")


@query("""SELECT '/n1/' || doc_id AS path, true AS there FROM documents WHERE doc_id IN (SELECT doc_id * 2 FROM labels) UNION ALL SELECT DISTINCT '/n1/' || (doc_id * 2), false FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)""")
def q_selected_files(spark, sf_dir):
    """Files of chosen manifests, and the chosen ones that have no file."""
    files, _ = _manifests(spark, sf_dir)
    chosen = table(spark, sf_dir, "labels").select(F.concat(F.lit("/n1/"), (F.col("doc_id") * 2).cast("string")).alias("path"))
    there, missing = traces.selected_files(files, chosen)
    return there.select("path", F.lit(True).alias("there")).unionByName(missing.select("path", F.lit(False).alias("there")))


@query("""WITH n AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '/etc/x' WHEN 1 THEN 'a/../b' WHEN 2 THEN 'C:x' WHEN 3 THEN '' WHEN 4 THEN 'a..b.txt' WHEN 5 THEN '..' WHEN 6 THEN NULL ELSE 'ok/' || doc_id END AS name FROM documents) SELECT doc_id, doc_id % 8 NOT IN (4, 7) AS unsafe FROM n""")
def q_unsafe_names(spark, sf_dir):
    k = F.col("doc_id") % 8
    name = F.when(k == 0, "/etc/x").when(k == 1, "a/../b").when(k == 2, "C:x").when(k == 3, "").when(k == 4, "a..b.txt").when(k == 5, "..").when(k == 7, F.concat(F.lit("ok/"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", traces.unsafe_name(name).alias("unsafe"))


@query("""SELECT '/n1/' || doc_id AS path, sha256('File: ' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.gz' ELSE '.txt' END || chr(10) || 'Node: n1' || chr(10) || 'Size: ' || strlen(coalesce(text, '')) || ' bytes' || chr(10) || 'SHA-256: ' || sha256(coalesce(text, '')) || chr(10) || 'Generated: now' || chr(10) || repeat('=', 60) || chr(10) || coalesce(text, '')) AS sha FROM documents""")
def q_evidence_export(spark, sf_dir):
    """Whole texts under a head of their manifest's fields."""
    files, m = _manifests(spark, sf_dir)
    out = traces.evidence_export(files, m, "now")
    return out.select("path", F.sha2(F.encode("value", "UTF-8"), 256).alias("sha"))


# --- commands -----------------------------------------------------------------------------------------------------------------
def _commands(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("turn") % 4
    command = F.concat(F.when(k == 0, " show ").when(k == 1, "reload ").when(k == 2, "Show/Call ").otherwise("debug  "), "role")
    return c.withColumns({"command": command, "entry_id": F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role")})


_COMMANDS = """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE turn % 4 WHEN 0 THEN ' show ' WHEN 1 THEN 'reload ' WHEN 2 THEN 'Show/Call ' ELSE 'debug  ' END || coalesce(role, '') AS command FROM conversations)"""


@query(f"""{_COMMANDS} SELECT conv_id || '-' || turn || '-' || role AS entry_id, CASE WHEN turn % 4 = 1 THEN 'BLOCKED' WHEN turn % 4 = 3 THEN 'FAILED' ELSE 'SUCCESS' END AS status, 'x snmp community ******** ' || role AS output FROM c""")
def q_command_audit(spark, sf_dir):
    """All commands with their status and masked output."""
    rows = _commands(spark, sf_dir).withColumns({"output": F.concat(F.lit("x snmp community s3cret "), "role"), "error": F.when(F.col("turn") % 4 == 3, "timeout"), "timestamp": F.col("turn")})
    return search.command_audit(rows, most=2_000_000_000).select("entry_id", "status", "output")


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  k AS (SELECT *, list_max(list_filter(range(990, 1001), lambda b: strlen(t[1 : b - 990 + c]) <= 1000)) - 990 + c AS k FROM (SELECT *, list_max(list_filter(range(200, 1001, 10), lambda n: strlen(t[1 : n]) <= 1000)) AS c FROM t))
  SELECT doc_id, strlen(t) > 1000 AS cut, CASE WHEN strlen(t) > 1000 THEN sha256(t[1 : k] || chr(10) || '... [OUTPUT TRUNCATED]') ELSE sha256(t) END AS sha FROM k""")
def q_truncated(spark, sf_dir):
    """Output of at most so many bytes, cut between characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return d.select("doc_id", (F.octet_length("t") > 1000).alias("cut"), F.sha2(F.encode(search.truncated(F.col("t"), 1000), "UTF-8"), 256).alias("sha"))


_WS = "' ' || chr(9) || chr(13) || chr(10)"


@query(f"""{_COMMANDS}, p AS (SELECT *, trim(command) AS q, trim(text, {_WS}) AS o, CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN 'admin:' ELSE substr(trim(text, {_WS}), 1, 1) END AS prompt FROM c),
  r AS (SELECT *, CASE WHEN prompt <> '' AND o <> '' THEN CASE WHEN starts_with(o, prompt) THEN o ELSE prompt || q || chr(10) || chr(10) || o END WHEN prompt <> '' THEN prompt || q || chr(10) || '(No output or command returned empty)' WHEN o <> '' THEN o ELSE '(No output or command returned empty)' END AS answer FROM p)
  SELECT conv_id || '-' || turn || '-' || role AS entry_id, 'CUCM_10.0.0.1_' || lower(trim(regexp_replace(q, '[^a-zA-Z0-9]+', '-', 'g'), '-')) || '_20260920_164532.txt' AS file_name,
    sha256(repeat('=', 50) || chr(10) || 'Device Command Output' || chr(10) || repeat('=', 35) || chr(10) || chr(10) || 'Device Type : cucm' || chr(10) || 'Device IP   : 10.0.0.1' || chr(10) || 'Timestamp   : 2026-09-20 16:45:32' || chr(10) || 'Command     : ' || q || chr(10) || 'Status      : SUCCESS'
      || chr(10) || chr(10) || repeat('=', 50) || chr(10) || 'REQUEST' || chr(10) || repeat('=', 7) || chr(10) || chr(10) || q || chr(10) || chr(10) || repeat('=', 50) || chr(10) || 'RESPONSE' || chr(10) || repeat('=', 8) || chr(10) || chr(10) || answer || chr(10)) AS sha FROM r""")
def q_command_packages(spark, sf_dir):
    """Outputs as files with a head, and their names."""
    out = F.btrim("text", F.lit(" \t\r\n"))
    prompt = F.when(F.col("turn") % 3 == 1, "admin:").when(F.col("turn") % 3 == 2, F.substring(out, 1, 1))
    rows = _commands(spark, sf_dir).withColumns({"device_type": F.lit("cucm"), "ip": F.lit("10.0.0.1"), "status": F.lit("SUCCESS"), "output": F.col("text"), "prompt": prompt, "timestamp": F.lit("2026-09-20 16:45:32").cast("timestamp")})
    return reports.command_package(rows).select("entry_id", "file_name", F.sha2(F.encode("value", "UTF-8"), 256).alias("sha"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '15.' || (doc_id % 10) || '.1-' || doc_id END AS version FROM documents""")
def q_versions(spark, sf_dir):
    """Active versions in the outputs of commands."""
    k = F.col("doc_id")
    text = F.when(k % 3 == 0, "no such command").when(k % 3 == 1, F.format_string("Active Master Version: 15.%d.1-%d\nInactive: 1", k % 10, k)).otherwise(F.format_string("show\nversion = 15.%d.1-%d", k % 10, k))
    return table(spark, sf_dir, "documents").select("doc_id", search.version_of(text).alias("version"))


# --- observations ---------------------------------------------------------------------------------------------------------------
@query(f"""WITH {SIG}, o AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 'STATION' WHEN 1 THEN 'GENERIC' ELSE 'MGCP' END AS kind, row_number() OVER (ORDER BY ts, source, event_id) AS n FROM sig)
  SELECT event_id, kind FROM o WHERE kind <> 'GENERIC' OR n <= 500""")
def q_observations_ranked(spark, sf_dir):
    """Observations of a whole table: generic ones only among the first 500 of all kinds."""
    k = F.col("event_id") % 3
    raw = F.concat(F.format_string("%d |", "event_id"), F.when(k == 0, "x StationInit y").when(k == 1, "x |SdlSig |y").otherwise("x MGCPHandler y"))
    e = voice_table(signal_events(spark, sf_dir)).withColumn("raw", raw)
    return evidence.sdl_observations(e, most=500).select("event_id", "kind")


@query(f"""WITH {SIG}, k AS (SELECT *, event_id % 4 AS k, strftime(ts, '%H:%M:%S.%g') AS clock FROM sig WHERE event_id % 4 <> 3),
  n AS (SELECT *, CASE k WHEN 0 THEN 'MGCPHandler' WHEN 1 THEN message_type ELSE 'DeviceEventReceiptMonitoringTimer' END AS event_name, CASE k WHEN 0 THEN 'MGCPManager/MGCPHandler' WHEN 1 THEN 'SIPD' ELSE 'StationInit' END AS process_name,
    row_number() OVER (PARTITION BY call_id, clock, k, event_id ORDER BY ts) AS rn FROM k) SELECT call_id AS session_id, clock AS timestamp, event_name, process_name, count(*) AS n FROM n WHERE rn = 1 GROUP BY ALL""")
def q_observations(spark, sf_dir):
    """Observations of three kinds in call-manager records."""
    k = F.col("event_id") % 4
    raw = F.concat(F.format_string("%d |", "event_id"), F.when(k == 0, "x MGCPHandler y").when(k == 1, "x SIPD y").when(k == 2, "x StationInit y").otherwise("nothing"))
    e = voice_table(signal_events(spark, sf_dir)).withColumns({"raw": raw, "session_id": F.col("call_id"), "seq_in_source": F.col("event_id")})
    o = evidence.sdl_observations(e, partition="session_id")
    return o.groupBy("session_id", "timestamp", "event_name", "process_name").agg(F.count("*").alias("n"))


@query(f"""WITH {SIG} SELECT strftime(ts, '%H:%M:%S.%g') AS "Timestamp", message_type AS "Signal", 'SIPD' AS "Sending Process", 'N/A' AS "Device", 'CCM' AS "Application Name", count(*) AS n FROM sig GROUP BY ALL""")
def q_observation_rows(spark, sf_dir):
    """Observations as a table shows them."""
    raw = F.concat(F.format_string("%d |", "event_id"), F.lit("x SIPD y"))
    e = voice_table(signal_events(spark, sf_dir)).withColumns({"raw": raw, "session_id": F.col("call_id"), "seq_in_source": F.col("event_id")})
    rows = reports.observation_rows(evidence.sdl_observations(e, partition="session_id"))
    return rows.groupBy("Timestamp", "Signal", "Sending Process", "Device", "Application Name").agg(F.count("*").alias("n"))
