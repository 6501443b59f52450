"""Searches over calls, events and knowledge; command safety, masking and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltrace.functions.work import materialize


def _contains(column: Column, word: str) -> Column:
    return F.coalesce(F.lower(column.cast("string")).contains(word.lower()), F.lit(False))


def find_calls(
    calls: DataFrame, calling: str | None = None, called: str | None = None, start=None, end=None, date: str | None = None, node: str | None = None, call_id: str | None = None, ci: str | None = None, cdcc: str | None = None,
    device: str | None = None, protocol: str | None = None,
) -> DataFrame:
    """Calls that meet all given criteria, by start: contained text for numbers, Call-ID, devices and nodes; equality for CI,
    CDCC and protocol (identifiers count as well); a date at either end; an overlapping interval."""
    out = calls
    for column, word in (("calling_number", calling), ("called_number", called), ("call_id", call_id)):
        if word is not None:
            out = out.where(_contains(F.col(column), word))
    for column, word in (("devices", device), ("nodes", node)):
        if word is not None:
            out = out.where(F.exists(column, lambda v: F.lower(v).contains(word.lower())))  # noqa: B023
    for column, kind, value in (("ci", "CI", ci), ("cdcc", "CDCC", cdcc)):
        if value is not None:
            hit = F.coalesce(F.col(column) == value, F.lit(False))
            if "identifiers" in calls.columns:
                hit = hit | F.exists("identifiers", lambda i: (i["key"] == kind) & (i["value"] == value))  # noqa: B023
            out = out.where(hit)
    if protocol is not None:
        out = out.where(F.exists("protocols", lambda v: F.upper(v) == protocol.upper()))
    if date is not None:
        day = F.lit(date).cast("date")
        out = out.where((F.to_date("start_time") == day) | (F.to_date("end_time") == day))
    if start is not None:
        out = out.where(F.col("end_time") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("start_time") <= F.lit(end))
    return out.orderBy("start_time")


def timeline_filter(events: DataFrame, protocols: list[str] | None = None, directions: list[str] | None = None, text: str | None = None, columns: tuple[str, ...] = ("message_type", "call_id", "calling_number", "called_number", "source", "raw")) -> DataFrame:
    """Events of given protocols and directions that hold a text in any of six columns."""
    out = events
    if protocols:
        out = out.where(F.col("protocol").isin(*protocols))
    if directions:
        out = out.where(F.col("direction").isin(*directions))
    if text:
        cond = F.lit(False)
        for c in columns:
            if c in events.columns:
                cond = cond | _contains(F.col(c), text)
        out = out.where(cond)
    return out


def session_filter(sessions: DataFrame, number: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    out = sessions
    if number:
        out = out.where(_contains(F.col("calling_number"), number) | _contains(F.col("called_number"), number))
    for column, word in (("start_time", start), ("end_time", end)):
        if word:
            out = out.where(_contains(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"), word) | _contains(F.date_format(column, "dd-MMM-yyyy HH:mm:ss"), word))
    return out


def protocol_view(events: DataFrame, protocol: str, most: int = 50) -> DataFrame:
    return events.where(F.col("protocol") == protocol).orderBy(F.col("ts").asc_nulls_last(), "event_id").limit(most)


def newest(files: DataFrame, modified: str = "modified") -> DataFrame:
    """The files modified last: all of them, where several share that time."""
    last = files.agg(F.max(modified).alias("_newest"))  # one row
    return files.join(F.broadcast(last), F.col(modified) == F.col("_newest")).select(*files.columns)


#: Tokens are words of at least so many characters, and the index holds pieces of words up to so many.
TOKEN, PIECE = 3, 32
#: Up to so many index rows go to every executor; a larger index meets the tokens in a shuffle.
INDEX_ROWS = 500_000
_WORDS = r"(?U)(\w+)"


def _words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORDS), F.lit(1)), lambda t: F.length(t) >= TOKEN)


def token_index(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(token, id, item_order, s)``: what each token scores with each item whose text contains it; and the long words, ``(head, word, id,
    item_order, field, w)``, for tokens that are longer than the index's pieces.

    A token holds word characters only, so a text contains it where one of the text's words does: the index holds all pieces of
    ``TOKEN`` to ``PIECE`` characters of the items' words, about ``PIECE`` per character.
    """
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "\n")
    fields = F.array(*[F.struct(F.lit(k).alias("field"), F.lit(w).alias("w"), F.array_distinct(_words(c)).alias("words")) for k, w, c in (("title", 5.0, F.col("title")), ("tags", 3.0, tags), ("description", 2.0, F.col("description")), ("details", 1.0, F.col("details")))])
    words = items.select("id", "item_order", F.explode(fields).alias("f")).select("id", "item_order", "f.field", "f.w", F.explode("f.words").alias("word"))
    size = F.length("word")
    at = words.withColumn("at", F.explode(F.sequence(F.lit(1), size - TOKEN + 1)))
    pieces = at.withColumn("n", F.explode(F.sequence(F.lit(TOKEN), F.least(F.lit(PIECE), size - F.col("at") + 1)))).select("id", "item_order", "field", "w", F.substring("word", F.col("at"), F.col("n")).alias("token"))
    index = pieces.groupBy("token", "id", "item_order", "field").agg(F.first("w").alias("w")).groupBy("token", "id", "item_order").agg(F.sum("w").alias("s"))
    long = at.where(size - F.col("at") + 1 > PIECE).select(F.substring("word", F.col("at"), F.lit(PIECE)).alias("head"), "word", "id", "item_order", "field", "w").distinct()
    return index, long


def search_items(queries: DataFrame, items: DataFrame, k: int = 5, query_id: str = "query_id", text: str = "query", category: str | None = None, confidence: str | None = None) -> DataFrame:
    """``(query_id, id, score, rank)``: the best ``k`` items of each query.

    Tokens are words of more than two characters; each adds 5 where the title contains it, 3 for any tag, 2 for the description
    and 1 for the details. Ties keep the items' order; a query without tokens gets the first ``k`` items. Tokens meet the items in
    equi joins with :func:`token_index`.
    """
    scored = items
    if category:
        scored = scored.where(F.lower("category") == category.lower())
    if confidence:
        scored = scored.where(F.lower("confidence") == confidence.lower())
    index, long = token_index(scored)
    q = queries.select(F.col(query_id), _words(F.col(text)).alias("tokens"))
    if not long.isEmpty():
        # the few query tokens that are longer than the index's pieces become rows of the index themselves
        over = q.select(F.explode("tokens").alias("token")).where(F.length("token") > PIECE).distinct().withColumn("head", F.substring("token", 1, PIECE))
        over = over.join(long, "head").where(F.col("word").contains(F.col("token"))).groupBy("token", "id", "item_order", "field").agg(F.first("w").alias("w"))
        index = index.unionByName(over.groupBy("token", "id", "item_order").agg(F.sum("w").alias("s")))
    # the index holds no token longer than a piece but those
    index = materialize(index, "token-index")
    near = F.broadcast if index.count() <= INDEX_ROWS else lambda df: df
    # all that is done for a query is done where its text went: tokens are counted, scored and ranked without another shuffle; a given
    # number of partitions is not coalesced, as their size says little of the hits that come of them
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = q.repartition(parts, query_id).select(query_id, F.explode("tokens").alias("token")).groupBy(query_id, "token").agg(F.count("*").alias("n"))
    found = each.join(near(index), "token").groupBy(query_id, "id", "item_order").agg(F.sum(F.col("n") * F.col("s")).alias("score"))
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), "item_order")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query_id, "id", "score", "rank")
    first = scored.orderBy("item_order").limit(k).select("id", F.lit(0.0).alias("score"), F.row_number().over(Window.orderBy("item_order")).alias("rank"))  # k rows
    return best.unionByName(q.where(F.size("tokens") == 0).select(query_id).join(F.broadcast(first)))


#: Commands that are not run. Fixed values.
BLOCKED = (
    "configure", "conf t", "config t", "write", "wr", "reload", "erase", "delete", "del", "format", "shutdown", "shut", "no", "reboot", "rmdir", "mkdir", "rm", "copy", "utils system restart", "utils system reboot",
    "utils system shutdown", "file delete",
)
#: Secrets and what takes their place. Fixed values.
SECRETS = (
    (r"(?i)(password\s+(?:\d+\s+)?)(\S+)", "$1********"),
    (r"(?i)(secret\s+(?:\d+\s+)?)(\S+)", "$1********"),
    (r"(?i)(crypto\s+isakmp\s+key\s+)(\S+)", "$1********"),
    (r"(?i)(pre-shared-key\s+)(\S+)", "$1********"),
    (r"(?i)(key-string\s+)(\S+)", "$1********"),
    (r"(?i)(community\s+)(\S+)", "$1********"),
    (r"(?i)(-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----)", "[REDACTED PRIVATE KEY]"),
    (r"""(?i)(api[_-]?key\s*[:=]\s*)['"]?(\S+?)['"]?(\s|$)""", "$1********$3"),
)


def mask_secrets(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for pattern, replacement in SECRETS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def command_safety(rows: DataFrame, command: str = "command") -> DataFrame:
    """``rows`` with ``is_safe`` and ``reason``: blocked if empty, equal to a blocked command or beginning with one and a space."""
    clean = F.lower(F.btrim(F.coalesce(F.col(command), F.lit(""))))
    bad = F.lit(False)
    for b in BLOCKED:
        bad = bad | (clean == b) | clean.startswith(b + " ")
    why = F.when(clean == "", "Command cannot be empty.").when(bad, F.format_string("Command '%s' is blocked by safety policy (configuration or state-altering commands are not permitted).", F.btrim(F.col(command))))
    return rows.withColumns({"is_safe": (clean != "") & ~bad, "reason": why})


def command_audit(rows: DataFrame, most: int = 200, limit_bytes: int = 65536) -> DataFrame:
    """Audit rows, newest first: status by safety and error, masked and truncated output."""
    x = command_safety(rows)
    out = mask_secrets(F.col("output"))
    status = F.when(~F.col("is_safe"), "BLOCKED").when(F.coalesce("error", F.lit("")) != "", "FAILED").otherwise("SUCCESS")
    return x.withColumns({"status": status, "output": truncated(out, limit_bytes), "error": F.coalesce("reason", "error")}).drop("is_safe", "reason").orderBy(F.desc("timestamp"), "entry_id").limit(most)


def truncated(text: Column, limit_bytes: int = 65536, compat: bool = False) -> Column:
    """Text of at most so many bytes, cut between characters, and a mark. ``compat``: tests bytes but keeps as many characters."""
    mark = F.lit("\n... [OUTPUT TRUNCATED]")
    if compat:
        kept = F.substring(text, 1, limit_bytes)
    else:
        data = F.encode(F.make_valid_utf8(text), "UTF-8")
        inside = lambda n: F.hex(F.substring(data, n + 1, 1)).between("80", "BF")  # noqa: E731 - whether a character goes on after n bytes
        ends = F.coalesce(*[F.when(~inside(n), n) for n in range(limit_bytes, max(limit_bytes - 4, 0), -1)], F.lit(0))
        kept = F.decode(F.substring(data, F.lit(1), ends), "UTF-8")
    return F.when(F.octet_length(text) > limit_bytes, F.concat(kept, mark)).otherwise(text)


def version_of(output: Column) -> Column:
    """The active version in a command's output."""
    return F.nullif(F.regexp_extract(output, r"(?i)(?:Active Master Version|version)\s*[:=]?\s*([0-9]+(?:\.[0-9]+)+(?:-[0-9]+)?)", 1), F.lit(""))
