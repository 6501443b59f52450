"""From ordered lines to multi-line records.

Every function takes lines ``(file_name, line_no, line)`` and works in windows over chunks of ``chunk`` lines of a file, whose
running values are carried from chunk to chunk, so that one huge file does not end in one task. ``chunk=None`` takes whole files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltrace.functions import patterns as P
from calltrace.functions.columns import capture, offset_minutes

CHUNK = 100_000


def _file():
    return Window.partitionBy("file_name").orderBy("line_no")


def _text() -> Column:
    """The lines of a group, in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")


def _running(lines: DataFrame, chunk: int | None, sums: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    """Running sums, and last non-null values, over each file's lines; in chunks of ``chunk`` lines if given."""
    if chunk is None:
        return lines.withColumns({k: F.sum(c.cast("int")).over(_file()) for k, c in sums.items()} | {k: F.last(c, True).over(_file()) for k, c in lasts.items()})
    rows = lines.withColumn("_chunk", F.floor((F.col("line_no") - 1) / chunk)).withColumns({f"_s_{k}": c.cast("int") for k, c in sums.items()} | {f"_l_{k}": c for k, c in lasts.items()})
    # one row a chunk: what the chunks before it come to
    heads = rows.groupBy("file_name", "_chunk").agg(*[F.sum(f"_s_{k}").alias(f"_s_{k}") for k in sums], *[F.max_by(f"_l_{k}", F.when(F.col(f"_l_{k}").isNotNull(), F.col("line_no"))).alias(f"_l_{k}") for k in lasts])
    before = Window.partitionBy("file_name").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("file_name", "_chunk", *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums], *[F.last(f"_l_{k}", True).over(before).alias(f"_p_{k}") for k in lasts])
    inside = Window.partitionBy("file_name", "_chunk").orderBy("line_no")
    rows = rows.join(heads, ["file_name", "_chunk"])
    rows = rows.withColumns(
        {k: F.col(f"_b_{k}") + F.sum(f"_s_{k}").over(inside) for k in sums} | {k: F.coalesce(F.last(f"_l_{k}", True).over(inside), F.col(f"_p_{k}")) for k in lasts}
    )
    return rows.select(*lines.columns, *sums, *lasts)


def _sdl_lines(lines: DataFrame, chunk: int | None) -> DataFrame:
    line = F.regexp_replace("line", r"[\r\n]+$", "")
    x = lines.withColumn("line", line).withColumn("head", F.col("line").rlike(P.SDL_HEADER))
    kind = F.btrim(F.regexp_extract("line", P.SDL_HEADER, 3))
    top = F.col("head") & (kind == "FileHead")
    lasts = {
        "base_date": F.when(top, F.regexp_replace(capture(F.col("line"), P.FILEHEAD_DATE), "/", "-")),
        "offset": F.when(top, F.coalesce(offset_minutes(capture(F.col("line"), P.FILEHEAD_OFFSET)), F.lit(0))),
        "node": F.when(top, capture(F.col("line"), P.FILEHEAD_HOST)),
    }
    return _running(x, chunk, {"rec": F.col("head")}, lasts)


def frame_sdl(lines: DataFrame, node: str | None = None, base_date: str | None = None, chunk: int | None = CHUNK) -> DataFrame:
    """``(file_name, rec, source_line, seq, time, type, rest, header_line, raw_text, base_date, offset, node)`` per record.

    A header line opens a record, other lines continue it. Date, zone and node come from the last FileHead, from its own
    record on; a FileHead without a zone sets UTC.
    """
    x = _sdl_lines(lines, chunk).where("rec > 0")
    first = F.col("head")
    out = x.groupBy("file_name", "rec").agg(
        F.min("line_no").alias("source_line"), F.max(F.when(first, F.col("line"))).alias("header_line"), _text().alias("raw_text"),
        F.max(F.when(first, F.col("base_date"))).alias("base_date"), F.max(F.when(first, F.col("offset"))).alias("offset"), F.max(F.when(first, F.col("node"))).alias("node"),
    )
    part = lambda i: F.regexp_extract("header_line", P.SDL_HEADER, i)
    return out.select(
        "file_name", "rec", "source_line", capture(F.col("header_line"), P.SDL_HEADER, 1).alias("seq"), part(2).alias("time"), F.btrim(part(3)).alias("type"), part(4).alias("rest"), "header_line", "raw_text",
        F.coalesce("base_date", F.lit(base_date)).alias("base_date"), F.coalesce("offset", F.lit(0)).alias("offset"), F.coalesce("node", F.lit(node)).alias("node"),
    )


def malformed_sdl(lines: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """``(file_name, line_no, text, reason)``: non-blank lines before a file's first header."""
    x = _sdl_lines(lines, chunk).where("rec = 0").where(F.btrim("line") != "")
    return x.select("file_name", "line_no", F.col("line").alias("text"), F.lit("Line before first trace header").alias("reason"))


def frame_isdn(lines: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """``(file_name, block, source_line, header_line, raw)``: a block runs to the next ISDN header or the file's end."""
    s = F.btrim("line")
    x = _running(lines, chunk, {"block": s.rlike(P.ISDN_STRICT) | s.rlike(P.ISDN_FLEXIBLE)}, {}).where("block > 0")
    return x.groupBy("file_name", "block").agg(F.min("line_no").alias("source_line"), F.min_by(F.btrim("line"), "line_no").alias("header_line"), _text().alias("raw"))


def frame_sip(lines: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """``(file_name, block, source_line, header_line, timestamp_raw, direction, raw)``.

    A request or status line opens a block, a delimiter closes it. The stamp is that of the last banner, the direction that of
    the last marker, which a closing delimiter resets.
    """
    s = F.btrim("line")
    x = lines.withColumn("head", s.rlike(P.SIP_REQUEST) | s.rlike(P.SIP_STATUS))
    x = _running(x, chunk, {"block": F.col("head")}, {})
    x = x.withColumn("cut", (F.col("block") > 0) & ~F.col("head") & (s.startswith("<---") | s.startswith("---")))
    inside = Window.partitionBy("file_name", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("live", (F.col("block") > 0) & ~F.coalesce(F.max("cut").over(inside), F.lit(False)))
    marker = F.when(s.startswith("Received:") | s.contains("RX"), "INBOUND").when(s.startswith("Sent:") | s.contains("TX"), "OUTBOUND")
    mark = F.when(F.col("cut") & F.col("live"), "UNKNOWN").otherwise(marker)
    x = _running(x, chunk, {}, {"direction": mark, "stamp": F.when(F.col("line").rlike(P.SIP_BANNER), capture(F.col("line"), P.SIP_BANNER))})
    x = x.withColumn("direction", F.coalesce("direction", F.lit("UNKNOWN")))
    # a start line's own direction is that before any reset, which only a delimiter makes
    return x.where("live").groupBy("file_name", "block").agg(
        F.min("line_no").alias("source_line"), F.min_by(s, "line_no").alias("header_line"), F.min_by("stamp", "line_no").alias("timestamp_raw"), F.min_by("direction", "line_no").alias("direction"), _text().alias("raw")
    )


def _segments(lines: DataFrame, chunk: int | None) -> DataFrame:
    """Lines with ``segment``, ``v`` (verbs so far), ``led`` (a banner begins the segment) and ``before`` (verbs before the segment).

    All of it is carried from chunk to chunk in one row a chunk, so that lines are put into their chunks once and not for each running value.
    """
    x = lines.withColumn("_chunk", F.floor((F.col("line_no") - 1) / chunk) if chunk else F.lit(0).cast("long"))
    at = Window.partitionBy("file_name", "_chunk").orderBy("line_no")
    # a chunk's first line may also be opened by the chunk before
    x = x.withColumns({"_opens": F.col("banner") | F.coalesce(F.lag("shut").over(at), F.lit(False)), "_first": F.row_number().over(at) == 1, "_v": F.sum("verb").over(at)})
    opened = F.when(F.col("_opens"), F.col("line_no"))
    heads = x.groupBy("file_name", "_chunk").agg(
        F.sum(F.col("_opens").cast("int")).alias("n"), F.sum("verb").alias("v"), F.max_by("shut", "line_no").alias("shut"), F.max(F.col("_first") & F.col("_opens")).alias("own"),
        F.max_by("banner", opened).alias("led"), F.max_by(F.col("_v") - F.col("verb"), opened).alias("before"),
    )
    w = Window.partitionBy("file_name").orderBy("_chunk")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumns({"_given": F.coalesce(F.lag("shut").over(w), F.lit(False)), "_vs": F.coalesce(F.sum("v").over(past), F.lit(0))})
    more = F.col("_given") & ~F.col("own")
    heads = heads.withColumns({"led": F.when(F.col("n") > 0, F.col("led")).when(more, F.lit(False)), "before": F.when(F.col("n") > 0, F.col("_vs") + F.col("before")).when(more, F.col("_vs")), "n": F.col("n") + more.cast("int")})
    heads = heads.select("file_name", "_chunk", "_given", "_vs", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("_ns"), F.last("led", True).over(past).alias("_led"), F.last("before", True).over(past).alias("_before"))
    x = x.join(heads, ["file_name", "_chunk"]).withColumns({"_opens": F.col("_opens") | (F.col("_first") & F.col("_given")), "v": F.col("_vs") + F.col("_v")})
    return x.select(
        *lines.columns, "v", (F.col("_ns") + F.sum(F.col("_opens").cast("int")).over(at)).alias("segment"), F.coalesce(F.last(F.when(F.col("_opens"), F.col("banner")), True).over(at), F.col("_led")).alias("led"),
        F.coalesce(F.last(F.when(F.col("_opens"), F.col("v") - F.col("verb")), True).over(at), F.col("_before")).alias("before"),
    )


def frame_mgcp(lines: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """``(file_name, block, source_line, timestamp_raw, direction, peer_ip, peer_port, raw)``.

    A banner, or the line after a closing delimiter, begins a segment; each further command or response line in a segment
    begins a block without stamp and direction. Lines before a segment's first command count only after a banner.
    """
    x = lines.withColumns({"banner": F.col("line").rlike(P.MGCP_BANNER), "verb": (F.btrim("line").rlike(P.MGCP_COMMAND) | F.btrim("line").rlike(P.MGCP_RESPONSE)), "shut": F.btrim("line").startswith("<---")})
    x = _segments(x.withColumn("verb", (F.col("verb") & ~F.col("banner")).cast("int")), chunk)
    x = x.withColumn("k", F.col("v") - F.coalesce("before", F.lit(0))).where("k > 0 OR led")
    block = F.struct("segment", F.greatest("k", F.lit(1)).alias("k"))
    out = x.groupBy("file_name", block.alias("b")).agg(F.min("line_no").alias("source_line"), F.max(F.when(F.col("banner"), F.col("line"))).alias("banner"), F.max("verb").alias("some"), _text().alias("raw")).where("some > 0")
    text = F.col("banner")
    return out.select(
        "file_name", (F.col("b.segment") * 1000000 + F.col("b.k")).alias("block"), "source_line", capture(text, P.MGCP_BANNER).alias("timestamp_raw"),
        F.when(F.lower(capture(text, P.MGCP_BANNER, 2)).startswith("received"), "INBOUND").when(text.isNotNull(), "OUTBOUND").otherwise("UNKNOWN").alias("direction"),
        capture(text, P.MGCP_BANNER, 3).alias("peer_ip"), capture(text, P.MGCP_BANNER, 4).try_cast("int").alias("peer_port"), "raw",
    )
