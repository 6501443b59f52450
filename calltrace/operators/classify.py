"""Classification of files by content, protocol detection, inventories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltrace.functions import patterns as P
from calltrace.functions.columns import capture

#: Characters that the reference reads, and its private addresses. Fixed values.
SAMPLE = 150_000
PRIVATE_IP = r"\b(10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[0-1])\.\d{1,3}\.\d{1,3})\b"

#: Patterns of a file's address and name, first ones first, and the characters that the reference reads for each.
DEVICE_IP = (
    (10000, r"HostIPAddress:\s*(?:::ffff:)?(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"),
    (50000, r"(?:Sent:|Received:).*?to\s+(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}):\d+"),
    (20000, PRIVATE_IP),
)
DEVICE_NAME = ((10000, r"HostName:\s*([^\s,]+)"), (30000, r"@([A-Za-z0-9_-]+)\.[A-Za-z0-9_.-]+\.cisco\.com"), (20000, r"\n([A-Za-z0-9_-]{3,15})[#>]"))
#: Lines of a piece of a file, and how many lines with text a match of the tables' patterns may span.
PIECE, SPAN = 2_000, 4


def labels(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """Labels of the patterns found, each once, in the table's order."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(name)) for p, name in table]), lambda x: x.isNotNull())


def device_ip(text: Column, compat: bool = False) -> Column:
    """``compat``: only the beginning is read, as far as the reference does."""
    head = lambda n: F.substring(text, 1, n) if compat else text
    return F.coalesce(*[capture(head(n), p) for n, p in DEVICE_IP])


def device_name(text: Column, compat: bool = False) -> Column:
    head = lambda n: F.substring(text, 1, n) if compat else text
    return F.coalesce(*[capture(head(n), p) for n, p in DEVICE_NAME])


def _key(files: DataFrame) -> str:
    return "path" if "path" in files.columns else "file_name"


def classify(files: DataFrame, text: str = "content", name: str | None = None, as_of: str = "20260920_000000", tables: dict | None = None, compat: bool = False) -> DataFrame:
    """``(file_name, trace_type, device_type, device_name, device_ip, confidence, evidence, recommended_filename)`` per file.

    Content decides: labels of five families are counted over the whole text (``compat``: its first 150,000 characters) and met by an ordered list of
    rules; a file without enough marks falls back on its base name. ``file_name`` is the column ``name``, else the path where there is one. Null and blank texts are UNKNOWN at 0.
    """
    tables = tables or P.CLASSES
    sample = F.substring(F.coalesce(F.col(text), F.lit("")), 1, SAMPLE) if compat else F.coalesce(F.col(text), F.lit(""))
    x = files.select(F.col(name or _key(files)).alias("file_name"), F.col(text).alias("_text"), sample.alias("_sample")).withColumns({f"_{k.lower()}": labels(F.col("_sample"), t) for k, t in tables.items()})
    x = x.withColumns({"_blank": F.btrim(F.coalesce("_text", F.lit(""))) == "", "_cube": F.lower("_sample").contains("cube"), "_ip": device_ip(F.col("_text"), compat), "_host": device_name(F.col("_text"), compat)})
    return _classes(x, as_of)


def _by_file(lines: DataFrame, flags: dict[str, Callable[[Column, Column], Column]], firsts: dict[str, str], size: int = PIECE) -> DataFrame:
    """``(file_name, flags, firsts, pieces)`` of files given by their lines: whether a flag holds anywhere (it is given a text and the text in lower case), and
    what the first match of a pattern captures.

    A file is read in pieces of ``size`` lines, each by itself; where two pieces meet, the last lines with text of one and the first of the next are a
    piece too. So a match is found if it lies in one piece, or over at most ``SPAN`` lines with text, whatever the blank lines between them.
    """
    few = rf"\A(?:\s*\S[^\n]*\n?){{1,{SPAN}}}"
    first = lambda p, at: F.when(F.regexp_extract("text", p, 1) != "", F.struct(at.alias("at"), F.regexp_extract("text", p, 1).alias("value")))
    texts = lines.groupBy("file_name", F.floor((F.col("line_no") - 1) / size).cast("double").alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n").alias("text"))
    texts = texts.withColumns({"low": F.lower("text"), "top": F.regexp_extract("text", few, 0), "end": F.reverse(F.regexp_extract(F.reverse("text"), few, 0))})
    side = F.struct("piece", "top", "end", (F.length("top") >= F.length(F.rtrim("text"))).alias("short"))
    own = texts.select("file_name", "piece", side.alias("side"), *[f(F.col("text"), F.col("low")).alias(k) for k, f in flags.items()], *[first(p, F.col("piece")).alias(k) for k, p in firsts.items()])
    own = own.groupBy("file_name").agg(
        *[F.max(k).alias(k) for k in flags], *[F.min(k).alias(k) for k in firsts], F.count("*").alias("pieces"), F.array_sort(F.collect_list(F.when(F.col("side.top") != "", F.col("side")))).alias("sides")
    )

    def seam(i: Column) -> Column:
        at = lambda k: F.get("sides", i + k)
        here, near = at(0), at(1)
        after = [near["top"], F.when(near["short"], at(2)["top"]), F.when(near["short"] & at(2)["short"], at(3)["top"])]
        return F.struct((here["piece"] + 0.5).alias("at"), F.concat_ws("\n", here["end"], *after).alias("text"))

    n = F.size("sides")
    seams = own.select("file_name", "pieces", *flags, *firsts, F.explode_outer(F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), seam))).alias("seam"))
    seams = seams.withColumns({"text": F.coalesce("seam.text", F.lit("")), "low": F.lower(F.coalesce("seam.text", F.lit("")))})
    out = seams.groupBy("file_name").agg(
        *[F.max(F.col(k) | f(F.col("text"), F.col("low"))).alias(k) for k, f in flags.items()], *[F.min(F.least(F.col(k), first(p, F.col("seam.at")))).alias(k) for k, p in firsts.items()], F.max("pieces").alias("pieces")
    )
    return out.select("file_name", *flags, *[F.col(f"{k}.value").alias(k) for k in firsts], "pieces")


def _found(pattern: str) -> Callable[[Column, Column], Column]:
    needle = P.NEEDLES.get(pattern)
    return lambda text, low: text.rlike(pattern) if needle is None else low.contains(needle) & text.rlike(pattern)


def classify_lines(lines: DataFrame, as_of: str = "20260920_000000", tables: dict | None = None, size: int = PIECE) -> DataFrame:
    """:func:`classify` of the files that ``(file_name, line_no, line)`` make up, without a file's whole text in any row; see :func:`_by_file`."""
    tables = tables or P.CLASSES
    flags = {f"{k}_{i}": _found(p) for k, t in tables.items() for i, (p, _) in enumerate(t)} | {"_cube": lambda text, low: low.contains("cube"), "_marked": lambda text, low: F.btrim(text) != ""}
    firsts = {f"_{k}_{i}": p for k, ps in (("ip", DEVICE_IP), ("host", DEVICE_NAME)) for i, (_, p) in enumerate(ps)}
    x = _by_file(lines, flags, firsts, size)
    named = {f"_{k.lower()}": F.filter(F.array(*[F.when(F.col(f"{k}_{i}"), F.lit(name)) for i, (_, name) in enumerate(t)]), lambda e: e.isNotNull()) for k, t in tables.items()}
    x = x.withColumns(named | {"_blank": ~F.col("_marked") & (F.col("pieces") == 1), "_ip": F.coalesce(*[f"_ip_{i}" for i in range(len(DEVICE_IP))]), "_host": F.coalesce(*[f"_host_{i}" for i in range(len(DEVICE_NAME))])})
    return _classes(x, as_of)


def protocols_of_lines(lines: DataFrame, table: dict[str, tuple[str, ...]] | None = None, size: int = PIECE) -> DataFrame:
    """``(file_name, protocol)``: :func:`protocols_present` of the files that ``(file_name, line_no, line)`` make up, a row each."""
    table = table or P.PRIMARY
    x = _by_file(lines, {f"{k}_{i}": _found(p) for k, ps in table.items() for i, p in enumerate(ps)}, {}, size)
    some = F.array(*[F.when(F.greatest(F.lit(False), *[F.col(f"{k}_{i}") for i in range(len(ps))]), k) for k, ps in table.items()])
    return x.select("file_name", F.explode(F.filter(some, lambda e: e.isNotNull())).alias("protocol"))


def _classes(x: DataFrame, as_of: str) -> DataFrame:
    """The rules of :func:`classify` over what was found in each file."""
    sdl, isdn, sip, mgcp, ccapi = (F.col(f"_{k}") for k in ("cucm_sdl", "isdn_q931", "sip", "mgcp", "ccapi"))
    some = lambda found, marks: F.exists(found, lambda e: e.rlike("|".join(marks)))
    low = F.lower(F.element_at(F.split("file_name", r"[/\\\\]"), -1))
    active = sum(((F.size(c) >= 2).cast("int") for c in (isdn, sip, mgcp)), F.lit(0))
    blank, cube = F.col("_blank"), low.contains("cube") | F.col("_cube")
    graded = lambda found: F.least(F.lit(0.99), F.round(0.85 + 0.03 * F.size(found), 2))
    weak = lambda words: F.array(F.lit(f"Weak content indicator; matched filename token '{words}'"))
    # Condition, trace type, device type, default name, confidence, evidence, name and address for the suggested file name
    rules = [
        (blank, "UNKNOWN", F.lit("UNKNOWN"), F.lit(None), F.lit(0.0), F.array(F.lit("Empty file content")), None),
        ((F.size(sdl) >= 2) | some(sdl, ["FileHead", "SdlSig"]), "CUCM_SDL", F.lit("CUCM"), F.lit("CUCM-PUB"), graded(sdl), sdl, ("CUCM", "10.197.206.141", "SDL")),
        (active >= 2, "MIXED", F.lit("VOICE_GATEWAY"), F.lit("VoiceGateway"), F.lit(0.95), F.concat(isdn, mgcp, sip), ("VG01", "10.197.206.150", "MIXED")),
        ((F.size(isdn) >= 2) | some(isdn, ["Q931", "callref"]), "ISDN_Q931", F.lit("VOICE_GATEWAY"), F.lit("VoiceGateway"), graded(isdn), isdn, ("VG01", "10.197.206.150", "ISDN_Q931")),
        (F.size(sip) >= 2, "SIP", F.when(cube, "CUBE").otherwise("VOICE_GATEWAY"), F.when(cube, "CUBE01").otherwise("VG01"), graded(sip), sip, (F.when(cube, "CUBE01").otherwise("VG01"), "10.197.206.150", "SIP")),
        ((F.size(mgcp) >= 2) | some(mgcp, ["MGCP Packet", "CRCX"]), "MGCP", F.lit("VOICE_GATEWAY"), F.lit("VoiceGateway"), graded(mgcp), mgcp, ("VG01", "10.197.206.150", "MGCP")),
        (F.size(ccapi) >= 1, "CCAPI", F.lit("IOS_ROUTER"), F.lit("IOS-Router"), F.lit(0.88), ccapi, ("ROUTER", "10.197.206.1", "CCAPI")),
        (low.rlike("sdl|cucm"), "CUCM_SDL", F.lit("CUCM"), None, F.lit(0.60), weak("sdl/cucm"), None),
        (low.rlike("isdn|q931"), "ISDN_Q931", F.lit("VOICE_GATEWAY"), None, F.lit(0.60), weak("isdn/q931"), None),
        (low.contains("sip"), "SIP", F.lit("VOICE_GATEWAY"), None, F.lit(0.60), weak("sip"), None),
        (F.lit(True), "UNKNOWN", F.lit("UNKNOWN"), None, F.lit(0.20), F.array(F.lit("No recognizable Cisco voice signaling markers found")), None),
    ]
    ip, host = F.col("_ip"), F.col("_host")
    null = F.lit(None).cast("string")

    def case(pick):
        out = None
        for rule in rules:
            out = F.when(rule[0], pick(rule)) if out is None else out.when(rule[0], pick(rule))
        return out

    def suggested(rule):
        if rule[6] is None:
            return null
        dev, addr, kind = rule[6]
        dev = F.lit(dev) if isinstance(dev, str) else dev
        return F.concat_ws("_", F.lit("ROUTER") if kind == "CCAPI" else F.coalesce(host, dev), F.coalesce(ip, F.lit(addr)), F.lit(kind), F.lit(f"{as_of}.txt"))

    return x.select(
        "file_name", case(lambda r: F.lit(r[1])).alias("trace_type"), case(lambda r: r[2]).alias("device_type"), case(lambda r: F.coalesce(host, r[3].cast("string")) if r[6] is not None else null).alias("device_name"),
        case(lambda r: ip if r[6] is not None else null).alias("device_ip"), case(lambda r: r[4]).alias("confidence"), case(lambda r: r[5]).alias("evidence"), case(suggested).alias("recommended_filename"),
    )


def pattern_counts(text: Column, table: dict[str, tuple[str, ...]] | None = None, sample: int | None = None) -> dict[str, Column]:
    """By protocol, how many of its patterns the text holds, or its first ``sample`` characters."""
    head = F.coalesce(text, F.lit(""))
    if sample is not None:
        head = F.substring(head, 1, sample)
    return {k: sum((head.rlike(p).cast("int") for p in ps), F.lit(0)) for k, ps in (table or P.PRIMARY).items()}


def primary_protocol(text: Column, table: dict[str, tuple[str, ...]] | None = None, sample: int | None = None) -> Column:
    """The protocol with most patterns, the first of equals; UNKNOWN without any. The reference's ``sample`` is 100,000."""
    counts = pattern_counts(text, table, sample)
    best = F.greatest(*counts.values()) if len(counts) > 1 else next(iter(counts.values()))
    out = F.when(best < 1, "UNKNOWN")
    for k, c in counts.items():
        out = out.when(c == best, k)
    return out


def segment_protocol(block: Column) -> Column:
    out = F.when(F.btrim(F.coalesce(block, F.lit(""))) == "", "UNKNOWN")
    for k, p in P.SEGMENT.items():
        out = out.when(block.rlike(p), k)
    return out.otherwise("UNKNOWN")


def protocols_present(text: Column, table: dict[str, tuple[str, ...]] | None = None, sample: int | None = None) -> Column:
    """The protocols with any pattern. The reference's ``sample`` is 200,000."""
    counts = pattern_counts(text, table, sample)
    return F.filter(F.array(*[F.when(c > 0, k) for k, c in counts.items()]), lambda x: x.isNotNull())


def inventory(files: DataFrame, classes: DataFrame, events: DataFrame, text: str = "content") -> DataFrame:
    """One row per file: class, first and last stamp, first event's protocol, size and hash."""
    bounds = events.groupBy(F.col("source").alias("file_name")).agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.min_by("protocol", "seq_in_source").alias("protocol"), F.count("*").alias("event_count"))
    sizes = files.select(F.col(_key(files)).alias("file_name"), F.octet_length(text).cast("long").alias("size_bytes"), F.sha2(F.encode(text, "UTF-8"), 256).alias("sha256"))
    return sizes.join(classes, "file_name", "left").join(bounds, "file_name", "left")
