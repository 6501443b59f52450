"""Column helpers: regex captures, word tests, line splits, trace timestamps."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's splitlines breaks at.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, or null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def first_capture(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[capture(text, p) for p in patterns])


def has_any(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether the text contains one of the words (as a substring); false for null."""
    return F.coalesce(text.rlike("|".join(map(re.escape, words))), F.lit(False))


def split_lines(text: Column) -> Column:
    """The text's lines; a break at the end makes no empty last line."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_BREAK)
    n = F.size(lines)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.greatest(n - 1, F.lit(0)))).otherwise(lines)


def collapse(text: Column) -> Column:
    return F.btrim(text)


def offset_minutes(offset: Column) -> Column:
    """``UTC:+05:30``, ``+05:30`` or ``-04:00`` as minutes; anything else is 0."""
    clean = F.regexp_replace(F.upper(F.btrim(offset)), "^.*UTC:?\\s*", "")
    pattern = "^([+-])(\\d{1,2}):(\\d{2})$"
    minutes = F.regexp_extract(clean, pattern, 2).try_cast("int") * 60 + F.regexp_extract(clean, pattern, 3).try_cast("int")
    return F.coalesce(F.when(F.regexp_extract(clean, pattern, 1) == "-", -minutes).otherwise(minutes), F.lit(0))


def _padded(time: Column) -> Column:
    """``hh:mm:ss[.f]`` with six digits of fraction."""
    fraction = F.substring(F.rpad(F.regexp_extract(time, "\\.(\\d+)", 1), 6, "0"), 1, 6)
    return F.concat(F.substring(time, 1, 8), F.lit("."), F.when(fraction == "", "000000").otherwise(fraction))


def sdl_timestamp(time: Column, base_date: Column, offset: Column, fallback_date: str = "2026-09-20") -> Column:
    """A full or time-only stamp as an instant; a time without a date takes the base date, an unreadable one midnight."""
    clean = F.btrim(time)
    full = "^(\\d{4})[-/](\\d{2})[-/](\\d{2})\\s+(\\d{2}:\\d{2}:\\d{2}(?:\\.\\d+)?)"
    date = F.coalesce(base_date.cast("string"), F.lit(fallback_date))
    own = F.concat_ws("-", *[F.regexp_extract(clean, full, i) for i in (1, 2, 3)])
    day = F.when(clean.rlike(full), own).otherwise(date)
    clock = F.when(clean.rlike(full), _padded(F.regexp_extract(clean, full, 4))).when(clean.rlike("^\\d{2}:\\d{2}:\\d{2}"), _padded(clean)).otherwise(F.lit("00:00:00.000000"))
    local = F.coalesce(F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")), F.try_to_timestamp(F.concat(F.lit(f"{fallback_date} "), clock), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")), F.lit(f"{fallback_date} 00:00:00").cast("timestamp"))
    return F.timestamp_add("MINUTE", -offset, local)


def trace_timestamp(raw: Column, reference_year: int = 2026, reference_date: Column | None = None) -> Column:
    """ISO stamps (``-`` or ``/``, ``T`` or space), ``*Mon d hh:mm:ss.fff`` and, with a reference date, times alone; else null."""
    clean = F.btrim(raw, F.lit("*: \t"))
    iso = "^(\\d{4})[-/](\\d{1,2})[-/](\\d{1,2})[T\\s]+(\\d{2}:\\d{2}:\\d{2}(?:\\.\\d+)?)"
    month = "^([A-Za-z]{3})\\s+(\\d{1,2})\\s+(\\d{2}:\\d{2}:\\d{2}(?:\\.\\d+)?)"
    alone = "^(\\d{2}:\\d{2}:\\d{2}(?:\\.\\d+)?)"
    fmt = F.lit("yyyy-M-d HH:mm:ss.SSSSSS")
    as_iso = F.concat(F.concat_ws("-", *[F.regexp_extract(clean, iso, i) for i in (1, 2, 3)]), F.lit(" "), _padded(F.regexp_extract(clean, iso, 4)))
    as_month = F.concat(
        F.lit(f"{reference_year}-"), F.initcap(F.regexp_extract(clean, month, 1)), F.lit("-"), F.regexp_extract(clean, month, 2), F.lit(" "), _padded(F.regexp_extract(clean, month, 3))
    )
    out = F.when(clean.rlike(iso), F.try_to_timestamp(as_iso, fmt)).when(clean.rlike(month), F.try_to_timestamp(as_month, F.lit("yyyy-MMM-d HH:mm:ss.SSSSSS")))
    if reference_date is not None:
        out = out.when(clean.rlike(alone), F.try_to_timestamp(F.concat_ws(" ", reference_date.cast("string"), _padded(clean)), fmt))
    return out


def display_time(ts: Column, zone: str = "Asia/Kolkata", label: str = "IST", millis: bool = False, fallback: str = "Unknown") -> Column:
    """``dd-MMM-yyyy HH:mm:ss[.SSS]`` in a zone and its label; the session's zone is taken to be UTC."""
    pattern = "dd-MMM-yyyy HH:mm:ss" + (".SSS" if millis else "")
    return F.coalesce(F.concat(F.date_format(F.from_utc_timestamp(ts, zone), pattern), F.lit(f" {label}")), F.lit(fallback))


def display_range(start: Column, end: Column, **options) -> Column:
    return F.concat_ws(" \u2192 ", display_time(start, **options), display_time(end, **options))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds, not below 0, to three decimals."""
    return F.greatest(F.lit(0.0), F.round((F.unix_micros(end) - F.unix_micros(start)) / 1e6, 3))


def display_duration(seconds: Column) -> Column:
    return F.when(seconds.isNull(), "N/A").when(seconds < 1, F.format_string("%dms", F.round(seconds * 1000).cast("long"))).otherwise(F.format_string("%.2fs", seconds))
