"""A Spark data source of trace files: records framed where they lie, a file of any size in many tasks.

``spark.read.format("calltrace").load(folder)`` and ``spark.readStream`` give ``(path, offset, kind, record, n_lines, error)``. A plain file is cut into byte ranges; a
task begins at the first record header of its range and reads the last record it began to its end, wherever that is, so every record is in one
task and none in two. What is compressed is told by its first bytes, not by its name: gzip and zstd are read whole by one task, with offsets in the
decompressed text. Lines before a file's first header are rows of kind ``preamble``; what can't be read is a row of kind ``corrupt`` with the
error, after the records before it. Bytes that are no UTF-8 are replaced. Files are found and read with pyarrow's file systems (``file``, ``hdfs``, ``s3``,
``gs``); hidden files and ``.index`` files are left out.

Options: ``split_bytes`` (64 MB) and ``header``, a regular expression of a record's first line (that of call-manager traces).
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from calltrace.functions import patterns as P

HEADER = P.SDL_HEADER
SCHEMA = "path string, offset long, kind string, record string, n_lines long, error string"
READ_BYTES = 1 << 20
#: How far a range is read past its end at first, for its last record.
PAST_BYTES = 4 << 10
#: About so many tasks share all ranges, until each has so many bytes.
TASKS, TASK_BYTES = 256, 64 << 20
BATCH_BYTES = 4 << 20
#: First bytes of compressed files. Fixed values.
CODECS = {b"\x1f\x8b": "gzip", b"\x28\xb5\x2f\xfd": "zstd"}


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, codec: str | None):
        self.path, self.start, self.end, self.codec = path, start, end, codec


class Pack(InputPartition):
    """The ranges of one task."""

    def __init__(self, ranges: tuple[Range, ...]):
        self.ranges = ranges


def _opened(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
    return store, name


def listed(path: str) -> list[tuple[int, str, int]]:
    """``(modified, path, size)`` of the trace files under a path, in that order."""
    from pyarrow import fs

    store, name = _opened(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(name, recursive=True))
    scheme = path.split("://")[0] + "://" if "://" in path else "file://"
    host = path.split("://")[1].split("/")[0] if "://" in path and scheme == "hdfs://" else ""
    base = name.rstrip("/")
    out = []
    for f in found:
        below = f.path[len(base) :].split("/") if not info.is_file else [f.base_name]
        if f.is_file and not any(p.startswith((".", "_")) for p in below if p) and not f.base_name.lower().endswith(".index"):
            out.append((f.mtime_ns or 0, f"{scheme}{host}{f.path}", f.size))
    return sorted(out)


def ranges_of(files: list[tuple[int, str, int]], split: int) -> list[Range]:
    out = []
    for _, path, size in files:
        store, name = _opened(path)
        with store.open_input_stream(name, compression=None) as f:
            begin = f.read(4)
        codec = next((c for mark, c in CODECS.items() if begin.startswith(mark)), None)
        out += [Range(path, 0, size, codec)] if codec else [Range(path, a, min(a + split, size), None) for a in range(0, size, split)]
    return out


def packed(ranges: list[Range]) -> list[Pack]:
    """Ranges in order, as many to a task that about ``TASKS`` tasks take all, and each no more than ``TASK_BYTES`` but for its last range."""
    want = min(sum(r.end - r.start for r in ranges) // TASKS, TASK_BYTES)
    out, held, size = [], [], 0
    for r in ranges:
        held.append(r)
        size += r.end - r.start
        if size >= want:
            out.append(Pack(tuple(held)))
            held, size = [], 0
    return out + ([Pack(tuple(held))] if held else [])


def _lines(f, offset: int, size: int = READ_BYTES) -> Iterator[tuple[int, bytes]]:
    """Lines from where ``f`` stands, with their offsets, read ``size`` bytes at once."""
    rest, at = b"", offset
    while data := f.read(size):
        parts = (rest + data).split(b"\n")
        rest = parts.pop()
        for line in parts:
            yield at, line
            at += len(line) + 1
    if rest:
        yield at, rest


def records_of(part: Range, header: str) -> Iterator[tuple]:
    """Rows of one range."""
    head = re.compile(header)
    begun: list | None = None  # offset and lines of the record being read

    def done():
        return (part.path, begun[0], "record", "\n".join(begun[1]), len(begun[1]), None)

    try:
        store, name = _opened(part.path)
        with store.open_input_file(name) as whole:
            if part.codec:
                f, at = pa.CompressedInputStream(whole, part.codec), 0
            else:
                f, at = whole, max(part.start - 1, 0)
                f.seek(at)
            lines = _lines(f, at, READ_BYTES if part.codec else min(READ_BYTES, part.end - at + PAST_BYTES))
            if part.start and not part.codec:
                next(lines, None)  # the line that the range before began, or its line end alone
            for at, line in lines:
                text = line.rstrip(b"\r").decode("utf-8", "replace")
                if head.match(text):
                    if begun:
                        yield done()
                        begun = None
                    if at >= part.end and not part.codec:
                        return
                    begun = [at, [text]]
                elif begun:
                    begun[1].append(text)
                elif at >= part.end and not part.codec:
                    return
                elif part.start == 0 and text.strip():
                    yield (part.path, at, "preamble", text, 1, None)
        if begun:
            yield done()
    except (OSError, ValueError, pa.ArrowException) as e:
        if begun:
            yield done()
        yield (part.path, None, "corrupt", None, None, str(e)[:500])


def batches_of(part: Range, header: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("kind", pa.string()), ("record", pa.string()), ("n_lines", pa.int64()), ("error", pa.string())])
    held, size = [], 0
    for row in records_of(part, header):
        held.append(row)
        size += len(row[3] or "")
        if size > BATCH_BYTES or len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class _Options:
    def __init__(self, options):
        given = {k.lower(): v for k, v in options.items()}
        if not given.get("path"):
            raise ValueError("a path is needed: load(path)")
        self.path, self.split, self.header = given["path"], int(given.get("split_bytes", 64 << 20)), given.get("header", HEADER)


class TraceReader(DataSourceReader):
    def __init__(self, options):
        self.options = _Options(options)

    def partitions(self):
        # of no files one empty pack, for Spark plans at least one
        return packed(ranges_of(listed(self.options.path), self.options.split)) or [Pack(())]

    def read(self, partition):
        for part in partition.ranges:
            yield from batches_of(part, self.options.header)


class TraceStreamReader(DataSourceStreamReader):
    """New files of a folder; a file must be put there whole. An offset is the newest time of modification and the files of that time."""

    def __init__(self, options):
        self.options = _Options(options)

    def initialOffset(self):
        return {"modified": "-1", "paths": []}

    def latestOffset(self):
        files = listed(self.options.path)
        if not files:
            return self.initialOffset()
        return {"modified": str(files[-1][0]), "paths": [p for m, p, _ in files if m == files[-1][0]]}

    def partitions(self, start, end):
        def up_to(m, p, offset):
            return m < int(offset["modified"]) or m == int(offset["modified"]) and p in offset["paths"]

        files = [f for f in listed(self.options.path) if up_to(f[0], f[1], end) and not up_to(f[0], f[1], start)]
        return packed(ranges_of(files, self.options.split))

    def read(self, partition):
        for part in partition.ranges:
            yield from batches_of(part, self.options.header)

    def commit(self, end):
        pass


class TraceFiles(DataSource):
    @classmethod
    def name(cls):
        return "calltrace"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TraceReader(self.options)

    def streamReader(self, schema):
        return TraceStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``calltrace`` a format of the session; its code goes along by value, so that planning needs no path to this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(TraceFiles)


def as_lines(records):
    """``(file_name, line_no, line)`` for the framing operators, whose line numbers here are places in the order of offsets: a record's offset plus its line's place."""
    from pyspark.sql import functions as F

    rows = records.where("kind <> 'corrupt'").select("path", "offset", F.posexplode(F.split("record", "\n")).alias("pos", "line"))
    return rows.select(F.col("path").alias("file_name"), (F.col("offset") + F.col("pos")).alias("line_no"), "line")
