"""The trace source: byte ranges against whole files, codecs by content, corrupt input, streams."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from calltrace.operators import framing, parsing
from calltrace.sources import trace_source, traces


def text(n=300, seed=1):
    rnd = random.Random(seed)
    out = ["preamble line", "", "second preamble", "0000000000.000 |00:00:00.000 |FileHead |UTC:+00:00,Date: 2026/01/02, HostName: N1"]
    for i in range(n):
        out.append(f"{i:010d}.000 |10:{i // 60 % 60:02d}:{i % 60:02d}.{i % 1000:03d} |SdlSig |Sig{i} |active |P(1,1,1,1) |Q(1,1,1,1) |1,1,1,1 |CI={1000 + i} é")
        out += ["x" * rnd.randrange(90) + rnd.choice(["", "\r"]) for _ in range(rnd.choice([0, 0, 1, 3]))]
    return "\n".join(out) + rnd.choice(["", "\n"])


def got(df):
    return sorted((r.path.rsplit("/", 1)[1], r.offset, r.kind, r.record, r.n_lines) for r in df.collect() if r.kind != "corrupt")


@pytest.fixture
def source(spark):
    trace_source.register(spark)
    return lambda path, **o: spark.read.format("calltrace").options(**o).load(str(path))


def test_ranges_equal_the_whole_file(spark, source, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    for k in range(3):
        (folder / f"t{k}.txt").write_bytes(text(seed=k, n=120 * k).encode() + (b"\xff\xfe bad" if k == 2 else b""))
    (folder / "t.index").write_text("no trace")
    (folder / "_hidden").write_text("no trace")
    (folder / "empty.txt").write_text("")
    whole = got(source(tmp_path / "in"))
    for split in (1, 7, 100, 4096):
        df = source(tmp_path / "in", split_bytes=split if split > 7 else 50 + split)
        assert got(df) == whole
    assert source(tmp_path / "in", split_bytes=4096).rdd.getNumPartitions() > 8
    # the records are those of the framing operators
    files = traces.read_traces(spark, str(tmp_path / "in"))
    want = framing.frame_sdl(traces.trace_lines(files)).select("raw_text").collect()
    assert sorted(r.raw_text for r in want) == sorted(r[3] for r in whole if r[2] == "record")
    events = lambda lines: sorted((r.ts, r.signal or "", r.ci or "") for r in parsing.sdl_events(lines).select("ts", "signal", "ci").collect())
    assert events(trace_source.as_lines(source(tmp_path / "in", split_bytes=500))) == events(traces.trace_lines(files))
    assert sum(r[2] == "preamble" for r in whole) == 6


def test_codecs_by_content_and_corrupt_files(source, tmp_path):
    data = text(80).encode()
    (tmp_path / "a.txt").write_bytes(gzip.compress(data))  # named like a plain file
    (tmp_path / "b.gz").write_bytes(data)  # plain, whatever its name
    (tmp_path / "c.gz").write_bytes(gzip.compress(data)[:-600])  # cut off
    rows = source(tmp_path, split_bytes=300).collect()
    by = {n: sorted((r.offset, r.record) for r in rows if r.path.endswith(n) and r.kind != "corrupt") for n in ("a.txt", "b.gz", "c.gz")}
    assert by["a.txt"] == by["b.gz"] and len(by["b.gz"]) == 83
    bad = [r for r in rows if r.kind == "corrupt"]
    assert len(bad) == 1 and bad[0].path.endswith("c.gz") and bad[0].error and set(by["c.gz"][:-1]) <= set(by["a.txt"])


def test_stream_and_empty_folder(spark, source, tmp_path):
    folder, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    assert source(folder).count() == 0
    for k in range(3):
        (folder / f"t{k}.txt").write_text(text(40, seed=k))
        stream = spark.readStream.format("calltrace").option("split_bytes", 700).load(str(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    assert got(spark.read.schema(trace_source.SCHEMA).parquet(out)) == got(source(folder))


def test_header_option(source, tmp_path):
    (tmp_path / "x.log").write_text("== a\n1\n== b\n2\n3")
    assert [(r.record, r.n_lines) for r in source(tmp_path, header="^== ", split_bytes=4).orderBy("offset").collect()] == [("== a\n1", 2), ("== b\n2\n3", 3)]
    with pytest.raises(Exception, match="(?i)no such file|FileNotFound|not"):
        source(tmp_path / "missing").filter(F.lit(True)).count()


def test_many_ranges_share_tasks():
    """Small ranges of many files come in some hundred tasks, each range once and in order; few ranges have a task each."""
    ranges = [trace_source.Range(f"f{i // 100}", i % 100 * 65536, (i % 100 + 1) * 65536, None) for i in range(20_000)]
    packs = trace_source.packed(ranges)
    assert 200 < len(packs) <= 257 and [r for p in packs for r in p.ranges] == ranges
    assert [len(p.ranges) for p in trace_source.packed(ranges[:9])] == [1] * 9 and trace_source.packed([]) == []


def test_a_range_reads_little_past_its_end(tmp_path):
    """A range of a large file reads about its own bytes."""
    line = "0000000001.000 |10:00:00.000 |SdlSig |x |y"
    (tmp_path / "a.txt").write_text("\n".join([line] * 20_000))
    asked = []

    class Opened:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            asked.append(n)
            return self.f.read(n)

    with open(tmp_path / "a.txt", "rb") as f:
        f.seek(4300)
        assert len([at for at, _ in trace_source._lines(Opened(f), 4300, 8192)]) == 19_900
    asked.clear()
    kept, trace_source._lines = trace_source._lines, lambda f, at, size=trace_source.READ_BYTES: (asked.append(size), kept(f, at, size))[1]
    try:
        rows = list(trace_source.records_of(trace_source.Range(str(tmp_path / "a.txt"), 4300, 8600, None), trace_source.HEADER))
    finally:
        trace_source._lines = kept
    assert len(rows) == 100 and asked[0] < 16_384
