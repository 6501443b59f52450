"""Calls watched by timers: equal to the whole table for all events in time, with disorder, restarts and late rows."""

import datetime
import random

from calltrace.streaming import monitor

BASE = datetime.datetime(2026, 3, 1, tzinfo=datetime.UTC)
SCHEMA = "call_id string, ts timestamp, message_type string"


def at(s):
    return BASE + datetime.timedelta(seconds=s)


def us(s):
    return int((BASE.timestamp() + s) * 1_000_000)


def run(spark, tmp_path, batches, **options):
    """Each batch a file, in the order of their names; two starts, the second from the first one's checkpoint."""
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    half = max(1, len(batches) // 2)
    for part in (batches[:half], batches[half:]):
        for rows in part:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            monitor.watch(stream, out, cp, **options).awaitTermination()
    return [tuple(r) for r in spark.read.schema(monitor.FINDINGS).parquet(out).collect()]


def test_ringing_without_answer(spark, tmp_path):
    """Told when the timer is up, while the call goes on; answered and ended calls are not told."""
    one = [("a", at(0), "INVITE"), ("a", at(2), "180 Ringing"), ("b", at(3), "180 Ringing"), ("b", at(20), "200 OK"), ("c", at(4), "183 Session Progress"), ("c", at(5), "486 Busy"), (None, at(6), "180 Ringing"), ("d", None, "BYE")]
    two = [("a", at(30), "180 Ringing"), ("a", at(60), "180 Ringing"), ("a", at(90), "180 Ringing"), ("clock", at(100), "OPTIONS")]
    got = run(spark, tmp_path, [one, two, [("clock", at(101), "OPTIONS"), ("a", at(20), "200 OK")], [("clock", at(400), "OPTIONS")], [("clock", at(401), "OPTIONS")]], late="10 seconds", wait=60.0, gap=45.0)
    assert [(r[0], r[2]) for r in got if r[1] == "NO_ANSWER"] == [("a", us(62))]  # its answer at 20 came after the watermark
    closed = {r[0]: r for r in got if r[1] == "CLOSED"}
    assert set(closed) == {"a", "b", "c", "clock"} and closed["a"][4] == us(90) and closed["a"][5] == 5 and closed["b"][7] == us(20)


def test_stream_equals_table(spark, tmp_path):
    """Random calls out of order within the watermark."""
    rnd = random.Random(3)
    rows = sorted(((f"c{rnd.randrange(6)}", at(rnd.randrange(1500)), rnd.choice(["INVITE", "180 Ringing", "180 Ringing", "200 OK", "BYE", "ACK", "OPTIONS"])) for _ in range(140)), key=lambda r: r[1].timestamp() + rnd.randrange(60))
    batches = [rows[k : k + 35] for k in range(0, 140, 35)] + [[("clock", at(5000), "OPTIONS")], [("clock", at(5001), "OPTIONS")]]
    options = {"wait": 40.0, "gap": 50.0}
    got = run(spark, tmp_path, batches, late="20 minutes", **options)
    want = [tuple(r) for r in monitor.session_findings(spark.createDataFrame(rows, SCHEMA), **options).collect()]
    brief = lambda x: sorted(r[:4] for r in x if r[0] != "clock")
    assert brief(got) == brief(want) and len(want) > 30
    assert sorted((r for r in got if r[1] == "CLOSED" and r[0] != "clock"), key=str) == sorted((r for r in want if r[1] == "CLOSED"), key=str)


def test_merged_sessions_any_order():
    rnd = random.Random(1)
    for _ in range(100):
        events = [(t := rnd.randrange(300), t, 1, t if rnd.random() < 0.3 else None, None, None, False) for _ in range(12)]
        want = monitor.merged(events, 20)
        held = []
        for e in rnd.sample(events, len(events)):
            held = monitor.merged([*held, e], 20)
        assert held == want
