"""Joins of sessions and events against brute force."""

import datetime
import random

from pyspark.sql import functions as F

from calltrace.operators import sessions

BASE = datetime.datetime(2025, 6, 1, tzinfo=datetime.UTC)


def test_scoped_events_of_short_and_long_sessions(spark):
    """The same pairs as by comparing all; a session of a year takes a few rows."""
    rnd = random.Random(4)
    at = lambda s: BASE + datetime.timedelta(seconds=s)
    year = 365 * 86400
    events = [(i, at(rnd.randrange(-100, year + 100) if i % 2 else rnd.randrange(7200))) for i in range(300)] + [(400, None)]
    spans = [(f"s{k}", a, a + rnd.choice([0, 1, 59, 60, 61, 3000, 40000])) for k, a in enumerate(rnd.sample(range(7200), 25))] + [("year", 0, year), ("point", 100, 100), ("edge", 60 * 64 - 30, 60 * 128 - 30)]
    links = [(f"s{k}", k) for k in range(10)]
    e = spark.createDataFrame(events, "event_id int, ts timestamp")
    bounds = spark.createDataFrame([(k, at(a), at(b)) for k, a, b in spans] + [("none", None, None)], "session_id string, start_time timestamp, end_time timestamp")
    got = sessions.scoped_events(e, spark.createDataFrame(links, "session_id string, event_id int"), bounds, 30)
    want = {(k, i, True) for k, i in links}
    want |= {(k, i, False) for i, t in events if i >= 10 and t for k, a, b in spans if at(a - 30) <= t <= at(b + 30)}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 400
    assert sessions.scoped_events(e, spark.createDataFrame(links, "session_id string, event_id int"), bounds.where(F.lit(False)), 30).count() == 10


def test_session_rows_in_the_join(spark):
    """What the join shuffles for a session of a year, in rows."""
    bounds = spark.createDataFrame([("year", BASE, BASE + datetime.timedelta(days=365))], "session_id string, start_time timestamp, end_time timestamp")
    e = spark.createDataFrame([(1, BASE + datetime.timedelta(days=100))], "event_id int, ts timestamp")
    out = sessions.scoped_events(e, spark.createDataFrame([], "session_id string, event_id int"), bounds, 30)
    assert [tuple(r) for r in out.collect()] == [("year", 1, False)]
    lo, hi, width = BASE.timestamp() * 1e6 - 3e7, (BASE.timestamp() + 365 * 86400) * 1e6 + 3e7, 6e7
    while width < hi - lo:
        width *= 2
    assert hi // width - lo // width + 1 <= 3


def test_all_files_of_the_last_time_are_the_newest(spark):
    from calltrace.operators import search

    rows = [("a", "2024-01-01 00:00:00"), ("b", "2024-01-02 00:00:00"), ("c", "2024-01-02 00:00:00"), ("d", None)]
    files = spark.createDataFrame(rows, "filename string, modified string").withColumn("modified", F.col("modified").cast("timestamp"))
    assert sorted(r.filename for r in search.newest(files).collect()) == ["b", "c"]
    assert search.newest(files.where("modified IS NULL")).count() == 0


def test_noted_equals_the_notes_of_pairs_and_shuffles_none(spark):
    rng = random.Random(5)
    rows = [(f"s{i:02d}", BASE + datetime.timedelta(milliseconds=rng.randrange(60_000))) for i in range(60)]
    x = spark.createDataFrame([*rows, ("none", None)], "session_id string, start_time timestamp")
    want = {r.session_id: r.notes for r in sessions.simultaneous_notes(sessions.simultaneous(x, 4.0)).collect()}
    got = sessions.noted(x, 4.0)
    assert {r.session_id: r.notes for r in got.collect()} == want
    # sessions are shuffled on both sides of the join, pairs nowhere
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2


def test_notes_are_made_without_sorting_pairs(spark, monkeypatch):
    """Neither the join nor what follows it has a row for a pair, so none is sorted or spilled."""
    rows = [(f"s{i:03d}", BASE + datetime.timedelta(milliseconds=7 * i)) for i in range(300)]
    monkeypatch.setattr(sessions, "BLOCK", 1000)  # several blocks a bucket
    got = sessions.noted(spark.createDataFrame(rows, "session_id string, start_time timestamp"), 1.0)
    want = {a: sorted(f"Simultaneous call {b} active within {abs(i - k) * 7 // 100 / 10 + (0.1 if abs(i - k) * 7 % 100 >= 50 else 0):.1f}s." for k, (b, _) in enumerate(rows) if k != i and abs(i - k) * 7 <= 1000) for i, (a, _) in enumerate(rows)}
    assert {r.session_id: r.notes for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    join, = (k for k, x in enumerate(plan.splitlines()) if "SortMergeJoin" in x)
    above = plan.splitlines()[:join]
    assert not any(w in x for x in above for w in ("Sort ", "Aggregate", "Exchange", "Generate"))


def test_lines_of_a_file_are_numbered_over_its_minutes(spark):
    from calltrace.plans.rendered import numbered_lines

    rng = random.Random(6)
    rows = [(f"f{i % 3}", BASE + datetime.timedelta(seconds=rng.randrange(900)), i, [f"{i}-{k}" for k in range(rng.randrange(1, 4))]) for i in range(300)]
    out = numbered_lines(spark.createDataFrame(rows, "file_name string, ts timestamp, event_id long, lines array<string>"))
    got = {(r.file_name, r.line_no): r.line for r in out.collect()}
    want = {}
    for f in ("f0", "f1", "f2"):
        lines = [x for r in sorted((r for r in rows if r[0] == f), key=lambda r: (r[1], r[2])) for x in r[3]]
        want |= {(f, n): x for n, x in enumerate(lines, 1)}
    assert got == want
    # a file is not one task's
    windows = [x for x in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Window [" in x and "event_id" in x]
    assert windows and all("_part" in x for x in windows)


def test_pairs_of_a_busy_day_are_made_in_many_tasks(spark):
    """Small tables make many pairs: what a task gets goes by slots of time, not by bytes."""
    rng = random.Random(6)
    at = lambda s: BASE + datetime.timedelta(seconds=s)
    spans = [(f"s{k}", a, a + rng.choice([0, 30, 3600, 20_000])) for k in range(1500) for a in [rng.randrange(40_000)]]
    events = [(i, rng.randrange(60_000)) for i in range(1500)]
    e = spark.createDataFrame([(i, at(t)) for i, t in events], "event_id int, ts timestamp")
    bounds = spark.createDataFrame([(k, at(a), at(b)) for k, a, b in spans], "session_id string, start_time timestamp, end_time timestamp")
    got = sessions.scoped_events(e, spark.createDataFrame([], "session_id string, event_id int"), bounds, 60).withColumn("task", F.spark_partition_id()).collect()
    want = sorted((k, i) for k, a, b in spans for i, t in events if a - 60 <= t <= b + 60)
    assert sorted((r.session_id, r.event_id) for r in got) == want
    assert len({r.task for r in got}) >= 6


def test_pairs_come_in_runs_of_a_session(spark):
    """Files of pairs are as large as their columns change: a slot's events follow one another in the same order for each of its sessions."""
    at = lambda s: BASE + datetime.timedelta(seconds=s)
    e = spark.createDataFrame([(i, at(2 * i)) for i in range(3600)], "event_id int, ts timestamp")
    bounds = spark.createDataFrame([(f"s{k}", at(10 * k), at(7100 - 10 * k)) for k in range(40)], "session_id string, start_time timestamp, end_time timestamp")
    got = sessions.scoped_events(e, spark.createDataFrame([], "session_id string, event_id int"), bounds, 0).collect()
    assert sorted((r.session_id, r.event_id) for r in got) == sorted((f"s{k}", i) for k in range(40) for i in range(3600) if 10 * k <= 2 * i <= 7100 - 10 * k)
    assert sum(a.session_id != b.session_id for a, b in zip(got, got[1:])) * 50 < len(got)
