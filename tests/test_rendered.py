"""Queries over rendered events against their SQL, on values of ``props`` that are no plain numbers."""

import datetime
import os

import duckdb
import pytest

from calltrace.plans import registry, rendered

ODD = ['{"k": "76"}', '{"k": 7}', '{"k": null}', '{"k": 76.0}', '{"k": 76.5}', '{"k": 77.5}', '{"k": true}', '{"k": 12345}', '{"k": " 7"}', '{"k": -5}']
NAMES = "q_calls q_correlation_tags q_link_reasons q_log_events q_pack_text q_parse_roundtrip q_rules_txn q_sdl_as_voice".split()


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    kinds = ["signup", "view", "click", "purchase", "error"]
    begin = datetime.datetime(2024, 1, 1, 0, 0, 11, 172425)
    rows = [(i, begin + datetime.timedelta(seconds=71 * i), i % 9, kinds[i % 5], float(i % 40), ODD[i % len(ODD)]) for i in range(240)]
    c = duckdb.connect()
    c.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    c.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", rows)
    c.execute(f"COPY events TO '{os.path.join(folder, 'events.parquet')}'")
    return folder, c


@pytest.mark.parametrize("name", NAMES)
def test_identifiers_of_odd_props(spark, odd, name):
    folder, c = odd
    got = registry.QUERIES[name](spark, folder)
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and want


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    """Events within a millisecond of the ends of their ten minutes."""
    folder = str(tmp_path_factory.mktemp("edges"))
    kinds = ["signup", "view", "click", "purchase", "error"]
    off = [-1000, -999, -501, -500, -499, -1, 0, 1, 499, 500, 501, 999]
    begins = [datetime.datetime(2024, 1, 1, 0, 10), datetime.datetime(2024, 1, 1, 0, 20), datetime.datetime(2024, 1, 1, 23, 50)]
    # a time for each event: some queries order by it alone
    rows = [(i, begins[i // 12] + datetime.timedelta(microseconds=off[i % 12]), i % 5, kinds[i % 5], float(i % 40), f'{{"k": {i % 3}}}') for i in range(36)]
    c = duckdb.connect()
    c.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    c.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", rows)
    c.execute(f"COPY events TO '{os.path.join(folder, 'events.parquet')}'")
    return folder, c


@pytest.mark.parametrize("name", NAMES)
def test_identifiers_at_the_ends_of_buckets(spark, edges, name):
    """The SQL's bucket is that of the time rounded to milliseconds: half a millisecond before its end an event belongs to the next."""
    folder, c = edges
    got = registry.QUERIES[name](spark, folder)
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and want


def test_whole_files_in_chunks(spark):
    """A file's text is the same whatever the chunk; no file's lines are collected by one task alone."""
    rows = [(f, i, f"{f} line {i}" if i % 7 else "") for f in "ab" for i in range(1, 60)]
    lines = spark.createDataFrame(rows[::-1], "file_name string, line_no int, line string")
    want = {f: "\n".join(t for g, _, t in rows if g == f) for f in "ab"}
    assert all({r.file_name: r.content for r in rendered.whole_files(lines, n).collect()} == want for n in (1, 10, 59, 10_000))
