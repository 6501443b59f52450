"""The greedy pass in slices against one task, and ranks against a plain sort."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from calltrace.operators import scored, slices
from calltrace.operators.ranks import ranked

VOICE = (
    "event_id string, ts timestamp, protocol string, source string, seq_in_source long, call_id string, call_reference string, transaction_id string, calling_number string, called_number string, endpoint string,"
    " source_ip string, destination_ip string, message_type string, metadata map<string,string>, correlation_ids map<string,string>"
)


def voice(seed, n=60):
    """Calls that overlap on a hot number, conflict, fall silent, and are tied late by a bridge."""
    rnd = random.Random(seed)
    some = lambda values, share: rnd.choice(values) if rnd.random() < share else None
    out, t, span = [], 0.0, rnd.choice([1, 8, 25])
    for i in range(n):
        t += rnd.random() * span
        protocol = rnd.choice(["SIP", "ISDN", "MGCP"])
        meta = {k: v for k, v in {"b_channel": some(["1", "2"], 0.1), "connection_id": some(["c1", "c2", "c3"], 0.1), "call_id": some(["m1", "m2"], 0.05)}.items() if v}
        out.append((
            f"e{i:05d}", datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(milliseconds=int(t * 1000)) if rnd.random() < 0.96 else None, protocol, rnd.choice(["a", "b"]), i, some([f"id{k}" for k in range(max(4, n // 12))], 0.25),
            some(["0x12", "0x8012", "0x13"], 0.1), some(["t1", "t2"], 0.1), some(["5550001", "5550002", "3"], 0.7), some(["77", "88", "5550009"], 0.6), some(["s/1@g", "s/2@g", "b"], 0.15),
            some(["10.0.0.1", "10.0.0.2"], 0.2), some(["10.0.0.3"], 0.2), rnd.choice(["INVITE", "SETUP", "CRCX", "NOISE"]), meta, {"x": "t9"} if rnd.random() < 0.03 else {},
        ))
    return out


@pytest.mark.parametrize("seed,size", [(0, 12), (2, 20)])
def test_slices_equal_one_task(spark, seed, size):
    events = spark.createDataFrame(voice(seed), VOICE).cache()
    rows = scored.prepared(events).withColumn("t", F.unix_micros("ts") / 1e6).toPandas().sort_values(["t", "source", "seq", "event_id"], na_position="last", kind="stable")
    want = {}  # over all events at once, without blocks
    for c in scored._clusters(scored._records(rows), scored.Weights()):
        for e in c.events:
            want[e["event_id"]] = (c.events[0]["event_id"], round(sum(c.scores) / len(c.scores), 2), tuple(dict.fromkeys(c.evidence)))
    told = lambda df: {r.event_id: (r.session_id, r.confidence, tuple(r.evidence)) for r in df.collect()}
    assert told(scored.correlate_scored(events)) == want
    assert told(slices.correlate_sliced(events, size=size)) == want
    assert len(set(v[0] for v in want.values())) > 4


def test_bridge_across_slices(spark):
    """Two clusters of one call meet at a late event that both may fit; the frontier keeps a silent cluster for its Call-ID."""
    at = lambda s: datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=s)
    base = dict.fromkeys(("call_reference", "transaction_id", "endpoint", "source_ip", "destination_ip", "calling_number", "called_number", "call_id"))
    mk = lambda i, s, **k: (lambda d: (f"e{i}", at(s), d.get("protocol", "SIP"), "f", i, d["call_id"], d["call_reference"], d["transaction_id"], d["calling_number"], d["called_number"], d["endpoint"], d["source_ip"], d["destination_ip"], "INVITE", {}, {}))(base | k)
    rows = [mk(0, 0, call_id="A", calling_number="1"), mk(1, 1, protocol="ISDN", call_reference="0x5", calling_number="1")]
    rows += [mk(2 + k, 100 + 100 * k, call_id=f"other{k}", calling_number="9") for k in range(3)]
    rows += [mk(8, 900, call_id="A", call_reference="0x5"), mk(9, 901, call_id="A", calling_number="2", called_number="3")]
    got = {r.event_id: r.session_id for r in slices.correlate_sliced(spark.createDataFrame(rows, VOICE), size=3).collect()}
    want = {r.event_id: r.session_id for r in scored.correlate_scored(spark.createDataFrame(rows, VOICE)).collect()}
    assert got == want and got["e8"] == "e0"


def test_slices_of_nothing(spark):
    assert slices.correlate_sliced(spark.createDataFrame([], VOICE)).count() == 0
    with pytest.raises(ValueError):
        slices.correlate_sliced(spark.createDataFrame([], VOICE), weights=scored.Weights(merge_threshold=0.2))


@pytest.mark.parametrize("batch,tasks", [(10000, 3), (4, 6), (1, 2)])
def test_ranks(spark, batch, tasks):
    rnd = random.Random(batch)
    data = [(rnd.choice(["hot"] * 5 + ["a", "b", None]), rnd.randrange(50), i, "clash") for i in range(300 if batch > 1 else 40)]
    df = spark.createDataFrame(data, "k string, v int, i int, n string").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        own = {r.i: r["rank"] for r in ranked(df, "k", ["v", "i"], tasks=tasks).collect()}
        whole = {r.i: r["rank"] for r in ranked(df, None, [F.desc("v"), "i"], tasks=tasks).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert whole == {r[2]: n for n, r in enumerate(sorted(data, key=lambda r: (-r[1], r[2])), 1)}
    for k in {r[0] for r in data}:
        assert [own[r[2]] for r in sorted((r for r in data if r[0] == k), key=lambda r: r[1:3])] == list(range(1, sum(r[0] == k for r in data) + 1))
    assert ranked(df.limit(0), "k", ["v"]).count() == 0


def test_small_blocks_are_sorted_and_read_together():
    import pandas as pd

    from calltrace.operators import scored

    rows = [(f"e{i:03d}", f"b{i % 40:02d}", None if i % 7 == 0 else float(i * 31 % 17), "f", i % 3, [], [f"10.0.0.{i}"]) for i in range(400)]
    pdf = pd.DataFrame(rows, columns=["event_id", "block", "t", "source", "seq", "tags", "ips"])
    sorts, before = [], pd.DataFrame.sort_values
    pd.DataFrame.sort_values = lambda self, *a, **k: (sorts.append(1), before(self, *a, **k))[1]
    try:
        parts = dict(scored._parts(pdf, "block"))
    finally:
        pd.DataFrame.sort_values = before
    assert len(sorts) == 1 and len(parts) == 40
    for block, events in parts.items():
        own = [r for r in rows if r[1] == block]
        own.sort(key=lambda r: (r[2] is None, r[2] or 0.0, r[3], r[4], r[0]))
        assert [(e["event_id"], e["t"]) for e in events] == [(r[0], r[2]) for r in own]
