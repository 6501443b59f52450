"""Scored correlation of blocks that no task could hold: the greedy pass in slices of time.

The events of a large block are ranked in its order and cut into slices. A slice needs, of all clusters made before it, only those its events may
fit: clusters that share a strong key with one of them, and clusters that hold one of their numbers and were active within the gap. What
clusters hold is the frontier, a written table of facts (one row per cluster and key) that is handed from slice to slice; after
each slice the facts of clusters that no later event can fit any more are left out: those whose strong keys no later event asks for and that have
been silent for the gap. All large blocks advance together, a slice of each in one job.

The second pass merges clusters. Two clusters can only be merged if the rules of :func:`scored.blocks` tie them, begun from the clusters;
such groups are small where blocks are not, because a block is tied together by keys that its clusters mostly don't use.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltrace.functions.work import materialize, release
from calltrace.operators import scored
from calltrace.operators.ranks import ranked
from calltrace.operators.scored import NUMBERS, STRONG, Weights, _bridged, _channel_of, _Cluster, _greedy, _keys_needed, _parts

_FIELDS = ["event_id", "protocol", "source", "seq", "call_id", "callref", "txn", "mgcp_cid", "own_cid", "conn", "calling", "called", "endpoint", "b_channel", "tags", "seed", "ips", "t", "rank"]
_FACTS = "block string, cluster long, kind string, value string, t double"
_LINKS = "event_id string, block string, cluster long, score double, why array<string>"


def _asked(rows: DataFrame, *extra: str) -> DataFrame:
    """``(event_id, kind, value, …)``: :func:`scored._asks` and the numbers, as rows."""
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    end = scored.channel(F.col("endpoint"))
    singles = [one(held, F.col(own)) for own, held in STRONG] + [one("b_channel", end), one("channel", F.col("b_channel"))]
    singles += [one(n, F.when(F.col(n).isNotNull(), scored.number_key(F.col(n)))) for n in NUMBERS]
    keys = F.filter(F.concat(F.transform("tags", lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("value"))), F.array(*singles)), lambda k: k["value"].isNotNull())
    return rows.select("event_id", *extra, F.explode(keys).alias("k")).select("event_id", *extra, "k.kind", "k.value")


def _facts_of(c: _Cluster, since: dict) -> list[tuple[str, str | None]]:
    """What a cluster holds beyond ``since``, as facts. ``last`` stands for its last time."""
    out = [(k, v) for k, v in c.keys] + [(k, n) for k in NUMBERS for n in c.parties[k]] + [("point", p) for p in c.points] + [("ip", i) for i in c.ips]
    return [f for f in out if f not in since] + [("last", None)]


def _held(facts: list[tuple]) -> dict[int, _Cluster]:
    """Clusters from their facts. Events come in order of time, so of a cluster's times the last is enough."""
    out: dict[int, _Cluster] = {}
    for number, kind, value, t in facts:
        c = out.setdefault(int(number), _Cluster(int(number)))
        if kind in NUMBERS:
            c.parties[kind].add(value)
        elif kind == "point":
            c.points.add(value)
            end = _channel_of(value)
            c.endpoints[end] = min(value, c.endpoints.get(end, value))
        elif kind == "ip":
            c.ips.add(value)
        elif kind == "last":
            if t == t and t is not None:
                c.times = [max([t, *c.times])]
        else:
            c.keys.add((kind, value))
    return out


def _one_slice(w: Weights):
    def run(key: tuple, events: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
        known: dict[str, list[tuple]] = {}
        for block, *fact in facts[["block", "cluster", "kind", "value", "t"]].itertuples(index=False):
            known.setdefault(block, []).append(tuple(fact))
        out = []
        for block, rows in _parts(events[[*_FIELDS, "block"]], "block", ("rank",)):
            held = _held(known.get(block, []))
            since = {n: set(_facts_of(c, {})) for n, c in held.items()}
            clusters = _greedy(rows, w, held, "rank")
            out += [(e["event_id"], block, e["cluster"], e["score"], e["why"], None, None, None) for e in rows if "cluster" in e]
            for c in clusters:
                if c.events:
                    out += [(None, block, c.number, None, None, kind, value, c.times[-1] if c.times else None) for kind, value in _facts_of(c, since.get(c.number, {}))]
        return pd.DataFrame(out, columns=["event_id", "block", "cluster", "score", "why", "kind", "value", "t"])

    return run


def greedy_slices(rows: DataFrame, size: int, w: Weights) -> DataFrame:
    """``(event_id, block, cluster, score, why)`` of assigned events of prepared ``rows`` with their ``block`` and ``t``; a cluster is named by its first
    event's rank in the block."""
    spark = rows.sparkSession
    x = materialize(ranked(rows, "block", [F.col("t").asc_nulls_last(), "source", "seq", "event_id"]).withColumn("slice", F.floor((F.col("rank") - 1) / size).cast("int")), "slices")
    asks = materialize(_asked(x, "block", "slice", "t").groupBy("block", "kind", "value", "slice").agg(F.max("t").alias("to"), F.max(F.col("t").isNull()).alias("untimed")), "slice-asks")
    number = F.col("kind").isin(*NUMBERS)
    last_asked = materialize(asks.where(~number).groupBy("block", "kind", "value").agg(F.max("slice").alias("until")), "keys-asked-until")
    begins = materialize(x.groupBy("block", "slice").agg(F.min("t").alias("begin")), "slice-begins")
    sizes = {r.slice: r.n for r in x.groupBy("slice").agg(F.count("*").alias("n")).collect()}  # a number per slice
    frontier = materialize(spark.createDataFrame([], _FACTS), "frontier")
    links = []
    for i in range(max(sizes, default=0) + 1):
        # small blocks share a group, as in scored.correlate_scored
        bin_of = F.pmod(F.xxhash64("block"), F.lit(max(1, sizes.get(i, 0) // scored.GROUP))).alias("bin")
        events = x.where(F.col("slice") == i)
        wanted = asks.where(F.col("slice") == i)
        last = frontier.where("kind = 'last'").select("block", "cluster", F.col("t").alias("active"))
        begin = begins.where(F.col("slice") == i).select("block", "begin")
        # an event without a time may fit a number at any distance
        hit = frontier.join(wanted.select("block", "kind", "value", "untimed"), ["block", "kind", "value"]).join(last, ["block", "cluster"]).join(begin, "block")
        near = F.col("active").isNull() | F.col("untimed") | (F.col("begin") - F.col("active") <= w.max_gap_seconds)
        fit = hit.where(~number | near).select("block", "cluster").distinct()
        loaded = frontier.join(fit, ["block", "cluster"], "left_semi")
        made = materialize(
            events.groupBy(bin_of).cogroup(loaded.groupBy(bin_of)).applyInPandas(_one_slice(w), f"{_LINKS}, kind string, value string, t double"), "slice-result"
        )
        links.append(materialize(made.where("event_id IS NOT NULL").select("event_id", "block", "cluster", "score", "why"), "slice-links"))
        facts = frontier.unionByName(made.where("kind IS NOT NULL").select("block", "cluster", "kind", "value", "t"))
        facts = facts.groupBy("block", "cluster", "kind", "value").agg(F.max("t").alias("t"))
        # what a later slice can fit: by a strong key that is asked for again, or by a number within the gap or at any distance
        again = facts.join(last_asked.where(F.col("until") > i), ["block", "kind", "value"]).select("block", "cluster")
        then = begins.where(F.col("slice") == i + 1).select("block", "begin")
        awake = facts.where("kind = 'last'").join(then, "block").where(F.col("t").isNull() | F.col("begin").isNull() | (F.col("begin") - F.col("t") <= w.max_gap_seconds))
        untimed = facts.where("kind = 'last'").join(asks.where(number & F.col("untimed")).select("block").distinct(), "block", "left_semi")
        keep = again.unionByName(awake.select("block", "cluster")).unionByName(untimed.select("block", "cluster")).distinct()
        before, frontier = frontier, materialize(facts.join(keep, ["block", "cluster"], "left_semi").select("block", "cluster", "kind", "value", "t"), "frontier")
        release(before, made)
    release(asks, last_asked, begins, frontier)
    out = links[0]
    for part in links[1:]:
        out = out.unionByName(part)
    done = materialize(out, "greedy-links")
    release(*links, x)
    return done


def merged_clusters(rows: DataFrame, links: DataFrame, w: Weights) -> DataFrame:
    """The second pass over clusters of ``links``: ``(event_id, session_id, confidence, evidence)``."""
    x = rows.drop("block").join(links, "event_id")
    lead = links.groupBy("block", "cluster").agg(F.min_by("event_id", F.struct("cluster", "event_id")).alias("lead"))
    same = links.join(lead, ["block", "cluster"]).where("event_id <> lead").select(F.col("event_id").alias("src"), F.col("lead").alias("dst"))
    groups = scored.blocks(materialize(x.drop("block", "cluster", "score", "why"), "clustered-events"), start=same, gap=w.max_gap_seconds)
    y = x.join(groups.withColumnRenamed("block", "bridge"), "event_id")
    y = y.withColumn("bin", F.pmod(F.xxhash64("bridge"), F.lit(max(1, links.count() // scored.GROUP))))

    def one(events: list[dict]) -> list[tuple]:
        made: dict[tuple, _Cluster] = {}
        for key in sorted({(e["block"], e["cluster"]) for e in events}):
            made[key] = _Cluster(len(made))
        for e in events:
            c = made[e["block"], e["cluster"]]
            c.add(e)
            c.scores.append(e["score"])
            c.evidence += list(e["why"])
        out = []
        for c in _bridged(list(made.values()), w):
            notes = list(dict.fromkeys(c.evidence))
            out += [(e["event_id"], c.events[0]["event_id"], round(sum(c.scores) / len(c.scores), 2), notes) for e in c.events]
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [r for _, g in _parts(pdf, "bridge") for r in one(g)]
        return pd.DataFrame(out, columns=["event_id", "session_id", "confidence", "evidence"])

    names = [*[f for f in _FIELDS if f != "rank"], "block", "cluster", "score", "why", "bridge"]
    return y.groupBy("bin").applyInPandas(lambda pdf: run(pdf[names]), "event_id string, session_id string, confidence double, evidence array<string>")


def correlate_sliced(events: DataFrame, size: int = 20_000, weights: Weights | None = None, compat: bool = True) -> DataFrame:
    """:func:`scored.correlate_scored`'s result, with the greedy pass in slices of ``size`` events of a block.

    Weights by which an event could join a cluster without a shared key have no slices; use :func:`scored.correlate_scored` for them.
    """
    w = weights or Weights()
    if not _keys_needed(w):
        raise ValueError("with these weights an event may join any cluster, and nothing can be left out of a slice")
    rows = materialize(scored.prepared(events, compat).withColumn("t", F.unix_micros("ts") / 1e6), "prepared")
    held = materialize(rows.join(scored.blocks(rows, tight=w == Weights()), "event_id"), "blocked")
    return merged_clusters(rows, greedy_slices(held, size, w), w)
