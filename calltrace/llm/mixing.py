"""Mixing sources to target weights by minimum-cost flow.

A document may belong to several sources. Documents are aggregated by membership pattern (the set of their sources), and
the graph of patterns and sources is solved: a pattern offers its words once at no cost, a second time
at cost 1, and so on (convex costs of repetition), and may send them to any of its sources; each source takes its target.
The flow says how many words of each pattern the mix takes. Documents of a pattern are then ordered by a seeded hash and
taken in that order, the order starting anew for repetitions, until the pattern's flow is used up.

Sources that no document ties, directly or over others, don't meet in the flow, so each connected part of the graph is a group of its own in
a Spark job; the task that solves it holds its patterns (not its documents). The driver holds a number per source, for the targets.

All paths of the flow's graph have one edge with a cost, that from the start to a pattern, so successive shortest paths are
maximum flows over first uses, then over second uses, and so on; each is found by blocking flows.

Sizes are words ``[^\\x20\\x09-\\x0D]+`` of whole texts; null and empty texts have size 0 and are taken as 0 words. A null
source is a source of its own, last in order. The running sums of the seeded order are two-level (sums of hash ranges, then
rows within a range), so a source that holds a third of all rows is spread over its ranges. Rows repeated with one id are
documents of their own. A document without any source (an empty
array) is in no mix. Columns of the input keep their names and values in :func:`mixed_documents`, which needs ``source`` only where
``sources`` is not given.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calltrace.functions.work import materialize
from calltrace.operators.components import connected_components

#: Hash ranges of each pattern's seeded order.
RANGES = 4096


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Targets of sources: weights repeat along the sources by code point (null last); no target exceeds ``most`` times the
    source's size, the excess is reshared by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(supply: dict[str, int], members: dict[str, list[str | None]], want: dict[str | None, int], repeats: int = 2) -> dict[tuple[str, str | None], int]:
    """Words each pattern sends to each source, at the least cost, where a pattern's k-th use costs k."""
    patterns, sources = list(supply), list(want)
    number = {s: len(patterns) + i for i, s in enumerate(sources)}
    out_of = [[number[s] for s in members[p] if s in number] for p in patterns]
    into: list[dict[int, int]] = [{} for _ in sources]  # flow by pattern
    room = [want[s] for s in sources]
    for _ in range(repeats):
        left = [supply[p] for p in patterns]
        while True:
            # levels from the patterns that have words left: forward over memberships, back over flow
            level = {p: 0 for p, n in enumerate(left) if n > 0}
            queue, reached = deque(level), False
            while queue:
                u = queue.popleft()
                if u < len(patterns):
                    nexts = out_of[u]
                else:
                    reached |= room[u - len(patterns)] > 0
                    nexts = [p for p, f in into[u - len(patterns)].items() if f > 0]
                for v in nexts:
                    if v not in level:
                        level[v] = level[u] + 1
                        queue.append(v)
            if not reached:
                break
            ways = {u: iter(out_of[u] if u < len(patterns) else list(into[u - len(patterns)])) for u in level}
            for start in [p for p, n in enumerate(left) if n > 0]:
                path = [start]
                while path and left[start] > 0:
                    u = path[-1]
                    if u >= len(patterns) and room[u - len(patterns)] > 0:
                        push = min(left[start], room[u - len(patterns)], *(into[a - len(patterns)].get(b, 0) for a, b in zip(path[1:-1:2], path[2:-1:2], strict=True)))
                        for a, b in zip(path, path[1:], strict=False):
                            if a < len(patterns):
                                into[b - len(patterns)][a] = into[b - len(patterns)].get(a, 0) + push
                            else:
                                into[a - len(patterns)][b] -= push
                        left[start] -= push
                        room[u - len(patterns)] -= push
                        path = [start]
                        continue
                    for v in ways[u]:
                        if level.get(v) == level[u] + 1 and (u < len(patterns) or into[u - len(patterns)].get(v, 0) > 0):
                            path.append(v)
                            break
                    else:
                        path.pop()
    return {(patterns[p], sources[i]): f for i, flows in enumerate(into) for p, f in flows.items() if f > 0}


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _memberships(sources: Column | None) -> Column:
    return F.array_sort(F.array_distinct(F.array("source") if sources is None else F.coalesce(sources, F.array().cast("array<string>"))))


def _pattern(given: Column) -> Column:
    return F.to_json(given)


def pattern_flows(groups: DataFrame, want: dict[str | None, float], repeats: int) -> DataFrame:
    """``(pattern, flow)`` of ``groups`` ``(pattern, sources, size)``: the words the mix takes of each."""
    spark = groups.sparkSession
    name = lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("null"))
    lead = name(F.get("sources", F.lit(0)))
    edges = groups.where("size(sources) > 1").select(F.explode(F.slice("sources", 2, F.size("sources"))).alias("s"), lead.alias("dst")).select(name(F.col("s")).alias("src"), "dst").distinct()
    tied = groups.select("pattern", "sources", "size", lead.alias("lead"))
    if edges.isEmpty():
        parts = tied.withColumn("part", F.col("lead"))
    else:
        parts = tied.join(connected_components(edges), F.col("lead") == F.col("node"), "left").withColumn("part", F.coalesce("component", "lead"))
    shared = spark.sparkContext.broadcast({s: int(t) for s, t in want.items()})  # a number per source

    def solve(pdf):
        import pandas as pd

        out = []
        for _, g in pdf.groupby("part", sort=False):
            g = g.sort_values("pattern")
            members = {p: list(s) for p, s in zip(g["pattern"], g["sources"], strict=True)}
            own = {s: shared.value[s] for s in sorted({s for m in members.values() for s in m}, key=lambda s: (s is None, s or ""))}
            total = dict.fromkeys(members, 0)
            for (p, _), f in min_cost_flow({p: int(n) for p, n in zip(g["pattern"], g["size"], strict=True)}, members, own, repeats).items():
                total[p] += f
            out += total.items()
        return pd.DataFrame(out, columns=["pattern", "flow"])

    # parts of one pattern are many, and share a group
    dealt = parts.select("pattern", "sources", "size", "part", F.pmod(F.xxhash64("part"), F.lit(1 << 10)).alias("bin"))
    return materialize(dealt.groupBy("bin").applyInPandas(solve, "pattern string, flow long"), "mix-flows")


def mix(docs: DataFrame, sources: Column | None = None, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, tid, given, pattern, size, source_size, target, taken, copies)`` for every row.

    ``sources``: an array column, by default of the column ``source`` alone; ``given``: its pattern, ``pattern``: that by which it
    is routed; ``source_size`` and ``target`` are those of its
    first source. ``taken``: words the mix takes, the last document of a flow in part; ``copies``: whole documents nearest to it.
    """
    spark = docs.sparkSession
    given = _memberships(sources)
    tid = F.xxhash64(text)
    rows = materialize(
        docs.select(F.col(doc_id).alias("doc_id"), tid.alias("tid"), given.alias("sources"), _pattern(given).alias("pattern"), _pattern(given).alias("given"), words(F.col(text)).alias("size"))
        .withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "tid")),
        "mix-rows",
    )
    groups = materialize(rows.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size")), "mix-patterns")
    by_source = groups.select(F.explode("sources").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("size"))
    sizes = {r.source: r["size"] for r in by_source.collect()}  # a row per source
    want = targets(sizes, weights, share, float(repeats))
    of_source = spark.createDataFrame([(s, sizes[s], float(want[s])) for s in sizes], "name string, source_size long, target double")
    flows = pattern_flows(groups, want, repeats)
    plan = groups.select("pattern", F.get("sources", F.lit(0)).alias("s"), F.size("sources").alias("n"), F.col("size").alias("supply")).join(of_source, (F.col("n") > 0) & F.col("s").eqNullSafe(F.col("name")), "left")
    plan = plan.join(flows, "pattern").select("pattern", "supply", "flow", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"))
    part = F.shiftright("h", 52)
    rows = rows.withColumn("part", part)
    sums = rows.groupBy("pattern", "part").agg(F.sum("size").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("pattern").orderBy("part")) - F.col("n")).drop("n").join(plan, "pattern")
    inside = F.sum("size").over(Window.partitionBy("pattern", "part").orderBy("h", "doc_id", "tid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    at = rows.join(before, ["pattern", "part"]).withColumn("at", F.col("before") + inside)
    taken, copies = F.lit(0), F.lit(0)
    for k in range(repeats):
        left = F.col("flow") - k * F.col("supply") - F.col("at")
        taken = taken + F.greatest(F.lit(0), F.least(left, F.col("size")))
        copies = copies + (2 * left >= F.col("size")).cast("int") * ((F.col("flow") > k * F.col("supply")) | (F.lit(k) == 0)).cast("int")
    return at.select("doc_id", "tid", "given", "pattern", "size", "source_size", "target", taken.cast("long").alias("taken"), copies.cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, sources: Column | None = None, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, a row for each copy; the last document of a flow is kept or left as a whole.

    Rows that agree in id, text and sources are merged and their copies added up.
    """
    plan = mix(docs, sources=sources, doc_id=doc_id, text=text, **options)
    plan = plan.groupBy(F.col("doc_id").alias("p_id"), F.col("tid").alias("p_tid"), F.col("given").alias("p_given")).agg(F.sum("copies").alias("p_n"))
    plan = materialize(plan.where("p_n > 0"), "mix-plan")
    names = docs.columns
    keyed = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(names)], F.col(doc_id).alias("k_id"), F.xxhash64(text).alias("k_tid"), _pattern(_memberships(sources)).alias("k_given"))
    keyed = keyed.dropDuplicates(["k_id", "k_tid", "k_given"])
    out = keyed.join(plan, keyed.k_id.eqNullSafe(plan.p_id) & (keyed.k_tid == plan.p_tid) & (keyed.k_given == plan.p_given))
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col("p_n").cast("int"))).alias("copy"))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
