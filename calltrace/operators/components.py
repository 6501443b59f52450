"""Connected components of an edge table by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltrace.functions.work import materialize, release


def _hooked(edges: DataFrame) -> DataFrame:
    """``(node, to)``: each node's smallest neighbour or itself, followed to the end of its chain. Each round doubles what a jump spans."""
    pair = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("v"))
    ends = edges.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select("e.*")
    at = materialize(ends.groupBy("node").agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("to")), "hooks")
    while True:
        jump = at.select(F.col("node").alias("to"), F.col("to").alias("next"))
        new = materialize(at.join(jump, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "hooks")
        release(at)
        at = new
        if new.where("moved").isEmpty():
            return at


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is the smallest node in it.

    Each node goes to its smallest neighbour and on to the end of the chain that this makes; then edges are drawn between those ends,
    and only ends that still have an edge to another take part in the next round. So a round works on what is left of the graph, a chain of n nodes needs about
    log n jumps, and names are handed back over the rounds at the end. All joins are of written tables, whose exchanges adaptive
    execution can split at hub nodes. Rows with a null end are ignored, self loops give their node.
    """
    left = materialize(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL"), "edges")
    rounds = []
    while True:
        at = _hooked(left)
        rounds.append(at)
        to = lambda c: at.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        ends = left.join(to("u"), "u").join(to("v"), "v").where("u_to <> v_to")
        new = materialize(ends.select(F.greatest("u_to", "v_to").alias("u"), F.least("u_to", "v_to").alias("v")).distinct(), "edges")
        release(left)
        left = new
        if left.isEmpty():
            break
    names = rounds[-1].select("node", F.col("to").alias("component"))
    for at in reversed(rounds[:-1]):
        later = names.select(F.col("node").alias("to"), "component")
        names = at.join(later, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    out = materialize(names, "labels")
    release(left, *rounds)
    return out
