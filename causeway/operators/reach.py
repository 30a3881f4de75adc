"""Reachability by labels: who depends on whom, through any number of steps, without all pairs.

Every node has at most one *parent*, the latest of those it depends on.  That makes a forest,
and a walk through it that visits parents before children numbers the nodes: the subtree of
a node is an interval of numbers.  So "x depends on y along parents" is one comparison of two
labels.  What the forest leaves out are the edges to other nodes; of those, only edges whose
target is no ancestor in the forest anyway are kept, as *exceptions*.  A pair that the
intervals leave open is searched along exceptions alone: from a node to the nearest exception
at it or above it, from there to the next one above and through the exception to its target.

Labels are one row a node, exceptions at most one row an edge, built in rounds that double
(subtree sizes, numbers and nearest exceptions, log2(depth) rounds each).  Siblings are
numbered by running sums over ranges, so a parent with very many children is no one task's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, drop, running_sums
from .dag import climb


#: Rounds that paths of 2**MOST steps take.
MOST = 48
#: Stands for no exception; less than any identifier.
NONE = -(1 << 63)


@dataclass(frozen=True)
class Labels:
    """``nodes(id, first, last, exit)``: interval of the subtree, and the nearest node at it or
    above it that has exceptions; ``exceptions(id, first, above, target, target_first,
    target_exit)``.  ``in_order``: every edge leads to a smaller id, so a search can stop below its goal."""

    nodes: DataFrame
    exceptions: DataFrame
    in_order: bool


def _sizes(parents: DataFrame) -> DataFrame:
    """``id, up, size``: nodes in the subtree of each, counted down to twice the depth every round."""
    now = cut(parents.select("id", "up", F.col("up").alias("far"), F.lit(1).cast("long").alias("size")), "sizes")
    rounds = 0
    while not now.where("far is not null").isEmpty():
        if (rounds := rounds + 1) > MOST:
            raise ValueError("the graph has a cycle")
        got = now.where("far is not null").groupBy("far").agg(F.sum("size").alias("got")).withColumnRenamed("far", "id")
        hop = now.select(F.col("id").alias("far"), F.col("far").alias("next"))
        after = now.join(got, "id", "left").join(hop, "far", "left").select("id", "up", F.col("next").alias("far"), (F.col("size") + F.coalesce("got", F.lit(0))).alias("size"))
        after = cut(after, "sizes")
        drop(now)
        now = after
    return now.select("id", "up", "size")


def label(nodes: DataFrame, edges: DataFrame) -> Labels:
    """Labels of the graph ``nodes(id)``, ``edges(src_id, dst_id)`` (``src_id`` depends on ``dst_id``).

    The graph must have no cycles; loops and edges to missing nodes are left out.
    """
    known = nodes.select("id").distinct()
    links = edges.where("src_id <> dst_id").join(known.select(F.col("id").alias("src_id")), "src_id", "left_semi")
    links = cut(links.join(known.select(F.col("id").alias("dst_id")), "dst_id", "left_semi").select("src_id", "dst_id").distinct(), "links")
    in_order = links.where("dst_id > src_id").isEmpty()
    parents = known.join(links.groupBy(F.col("src_id").alias("id")).agg(F.max("dst_id").alias("up")), "id", "left")
    sizes = _sizes(parents)
    # a child's number is its parent's, plus one, plus the subtrees of the siblings before it
    before = running_sums(sizes, [F.asc_nulls_first("up"), F.asc("id")], F.col("size"))
    start = before.groupBy("up").agg(F.min("before").alias("start"))
    step = before.where("up is not null").join(start, "up").select("id", "up", (F.col("before") - F.col("start") + 1).alias("d"))
    step = step.unionByName(before.where("up is null").select("id", "up", F.col("before").alias("d")))
    numbered = climb(step).select("id", F.col("d").alias("first"))
    plain = cut(numbered.join(sizes, "id").select("id", "up", "first", (F.col("first") + F.col("size") - 1).alias("last")), "labels")
    a = plain.select(F.col("id").alias("src_id"), F.col("first").alias("src_first"), F.col("up").alias("src_up"))
    b = plain.select(F.col("id").alias("dst_id"), F.col("first").alias("dst_first"), F.col("last").alias("dst_last"))
    kept = links.join(a, "src_id").where("dst_id <> src_up").join(b, "dst_id").where(~F.col("src_first").between(F.col("dst_first"), F.col("dst_last")))
    kept = cut(kept.select("src_id", "src_first", "src_up", "dst_id", "dst_first"), "exceptions")
    # paths to the nearest exception end at it; the value carried along is the last node met
    sources = kept.select(F.col("src_id").alias("id"), F.lit(True).alias("has")).distinct()
    steps = plain.join(sources, "id", "left").select(
        "id", F.when(F.col("has").isNull(), F.col("up")).alias("up"), F.when(F.col("has"), F.col("id")).alias("d")
    )
    ended = climb(steps.withColumn("d", F.coalesce("d", F.lit(NONE))), lambda mine, other: F.greatest(mine, other))
    exits = cut(ended.select("id", F.when(F.col("d") > NONE, F.col("d")).alias("exit")), "exits")
    above = exits.select(F.col("id").alias("src_up"), F.col("exit").alias("above"))
    beyond = exits.select(F.col("id").alias("dst_id"), F.col("exit").alias("target_exit"))
    exceptions = kept.join(above, "src_up", "left").join(beyond, "dst_id", "left").select(
        F.col("src_id").alias("id"), F.col("src_first").alias("first"), "above", F.col("dst_id").alias("target"), F.col("dst_first").alias("target_first"), "target_exit"
    )
    out = cut(plain.join(exits, "id").select("id", "first", "last", "exit"), "labels")
    drop(plain)
    return Labels(out, cut(exceptions, "exceptions"), in_order)


def is_ancestor(labels: Labels, asked: DataFrame) -> DataFrame:
    """``src_id, dst_id, reaches`` for the pairs ``asked(src_id, dst_id)``: whether ``src_id``
    depends on ``dst_id`` through one step or more; false where either is missing.

    Pairs that intervals don't decide are searched together, a join over exceptions a round;
    a search visits an exception once, and with ``in_order`` none below its goal.
    """
    pairs = asked.select("src_id", "dst_id").distinct()
    a = labels.nodes.select(F.col("id").alias("src_id"), F.col("first").alias("src_first"), "exit")
    b = labels.nodes.select(F.col("id").alias("dst_id"), F.col("first").alias("lo"), F.col("last").alias("hi"))
    both = cut(pairs.where("src_id <> dst_id").join(a, "src_id").join(b, "dst_id"), "asked")
    inside = F.col("src_first").between(F.col("lo"), F.col("hi"))
    found = [both.where(inside).select("src_id", "dst_id")]

    def onward(at: DataFrame) -> DataFrame:
        """Where searches go on: not below the goal, if ids are in order."""
        return at.where("at is not null" + (" and at > dst_id" if labels.in_order else "")).select("src_id", "dst_id", "lo", "hi", "at").distinct()

    front = cut(onward(both.where(~inside).withColumn("at", F.col("exit"))), "front")
    seen = [front]
    while not front.isEmpty():
        ways = cut(front.join(labels.exceptions.withColumnRenamed("id", "at"), "at"), "ways")
        hits = cut(ways.where(F.col("target_first").between(F.col("lo"), F.col("hi"))).select("src_id", "dst_id").distinct(), "hits")
        found.append(hits)
        ahead = ways.select("src_id", "dst_id", "lo", "hi", F.col("above").alias("at")).unionAll(ways.select("src_id", "dst_id", "lo", "hi", F.col("target_exit").alias("at")))
        ahead = onward(ahead).join(hits, ["src_id", "dst_id"], "left_anti")
        for s in seen:
            ahead = ahead.join(s.select("src_id", "dst_id", "at"), ["src_id", "dst_id", "at"], "left_anti")
        front = cut(ahead, "front")
        drop(ways)
        seen.append(front)
        if len(seen) > 8:  # few tables, however many rounds
            together = seen[0]
            for s in seen[1:]:
                together = together.unionByName(s)
            seen = [cut(together, "seen")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return asked.select("src_id", "dst_id").join(out.distinct().withColumn("hit", F.lit(True)), ["src_id", "dst_id"], "left").select(
        "src_id", "dst_id", F.coalesce("hit", F.lit(False)).alias("reaches")
    )
