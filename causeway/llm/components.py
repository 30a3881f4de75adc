"""Connected components of an undirected graph, by alternating large and small stars.

Edges live in tables of the shared folder; nothing but a count reaches the driver.
Each round first joins the edges inside every task (a forest of at most as many
edges as vertices seen), which plays the part of a map-side combine, so a vertex
with very many neighbours meets its star in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_narrow, drop


class Forest:
    """Union-find over integers, roots being the least member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        lo, hi = (a, b) if a < b else (b, a)
        self.parent[hi] = lo
        self.parent.setdefault(lo, lo)
        return True


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forest = Forest()
    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            forest.join(a, b)
        if len(forest.parent) > 1_000_000:  # bounded memory: pass on what is joined so far
            yield _stars(forest)
            forest = Forest()
    yield _stars(forest)


def _stars(forest: Forest) -> pd.DataFrame:
    low, top = [], []
    for x in list(forest.parent):
        r = forest.root(x)
        if r != x:
            low.append(x)
            top.append(r)
    return pd.DataFrame({"a": np.array(low, np.int64), "b": np.array(top, np.int64)})


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``vertex, component`` (least vertex reachable) for every vertex with an edge.

    ``edges`` has the long columns ``a`` and ``b``; loops, nulls and repeated edges
    do not matter.  Vertices without an edge to another vertex are not returned.
    """
    clean = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    now = cut(clean.mapInPandas(_combine, "a long, b long").distinct(), "cc")
    rows = now.count()  # what follows has fewer
    for _ in range(max_rounds):
        # a > b throughout: every vertex points at a smaller one
        least = now.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("x"))
        # done when each vertex has one target and no target points further
        deeper = now.select(F.col("b").alias("a")).distinct().join(least, "a", "left_semi")
        branching = least.where("m <> x").select("a")
        if deeper.unionAll(branching).isEmpty():
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionAll(
                now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
            )
        # each vertex and its neighbours hang on to the least vertex known to it,
        # which in turn follows its own least target
        step = now.join(least.select("a", "m"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        both = step.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b")
        hop = least.select(F.col("a").alias("b"), F.col("m").alias("up"))
        moved = both.join(hop, "b", "left").select("a", F.coalesce("up", "b").alias("b"), F.col("b").alias("via"))
        both = moved.select("a", "b").unionAll(moved.where("via <> b").select(F.col("via").alias("a"), "b"))
        both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        after = cut_narrow(both.mapInPandas(_combine, "a long, b long").distinct(), rows, "cc")
        drop(now)
        now = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
