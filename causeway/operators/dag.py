"""Operations on graphs held as ``nodes(id, ...)`` and ``edges(src_id, dst_id)``."""

from __future__ import annotations

import heapq
import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, drop, number_rows

log = logging.getLogger(__name__)


def invert(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))


def update(nodes: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """Union; on a common key the row of ``other`` wins."""
    return other.unionByName(nodes.join(other.select(key), key, "left_anti").select(*other.columns))


def insert(nodes: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """Union; on a common key the row that is there already wins."""
    return update(other, nodes, key)


def out_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, targets`` (sorted) of every node, empty where none; edges to missing nodes left out."""
    inside = edges.join(nodes.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")
    sets = inside.groupBy(F.col("src_id").alias("id")).agg(F.sort_array(F.collect_set("dst_id")).alias("targets"))
    return nodes.select("id").join(sets, "id", "left").select("id", F.coalesce("targets", F.array().cast("array<bigint>")).alias("targets"))


def has_edges(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(src_id, dst_id)`` with ``present``; False too where the source is missing."""
    there = edges.select("src_id", "dst_id").distinct().withColumn("hit", F.lit(True))
    return asked.join(there, ["src_id", "dst_id"], "left").select("src_id", "dst_id", F.coalesce("hit", F.lit(False)).alias("present"))


def check_edges(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` edges with ``problem``: "loop", "missing" or null for edges that may be added."""
    known = nodes.select("id").distinct()
    src = known.select(F.col("id").alias("src_id"), F.lit(True).alias("has_src"))
    dst = known.select(F.col("id").alias("dst_id"), F.lit(True).alias("has_dst"))
    both = asked.join(src, "src_id", "left").join(dst, "dst_id", "left")
    problem = F.when(F.col("src_id") == F.col("dst_id"), "loop").when(F.col("has_src").isNull() | F.col("has_dst").isNull(), "missing")
    return both.select("src_id", "dst_id", problem.alias("problem"))


def add_edges(nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    good = check_edges(nodes, asked).where("problem is null").select("src_id", "dst_id")
    return edges.select("src_id", "dst_id").unionByName(good).distinct()


def reachable(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """All ``src_id, dst_id`` with a path from one to the other (doubling its length each round)."""
    paths = cut(edges.where("src_id <> dst_id").select("src_id", "dst_id").distinct(), "paths")
    n = paths.count()
    for _ in range(max_rounds):
        hop = paths.select(F.col("src_id").alias("dst_id"), F.col("dst_id").alias("next"))
        longer = paths.join(hop, "dst_id").select("src_id", F.col("next").alias("dst_id"))
        paths = cut(paths.unionByName(longer).distinct(), "paths")
        if (m := paths.count()) == n:
            return paths
        n = m
    raise RuntimeError(f"paths are longer than 2**{max_rounds}")


def toposort_one(ids: list[int], keys: list, edges: list[tuple[int, int]], reverse: bool = False) -> list[int]:
    """Dependents first; among ready nodes the one of least key (nulls first), then least id.

    ``reverse`` takes the greatest key first.  Nodes on a cycle, or reached only through one,
    are left out, as are edges to nodes that are not there.
    """
    key = dict(zip(ids, keys))
    targets: dict[int, set[int]] = {i: set() for i in key}
    waiting = dict.fromkeys(key, 0)
    for s, d in set(edges):
        if s in key and d in key and d not in targets[s]:
            targets[s].add(d)
            waiting[d] += 1
    # ranks of the keys stand for them, so that the order can be turned round
    order = {k: i for i, k in enumerate(sorted({k for k in key.values() if k is not None}))}
    sign = -1 if reverse else 1

    def rank(i: int) -> tuple[bool, int, int]:
        return key[i] is not None, sign * order.get(key[i], 0), i

    ready = [rank(i) for i, n in waiting.items() if not n]
    heapq.heapify(ready)
    out = []
    while ready:
        i = heapq.heappop(ready)[2]
        out.append(i)
        for d in targets[i]:
            waiting[d] -= 1
            if not waiting[d]:
                heapq.heappush(ready, rank(d))
    return out


def toposort(nodes: DataFrame, edges: DataFrame, key: Column | None = None, reverse: bool = False, direction: str = "dependents") -> DataFrame:
    """``graph_id, id, pos`` for many small graphs at once.

    ``nodes`` has ``graph_id, id``, ``edges`` has ``graph_id, src_id, dst_id``.  A graph is
    sorted inside one task, so it should be of the size of a recall or a conversation; see
    :func:`order` for large ones.  ``direction`` "dependencies" gives the order turned round.
    """
    named = nodes.select("graph_id", "id", (key if key is not None else F.lit(None).cast("string")).alias("k"))
    lists = named.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("id", "k"))).alias("nodes"))
    links = edges.groupBy("graph_id").agg(F.collect_set(F.struct("src_id", "dst_id")).alias("links"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g, ns, es in zip(pdf["graph_id"], pdf["nodes"], pdf["links"]):
                pairs = [(e["src_id"], e["dst_id"]) for e in (es if es is not None else [])]
                done = toposort_one([n["id"] for n in ns], [n["k"] for n in ns], pairs, reverse)
                if direction == "dependencies":
                    done = done[::-1]
                out += [(g, i, p) for p, i in enumerate(done, 1)]
            yield pd.DataFrame(out, columns=["graph_id", "id", "pos"])

    return lists.join(links, "graph_id", "left").select("graph_id", "nodes", "links").mapInPandas(task, "graph_id bigint, id bigint, pos bigint")


def climb(steps: DataFrame, combine: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``id, d, done`` from a forest of pointers ``id, up, d``: what the pointers from a node on add up to.

    ``up`` is null where a path ends, else it is a node of the table.  Every round each path doubles: a node takes over the
    value and the pointer of the node that it points at.  So a path of n steps takes
    log2(n) + 1 rounds, each a join of the nodes that are still on their way.  Nodes whose
    path leads into a circle never end: ``done`` is false for them.  ``combine`` of the own
    and the other value is their sum, unless given.
    """
    combine = combine or (lambda mine, other: mine + other)
    now = cut(steps.select("id", "up", "d"), "climb")
    n, most, rounds = now.count(), 1, 0
    while most <= 2 * n:
        far = now.select(F.col("id").alias("up"), F.col("up").alias("_next"), F.col("d").alias("_far"))
        on = now.where("up is not null").join(far, "up").select("id", F.col("_next").alias("up"), combine(F.col("d"), F.col("_far")).alias("d"))
        after = cut(now.where("up is null").select("id", "up", "d").unionAll(on), "climb")
        drop(now)
        now, most, rounds = after, 2 * most, rounds + 1
        if now.where("up is not null").isEmpty():
            break
    log.debug("%s rounds", rounds)
    return now.select("id", "d", F.col("up").isNull().alias("done"))


#: How deep a node behind a cycle counts as.
ENDLESS = 1 << 60


#: Nodes of a block that one task orders.
BLOCK = 50_000


def _in_block(rows: pd.DataFrame, whole: bool) -> pd.DataFrame:
    """Longest paths inside a block, on top of what is known of the ends of links that enter it.

    ``whole``: ``id, layer`` of each node; else ``id, up, d`` of the exposed ones: a longest
    path leads back over ``d`` links to ``up`` in another block, or starts there if null.
    """
    ids, src, far, exposed = (rows[c] for c in ("id", "src_id", "far", "exposed"))
    own, entering = src.isna(), far.notna()
    # depth, steps back to the link that enters, its other end
    at: dict[int, tuple[int, int, int | None]] = {i: (0, 0, None) for i in ids[own].tolist()}
    for i, s, d in zip(ids[entering].tolist(), src[entering].astype("int64").tolist(), far[entering].astype("int64").tolist()):
        at[i] = (min(d + 1, ENDLESS), 1, s)
    inside = ~own & ~entering
    after: dict[int, list[int]] = {}
    waiting = dict.fromkeys(at, 0)
    for i, s in zip(ids[inside].tolist(), src[inside].astype("int64").tolist()):
        after.setdefault(s, []).append(i)
        waiting[i] += 1
    ready = [i for i, n in waiting.items() if not n]
    done = 0
    while ready:
        i = ready.pop()
        done += 1
        depth, steps, end = at[i]
        for t in after.get(i, ()):
            if depth + 1 > at[t][0] and at[t][0] < ENDLESS:
                at[t] = (min(depth + 1, ENDLESS), steps + 1, end)
            waiting[t] -= 1
            if not waiting[t]:
                ready.append(t)
    if done < len(at):  # on a cycle, or behind one
        at |= {i: (ENDLESS, 0, None) for i, n in waiting.items() if n}
    if whole:
        return pd.DataFrame({"id": list(at), "layer": [x[0] for x in at.values()]}, dtype="int64")
    found = [(i, at[i]) for i in ids[own & exposed.eq(True)].tolist()]
    ends = [None if depth >= ENDLESS else end for _, (depth, _, end) in found]
    length = [ENDLESS if depth >= ENDLESS else steps for _, (depth, steps, _) in found]
    return pd.DataFrame({"id": pd.array([i for i, _ in found], "int64"), "up": pd.array(ends, "Int64"), "d": pd.array(length, "int64")})


def layers(nodes: DataFrame, edges: DataFrame, max_turns: int = 10_000, block: int = BLOCK) -> DataFrame:
    """``id, layer``: the longest path that leads to a node, in graphs of any size.

    Ordering by (layer, id) is a topological order, dependents first, though not the one of
    :func:`toposort`.  Nodes on cycles, or behind one, are left out.

    Nodes are dealt to blocks by ranges of ids.  A task finds the longest paths inside its block,
    on top of the depths of the nodes outside that refer into it, and says for each *exposed*
    node, which refers out of its block, where its path came in.  Along these
    pointers depths follow by doubling (:func:`climb`).  Turns go on until no exposed node gets
    deeper: then every depth is one more than the greatest of those that refer to it, which only
    longest paths fulfil.  A turn lengthens all paths at least by one block, mostly by all that
    is missing.
    """
    known = nodes.select("id").where("id is not null").distinct()
    blocks = max(1, -(-known.count() // block))
    known = cut(known.repartitionByRange(blocks, "id").withColumn("block", F.spark_partition_id()), "blocks")
    src, dst = (known.select(F.col("id").alias(c), F.col("block").alias(b)) for c, b in (("src_id", "from"), ("dst_id", "block")))
    links = edges.where("src_id <> dst_id").select("src_id", "dst_id").distinct().join(src, "src_id").join(dst, "dst_id")
    links = cut(links.select("block", F.col("dst_id").alias("id"), "src_id", (F.col("from") != F.col("block")).alias("enters")), "links")
    entering = links.where("enters").select("block", "id", "src_id")
    depth = cut(entering.select(F.col("src_id").alias("id")).distinct().withColumn("layer", F.lit(0).cast("long")), "exposed")
    own = known.join(depth.select("id", F.lit(True).alias("exposed")), "id", "left")
    none = F.lit(None).cast("long")
    inner = cut(own.select("block", "id", none.alias("src_id"), none.alias("far"), "exposed").unionAll(
        links.where("not enters").select("block", "id", "src_id", none, F.lit(None).cast("boolean"))
    ), "inner")

    def turn(whole: bool) -> DataFrame:
        deepest = entering.join(depth.select(F.col("id").alias("src_id"), "layer"), "src_id").groupBy("block", "id").agg(F.max(F.struct("layer", "src_id")).alias("best"))
        rows = inner.unionAll(deepest.select("block", "id", "best.src_id", "best.layer", F.lit(None).cast("boolean")))
        return rows.groupBy("block").applyInPandas(lambda pdf: _in_block(pdf, whole), "id bigint, layer bigint" if whole else "id bigint, up bigint, d bigint")

    for turns in range(max_turns):
        if not turns and depth.isEmpty():
            break
        found = climb(turn(False))
        after = cut(found.select("id", F.when(F.col("done"), F.least("d", F.lit(ENDLESS))).otherwise(F.lit(ENDLESS)).alias("layer")), "exposed")
        deeper = not after.join(depth.withColumnRenamed("layer", "was"), "id").where("layer <> was").isEmpty()
        drop(found)
        drop(depth)
        depth = after
        if not deeper:
            break
    else:
        raise RuntimeError(f"depths did not settle in {max_turns} turns")
    log.debug("%s turns", turns + 1)
    return cut(turn(True).where(F.col("layer") < ENDLESS).select("id", F.col("layer").cast("int").alias("layer")), "layers")


def order(nodes: DataFrame, edges: DataFrame, key: str | None = None, direction: str = "dependents") -> DataFrame:
    """``id, layer, pos``: a topological order of a graph of any size, numbered without one task
    seeing all nodes: by layer, then by the column ``key`` (nulls first), then by id.

    ``direction`` "dependencies" gives the order turned round.
    """
    found = layers(nodes, edges)
    if key is not None:
        found = found.join(nodes.select("id", F.col(key).alias("_key")), "id")
    by = ["layer", *(["_key"] if key is not None else []), "id"]
    if direction == "dependencies":
        by = [F.desc(c) for c in by]
    return number_rows(found, by, "pos").select("id", "layer", "pos")
