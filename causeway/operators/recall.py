"""Recall: a budgeted breadth-first forest around root memories, in both directions.

Many recalls run at once: ``roots`` has ``graph_id, node_id``, and every step is one join
over all graphs.  A level is written to the shared folder before the next one starts, so
lineage stays short and lost executors cost a level at most; the driver sees one row with
the state of the loop.  Levels are numbered graph by graph, or over ranges where a graph has
more than ``WIDE`` rows, so one graph may be as large as the store.  Graphs whose roots use up the budget are done before anything is joined.

Order, where it decides ties: roots by id; level 1 by (root, references before dependencies,
id); later levels by (references before dependencies, discovery of the parent, id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adjacency import Adjacency
from ..sources.schema import RecallConfig
from ..sources.shared import cut, number_rows

RECALL = "graph_id bigint, node_id bigint, level int, dir string, parent_id bigint, refcount bigint, seq bigint"
REF, DEP = 0, 1
#: Rows of a graph that one task numbers.
WIDE = 50_000


def _in_order(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """``df``, which should be a table, numbered inside each graph."""
    most = df.groupBy("graph_id").count().agg(F.max("count")).head()[0] or 0
    if most > WIDE:
        return number_rows(df, ["graph_id", *order], name)
    return df.withColumn(name, F.row_number().over(Window.partitionBy("graph_id").orderBy(*order)).cast("bigint"))


def _candidates(front: DataFrame, edges: DataFrame | Adjacency, directions: dict[int, tuple[str, str]], cross: bool) -> DataFrame:
    """All edges that leave the fringe: (graph_id, child, parent, pseq, dir)."""
    out = None
    for d, (near, far) in directions.items():
        side = front if cross else front.where(F.col("dir") == d)
        held = edges.near(near) if isinstance(edges, Adjacency) else edges
        got = side.select("graph_id", F.col("node_id").alias("parent"), F.col("seq").alias("pseq"), (F.col("level") + 1).alias("level")).join(
            held.select(F.col(near).alias("parent"), F.col(far).alias("child")), "parent"
        ).select("graph_id", "child", "parent", "pseq", "level", F.lit(d).alias("dir"))
        out = got if out is None else out.unionAll(got)
    return out


def recall(memories: DataFrame, edges: DataFrame | Adjacency, roots: DataFrame, config: RecallConfig = RecallConfig()) -> DataFrame:
    """``graph_id, node_id, level, dir, parent_id, refcount, seq``; ``seq`` is the order of insertion."""
    spark = memories.sparkSession
    reach = {REF: RecallConfig.reach(config.refs), DEP: RecallConfig.reach(config.deps)}
    ways = {REF: ("dst_id", "src_id"), DEP: ("src_id", "dst_id")}
    asked = roots.select("graph_id", "node_id").where("node_id is not null").distinct()
    present = memories.select(F.col("rowid").alias("node_id"))
    found = asked.join(present, "node_id", "left_semi").select(
        "graph_id", "node_id", F.lit(0).alias("level"), F.lit(None).cast("int").alias("dir"), F.lit(None).cast("bigint").alias("parent_id"),
        F.lit(None).cast("bigint").alias("refcount"),
    )
    root_table = cut(_in_order(cut(found, "roots"), ["node_id"]), "recall")
    # identifiers reached so far, those missing from the store included: they count for the budget
    seen = asked
    # what is left of the budget after the roots decides which graphs go on at all
    room = root_table.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < config.memories).select("graph_id")
    front, level = root_table.join(room, "graph_id", "left_semi"), 0
    parts, fronts = [root_table], [root_table]
    while level or not front.isEmpty():
        level += 1
        found = _candidates(front, edges, ways, cross=level == 1)
        by = ["pseq", "dir", "child"] if level == 1 else ["dir", "pseq", "child"]
        best = found.groupBy("graph_id", "child").agg(
            F.min(F.struct(*by, "parent")).alias("w"), F.count(F.lit(1)).alias("refcount"), F.max("level").alias("level")
        )
        fresh = best.join(seen.select("graph_id", F.col("node_id").alias("child")), ["graph_id", "child"], "left_anti")
        # the level comes from the data, so that all rounds share their generated code
        base = F.shiftleft(F.col("level").cast("bigint"), 40)
        new = fresh.select("graph_id", F.col("child").alias("node_id"), "level", F.col("w.dir").alias("dir"), F.col("w.parent").alias("parent_id"), "refcount", F.col("w.pseq").alias("pseq"))
        new = cut(new, "level")
        won = _in_order(new, ["node_id" if c == "child" else c for c in by]).select("graph_id", "node_id", "level", "dir", "parent_id", "refcount", (F.col("seq") + base).alias("seq"))
        seen = seen.unionAll(new.select("graph_id", "node_id"))
        kept = won.where(F.when(F.col("dir") == REF, F.lit(level <= reach[REF])).otherwise(F.lit(level <= reach[DEP])))
        # graphs below their budget take the fringe in whole and expand it; the others end here
        size = seen.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
        below = size.where(F.col("n") < config.memories).select("graph_id")
        marked = cut(kept.join(below.withColumn("below", F.lit(True)), "graph_id", "left"), "recall")
        on = F.col("below").isNotNull()
        go, end = marked.agg(F.count(F.when(on, 1)), F.count(F.when(~on, 1))).head()
        if end:
            have = fronts[0].select("graph_id")
            for f in fronts[1:]:
                have = have.unionAll(f.select("graph_id"))
            have = have.groupBy("graph_id").agg(F.count(F.lit(1)).alias("have"))
            fill = Window.partitionBy("graph_id").orderBy(F.desc("refcount"), "dir", "seq")
            # each task keeps no more of a graph than its budget
            ended = marked.where(~on).withColumn("place", F.row_number().over(fill)).where(F.col("place") <= config.memories).join(have, "graph_id", "left")
            ended = ended.where(F.col("place") <= F.lit(config.memories) - F.coalesce("have", F.lit(0)))
            parts.append(cut(ended.withColumn("seq", (base + F.col("place")).cast("bigint")).select(*won.columns), "recall"))
        if not go:
            break
        front = marked.where(on).select(*won.columns)
        parts.append(front)
        fronts.append(front)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    name = F.when(F.col("level") == 0, "root").when(F.col("dir") == REF, "ref").otherwise("dep")
    numbered = _in_order(out, ["seq"], "n")
    first = numbered.groupBy("graph_id").agg(F.min("n").alias("first"))
    return numbered.join(first, "graph_id").select(
        "graph_id", "node_id", "level", name.alias("dir"), "parent_id", "refcount", (F.col("n") - F.col("first") + 1).alias("seq")
    )


def forest_edges(recalled: DataFrame) -> DataFrame:
    """The discovery edges: (src_id depends on dst_id)."""
    ref = F.col("dir") == "ref"
    return recalled.where("dir <> 'root'").select(
        "graph_id", F.when(ref, F.col("node_id")).otherwise(F.col("parent_id")).alias("src_id"),
        F.when(ref, F.col("parent_id")).otherwise(F.col("node_id")).alias("dst_id"),
    )


def induced_edges(recalled: DataFrame, edges: DataFrame) -> DataFrame:
    """All stored edges between recalled nodes."""
    a = recalled.select("graph_id", F.col("node_id").alias("src_id"))
    b = recalled.select("graph_id", F.col("node_id").alias("dst_id"))
    return a.join(edges, "src_id").join(b, ["graph_id", "dst_id"]).select("graph_id", "src_id", "dst_id")
