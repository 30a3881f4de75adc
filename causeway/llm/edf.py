"""Earliest deadline first over the blocks of any number of sources, in segments on Spark.

All sources run at rates that stand as their weights do; when one has no block left, the
others share its rate.  Block j of a source of weight w fills the span of this flow from
j / w to (j + 1) / w on the clock of its own source; in slots of the mixture that is a span
from one point to another, and the block's release is the first rounded down, its deadline
the second rounded up.  Whoever gets every block into its window has, after any number of
slots, less than one block more or less of any source than the flow has; earliest deadline
first does, as the flow itself shows that there is a way.

Windows come from running sums over all blocks in the order of the flow's clock, so no list
of sources reaches the driver or a task.  Edges are whole-number arithmetic; only the order of
points on the clock is by doubles, so points that differ by less than 1e-16 of their size may
trade places, which shifts an edge by no more than that share of a source's blocks.

The merge is cut into segments of ``SLOTS`` slots.  What a segment needs from the past is the
set of blocks that are released but not out yet, at most a few a source.  That set is guessed
for every segment at once (of the blocks that straddle its start, those with the latest
deadlines wait), all segments run, and those whose guess differs from what the segment before
left over run again with that, until all agree.  Then the whole is the one schedule that earliest
deadline first gives, whatever the guesses; they only decide how many segments run twice
(few, in tests; at worst one more segment is final after each round).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import running_sums
from .common import cut

#: Slots of a segment, which is one group in one task.
SLOTS = 1 << 18
#: Blocks of a source that one row stands for before they are told apart.
CHUNK = 1 << 14


def windows(sources: DataFrame) -> DataFrame:
    """``name, block, release, deadline, last`` of all blocks; ``sources`` has ``name, blocks, weight`` (whole, 1 or more)."""
    total = sources.agg(F.sum("weight")).head()[0] or 0
    chunks = sources.select("name", "blocks", "weight", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks"), F.lit(CHUNK).cast("long"))).alias("chunk"))
    # chunks of a heavy source are dealt to all tasks before they become points
    dealt = chunks.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name", "chunk")
    to = F.least(F.col("chunk") + CHUNK - 1, F.col("blocks"))
    points = dealt.select("name", "blocks", "weight", F.explode(F.sequence("chunk", to)).alias("block")).withColumn("clock", F.col("block") / F.col("weight"))
    out = F.col("block") == F.col("blocks")
    gone = {"gone": F.when(out, F.col("blocks")).otherwise(0), "stopped": F.when(out, F.col("weight")).otherwise(0)}
    placed = running_sums(points, ["clock", "name", "block"], gone)
    moved = (F.lit(total) - F.col("stopped")).cast("decimal(19,0)") * F.col("block").cast("decimal(19,0)")
    edges = placed.withColumn("moved", moved).select(
        "name", "blocks", "block", (F.col("gone") + F.expr("moved div weight")).alias("down"), (F.col("gone") + F.expr("(moved + weight - 1) div weight")).alias("up")
    )
    # a point is where one block begins and the one before it ends
    begins = edges.where("block < blocks").select("name", "block", F.col("down").alias("release"), F.lit(None).cast("long").alias("deadline"), (F.col("block") + 1 == F.col("blocks")).alias("last"))
    ends = edges.where("block > 0").select("name", F.col("block") - 1, F.lit(None).cast("long"), F.col("up"), F.lit(None).cast("boolean"))
    both = begins.union(ends).groupBy("name", "block")
    return both.agg(F.max("release").alias("release"), F.max("deadline").alias("deadline"), F.max("last").alias("last"))


def run_segment(pdf: pd.DataFrame, slots: int, total: int) -> pd.DataFrame:
    """The blocks of a segment with their slots, null for those that are left over."""
    pdf = pdf.sort_values(["release", "deadline", "name", "block"], ignore_index=True)
    start = int(pdf["seg"].iloc[0]) * slots
    end = min(total, start + slots)
    release, deadline, name, block = (pdf[c].tolist() for c in ("release", "deadline", "name", "block"))
    slot: list[int | None] = [None] * len(pdf)
    ready: list[tuple] = []
    at, t = 0, start
    while t < end and (ready or at < len(release)):
        while at < len(release) and (release[at] <= t or not ready):
            heapq.heappush(ready, (deadline[at], name[at], block[at], at))
            at += 1
        slot[heapq.heappop(ready)[3]] = t
        t += 1
    return pdf.assign(slot=pd.array(slot, dtype="Int64"))


def schedule(blocks: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``name, block, slot, phase`` for all blocks of :func:`windows`; ``phase`` counts the sources that have run out before."""
    own = cut(blocks.withColumn("seg", F.expr(f"release div {slots}")), "edf-blocks")
    sizes = {r["seg"]: r["n"] for r in own.groupBy("seg").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a segment
    total = sum(sizes.values())
    n_segments = -(-total // slots)
    released, waits = 0, []
    for k in range(n_segments):
        waits.append((k, released - k * slots))
        released += sizes.get(k, 0)
    columns = ["name", "block", "release", "deadline", "last", "seg"]
    straddle = own.withColumn("ends", F.expr(f"(deadline - 1) div {slots}")).where("ends > seg")
    each = straddle.select("name", "block", "release", "deadline", "last", F.explode(F.sequence(F.col("seg") + 1, F.col("ends"))).alias("seg"))
    latest = Window.partitionBy("seg").orderBy(F.desc("deadline"), F.desc("name"), F.desc("block"))
    spark = blocks.sparkSession
    wanted = F.broadcast(spark.createDataFrame(waits, "seg long, waiting long"))  # a row a segment
    pending = cut(each.withColumn("n", F.row_number().over(latest)).join(wanted, "seg").where("n <= waiting").select(columns), "edf-guess")

    def digests(df: DataFrame, shift: int) -> dict[int, tuple]:
        found = df.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("name", "block")).alias("x"), F.bit_xor(F.xxhash64("block", "name")).alias("y"))
        return {r["seg"] + shift: (r["n"], r["x"], r["y"]) for r in found.collect()}

    given, todo, tables = digests(pending, 0), list(range(n_segments)), {}
    run = lambda pdf: run_segment(pdf, slots, total)
    schema = "name string, block long, release long, deadline long, last boolean, seg long, slot long"
    while todo:
        rows = own.select(columns).unionByName(pending).where(F.col("seg").isin(todo))
        ran = cut(rows.groupBy("seg").applyInPandas(run, schema), "edf-ran")
        tables.update(dict.fromkeys(todo, ran))
        left = ran.where("slot is null")
        found = digests(left, 1)
        todo = [k + 1 for k in todo if k + 1 < n_segments and found.get(k + 1) != given.get(k + 1)]
        given.update({k: found.get(k) for k in todo})
        pending = left.withColumn("seg", F.col("seg") + 1).select(columns)
    if not tables:
        return spark.createDataFrame([], "name string, block long, slot long, phase long")
    final = [t.where(F.col("seg").isin([k for k in tables if tables[k] is t]) & F.col("slot").isNotNull()) for t in _distinct(tables.values())]
    out = final[0]
    for more in final[1:]:
        out = out.unionByName(more)
    # a source runs out at its last block's deadline
    slots_of = out.select("name", "block", "slot", F.lit(0).alias("ends"))
    ends = own.where("last").select(F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("block"), F.col("deadline").alias("slot"), F.lit(1).alias("ends"))
    phased = running_sums(slots_of.unionByName(ends), ["slot", F.desc("ends")], F.col("ends"), "phase")
    return phased.where("ends = 0").select("name", "block", "slot", "phase")


def _distinct(tables) -> Iterator[DataFrame]:
    seen = set()
    for t in tables:
        if id(t) not in seen:
            seen.add(id(t))
            yield t
