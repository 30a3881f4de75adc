"""Idempotent append of memories and their edges.

A batch has ``uuid, kind, metadata, parts, targets (array of uuids), arrival (orderable)``
and gives what row-by-row appends in order of arrival would give: the first row of an
unseen uuid is stored, later ones and known ones change nothing; an edge is kept if its
target is stored already or arrives no later than its source; other edges are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import valid
from ..sources.shared import cut, number_rows


@dataclass(frozen=True)
class Appended:
    """New rows and edges, how many edges were dropped as dangling, and rows that are invalid."""

    memories: DataFrame
    edges: DataFrame
    dangling: DataFrame
    quarantine: DataFrame


def append(memories: DataFrame, batch: DataFrame) -> Appended:
    ok = valid(F.col("kind"), F.col("parts"))
    good, bad = batch.where(ok & F.col("uuid").isNotNull()), batch.where(~ok | F.col("uuid").isNull())
    # rows of one uuid meet as one aggregate, so a hot uuid is folded inside each task
    row = F.struct("arrival", "kind", "metadata", "parts", F.col("targets"))
    first = good.groupBy("uuid").agg(F.min(row).alias("r")).select("uuid", "r.*")
    fresh = first.join(memories.select("uuid"), "uuid", "left_anti")
    start = memories.agg(F.coalesce(F.max("rowid"), F.lit(0))).head()[0]
    new = cut(number_rows(fresh, ["arrival", "uuid"], "rowid").withColumn("rowid", F.col("rowid") + start), "append")
    known = memories.select(F.col("rowid").alias("dst_id"), F.col("uuid").alias("dst")).unionByName(
        new.select(F.col("rowid").alias("dst_id"), F.col("uuid").alias("dst"))
    )
    wanted = new.select(F.col("rowid").alias("src_id"), F.explode(F.array_distinct("targets")).alias("dst")).where("dst is not null")
    found = wanted.join(known, "dst", "left")
    kept = F.col("dst_id").isNotNull() & (F.col("dst_id") <= F.col("src_id"))
    return Appended(
        new.select("rowid", "uuid", "kind", "metadata", "parts"),
        found.where(kept).select("src_id", "dst_id"),
        found.where(~kept).select("src_id", "dst"),
        bad,
    )
