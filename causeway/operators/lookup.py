"""Lookups, pages, neighbours and in-degrees over ``memories`` and ``edges``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def has_uuid(memories: DataFrame, uuid: str) -> bool:
    return not memories.where(F.col("uuid") == uuid).select("uuid").limit(1).isEmpty()


def existing(memories: DataFrame, keys: DataFrame) -> DataFrame:
    """Those of ``keys(uuid)`` that the store has."""
    return keys.join(memories.select("uuid"), "uuid", "left_semi")


def select_memory(memories: DataFrame, uuid: str | None = None, rowid: int | None = None) -> DataFrame:
    """One memory by either key; no row without a key.

    Only the keys given enter the predicate, so that it reaches the scan.
    """
    hit = F.lit(False)
    for name, value in (("uuid", uuid), ("rowid", rowid)):
        if value is not None:
            hit = hit | (F.col(name) == value)
    return memories.where(hit).limit(1)


def select_memories(memories: DataFrame, uuids: DataFrame | Iterable[str]) -> DataFrame:
    """All memories with the given uuids; missing ones are left out."""
    if not isinstance(uuids, DataFrame):
        given = sorted(set(uuids))
        return memories.where(F.col("uuid").isin(given) if given else F.lit(False))
    return memories.join(uuids.select("uuid"), "uuid", "left_semi")


def with_edges(memories: DataFrame, edges: DataFrame, all_memories: DataFrame | None = None) -> DataFrame:
    """``memories`` with ``edges``, the sorted uuids of what each depends on.

    ``memories`` may be a page or a point; neighbours are looked up in ``all_memories``.
    """
    names = (all_memories if all_memories is not None else memories).select(F.col("rowid").alias("dst_id"), F.col("uuid").alias("dst"))
    mine = edges.join(memories.select(F.col("rowid").alias("src_id")), "src_id", "left_semi")
    sets = mine.join(names, "dst_id").groupBy("src_id").agg(F.sort_array(F.collect_set("dst")).alias("edges"))
    out = memories.join(sets, memories["rowid"] == sets["src_id"], "left").drop("src_id")
    return out.withColumn("edges", F.coalesce("edges", F.array().cast("array<string>")))


def newest_first(memories: DataFrame) -> DataFrame:
    return memories.orderBy(F.desc("uuid"))


def page(memories: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1; 0 is page 1) of ``size`` memories, latest first; a negative size has all."""
    rows = memories.orderBy(F.desc("rowid"))
    if size < 0:
        return rows
    return rows.offset(max(0, (number - 1) * size)).limit(size)


def page_ids(memories: DataFrame, number: int, size: int) -> DataFrame:
    return page(memories.select("rowid", "uuid"), number, size).select("uuid")


def neighbours(memories: DataFrame, edges: DataFrame, of: DataFrame, direction: str) -> DataFrame:
    """``of_id`` with the memory it depends on ("dependencies") or that refers to it ("references").

    ``of`` has ``rowid``; one join serves all given memories.
    """
    near, far = ("src_id", "dst_id") if direction == "dependencies" else ("dst_id", "src_id")
    asked = edges.join(of.select(F.col("rowid").alias(near)).distinct(), near)
    return asked.select(F.col(near).alias("of_id"), F.col(far).alias("rowid")).join(memories, "rowid")


def backward_edges(memories: DataFrame, edges: DataFrame, of: DataFrame) -> DataFrame:
    return neighbours(memories.select("rowid", "uuid"), edges, of, "dependencies").select("of_id", "uuid")


def indegrees(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """``rowid, refs``: how many memories refer to each one, counted before the join."""
    counts = edges.groupBy(F.col("dst_id").alias("rowid")).agg(F.count(F.lit(1)).alias("refs"))
    return memories.select("rowid").join(counts, "rowid", "left").select("rowid", F.coalesce("refs", F.lit(0)).alias("refs"))


def memories_with_indegree_at_most(memories: DataFrame, edges: DataFrame, count: int | None) -> DataFrame:
    """Memories that ``count`` others or fewer refer to, newest first; no row without a count."""
    few = indegrees(memories, edges).where(F.col("refs") <= F.lit(count).cast("long"))
    return memories.join(few, "rowid").orderBy(F.desc("uuid"))


def ask(spark, text: str, args: dict[str, object] | None = None, **tables: DataFrame) -> DataFrame:
    """A SQL statement with named markers (``:name``) over the given tables (``{name}``)."""
    return spark.sql(text, args=args or {}, **tables)
