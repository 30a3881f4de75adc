"""The memory graph that the ``conversations`` table stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import uuid_of
from ..sources.schema import part


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(conversations: DataFrame) -> DataFrame:
    """``rowid, uuid, kind, metadata, parts`` and the conversation's own columns.

    The row number follows the identifier, which already orders as the rows arrived.
    """
    rowid = F.col("conv_id") * 1000 + F.col("turn")
    return conversations.select(
        rowid.alias("rowid"), uuid_of(rowid).alias("uuid"), F.when(F.col("role") == "assistant", "self").otherwise("other").alias("kind"),
        F.to_json(F.struct("role")).alias("metadata"), F.array(part("text", content=F.col("text"))).alias("parts"), "conv_id", "turn",
    )


def edges(conversations: DataFrame) -> DataFrame:
    """``src_id`` depends on ``dst_id``: the turn before, the one two before an even turn, and
    two kinds of links between conversations."""
    c = conversations.select("conv_id", "turn")
    rowid = F.col("conv_id") * 1000 + F.col("turn")
    near = c.where("turn >= 1").select(rowid.alias("src_id"), (rowid - 1).alias("dst_id"))
    two = c.where("turn >= 2 and turn % 2 = 0").select(rowid.alias("src_id"), (rowid - 2).alias("dst_id"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    heads = c.where("turn = 0 and conv_id % 3 <> 0").select("conv_id", (F.col("conv_id") - 1).alias("before"))
    chain = heads.join(last.withColumnRenamed("conv_id", "before"), "before").select(
        (F.col("conv_id") * 1000).alias("src_id"), (F.col("before") * 1000 + F.col("last")).alias("dst_id")
    )
    firsts = c.where("turn = 1").select("conv_id", (F.col("conv_id") - 5).alias("before"))
    far = firsts.join(c.where("turn = 0").select(F.col("conv_id").alias("before")), "before").select(
        (F.col("conv_id") * 1000 + 1).alias("src_id"), (F.col("before") * 1000).alias("dst_id")
    )
    return near.unionAll(two).unionAll(chain).unionAll(far).distinct()


def inner_edges(conversations: DataFrame) -> DataFrame:
    """The edges inside conversations, with ``graph_id`` (the conversation)."""
    rowid = F.col("conv_id") * 1000 + F.col("turn")
    near = conversations.where("turn >= 1").select(F.col("conv_id").alias("graph_id"), rowid.alias("src_id"), (rowid - 1).alias("dst_id"))
    two = conversations.where("turn >= 2 and turn % 2 = 0").select(F.col("conv_id").alias("graph_id"), rowid.alias("src_id"), (rowid - 2).alias("dst_id"))
    return near.unionAll(two)
