"""Conversion of recalled memories into ordered messages of a chat.

``memories`` has ``graph_id, id, kind, metadata, parts, pos`` (position, dependencies first) and
``edges`` the columns ``graph_id, src_id, dst_id``.  A memory of kind "self" becomes a response,
one of kind "other" a request.  Results of a response's tool calls open the next request; if a
response or the end follows, they make a request of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUT = ["graph_id", "msg_seq", "msg_type", "part_seq", "part_kind", "content", "tool_name", "call_id"]


def display_ids(recalled: DataFrame) -> DataFrame:
    """``graph_id, id, display_id``: 1, 2, 3 ... in the order of insertion."""
    w = Window.partitionBy("graph_id").orderBy("seq")
    return recalled.select("graph_id", F.col("node_id").alias("id"), F.row_number().over(w).alias("display_id"))


def placeholder(part: Column) -> Column:
    return F.format_string("[file failed to load %s %s]", part["mimetype"], part["file"])


def merge_texts(parts: Column) -> Column:
    """Adjacent text parts joined to one, files as placeholders (``array<struct<kind,content>>``)."""
    seen = F.transform(
        parts, lambda p: F.struct(
            p["kind"].alias("kind"), F.when(p["kind"] == "file", placeholder(p)).otherwise(p["content"]).alias("content")
        )
    )
    start = F.array().cast("array<struct<kind:string,content:string>>")

    def add(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(F.lit("text").alias("kind"), F.concat(last["content"], p["content"]).alias("content"))
        both = (last["kind"] == "text") & (p["kind"] == "text")
        return F.when(F.coalesce(both, F.lit(False)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(
            F.concat(acc, F.array(p))
        )

    return F.aggregate(seen, start, add)


def messages(memories: DataFrame, edges: DataFrame, ids: DataFrame, header: bool = True) -> DataFrame:
    """One row for each part of each message, in the columns ``OUT``."""
    shown = ids.select("graph_id", F.col("id").alias("dst_id"), F.col("display_id").alias("dst_shown"))
    depends = edges.join(shown, ["graph_id", "dst_id"]).groupBy("graph_id", F.col("src_id").alias("id")).agg(
        F.sort_array(F.collect_set("dst_shown")).alias("depends")
    )
    m = memories.join(ids, ["graph_id", "id"]).join(depends, ["graph_id", "id"], "left")
    order = Window.partitionBy("graph_id").orderBy("pos")
    is_tool = lambda p: p["kind"] == "tool"
    tools = F.when(F.col("kind") == "self", F.filter("parts", is_tool)).otherwise(F.filter("parts", lambda p: F.lit(False)))
    m = m.withColumn("tools", tools).withColumn("next_kind", F.lead("kind").over(order))
    m = m.withColumn("owed", F.coalesce(F.size(F.lag("tools").over(order)), F.lit(0)) > 0)
    # a memory opens a message; owed results open one more unless a request follows
    extra = (F.size("tools") > 0) & (F.coalesce(F.col("next_kind"), F.lit("end")) != "other")
    m = m.withColumn("opened", F.lit(1) + extra.cast("int"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("msg_seq", F.coalesce(F.sum("opened").over(before), F.lit(0)) + 1)
    text = F.concat(
        F.lit("---\nid: "), F.col("display_id").cast("string"), F.lit("\ndepends: ["), F.array_join(F.coalesce("depends", F.array().cast("array<int>")).cast("array<string>"), ", "),
        F.lit("]\nmetadata: "), F.coalesce("metadata", F.lit("{}")), F.lit("\n---\n"),
    ) if header else F.lit("")
    merged = merge_texts(F.col("parts"))
    # the header belongs to the first text; files alone follow it
    head = F.struct(F.lit("text").alias("kind"), text.alias("content"))
    with_head = F.when(
        F.coalesce(F.try_element_at(merged, F.lit(1))["kind"] == "text", F.lit(False)),
        F.concat(F.array(F.struct(F.lit("text").alias("kind"), F.concat(text, F.try_element_at(merged, F.lit(1))["content"]).alias("content"))), F.slice(merged, 2, F.greatest(F.size(merged) - 1, F.lit(0)))),
    ).otherwise(F.concat(F.array(head), merged) if header else merged)
    none = F.lit(None).cast("string")

    def row(kind: Column, content: Column, name: Column = none, call: Column = none) -> Column:
        return F.struct(kind.alias("part_kind"), content.alias("content"), name.alias("tool_name"), call.alias("call_id"))

    own_self = F.transform("parts", lambda p: row(
        F.when(p["kind"] == "think", "thinking").when(p["kind"] == "tool", "tool-call").when(p["kind"] == "file", "file").otherwise(p["kind"]),
        F.when(p["kind"] == "tool", p["args"]).when(p["kind"] == "file", placeholder(p)).otherwise(p["content"]), p["name"], p["call_id"],
    ))
    own_other = F.transform(with_head, lambda p: row(p["kind"], p["content"]))
    returns = F.transform("tools", lambda p: row(F.lit("tool-return"), p["result"], p["name"], p["call_id"]))
    own = F.when(F.col("kind") == "self", own_self).otherwise(own_other)
    kind = F.when(F.col("kind") == "self", "response").when(F.col("kind") == "other", "request").otherwise(F.raise_error("unknown kind"))
    offset = F.when(F.col("kind") == "other", F.coalesce(F.size(F.lag("tools").over(order)), F.lit(0))).otherwise(0)
    m = m.withColumn("offset", offset)
    mine = m.select("graph_id", "msg_seq", kind.alias("msg_type"), "offset", F.posexplode(own).alias("i", "p"))
    # results go to the next message: a request that is there, or one of their own
    later = m.where(F.size("tools") > 0).select(
        "graph_id", (F.col("msg_seq") + 1).alias("msg_seq"), F.lit("request").alias("msg_type"), F.lit(0).alias("offset"), F.posexplode(returns).alias("i", "p")
    )
    return mine.unionByName(later).select(
        "graph_id", F.col("msg_seq").cast("bigint").alias("msg_seq"), "msg_type", (F.col("offset") + F.col("i") + 1).cast("bigint").alias("part_seq"),
        "p.part_kind", "p.content", "p.tool_name", "p.call_id",
    )


def replies(results: DataFrame, ids: DataFrame) -> DataFrame:
    """``graph_id, new_id, dst_id`` from replies ``graph_id, new_id, data`` whose JSON names display ids."""
    parsed = results.withColumn("r", F.from_json("data", "depends array<int>, response string"))
    named = parsed.select("graph_id", "new_id", F.col("r.response").alias("response"), F.explode(F.array_distinct("r.depends")).alias("display_id"))
    return named.join(ids, ["graph_id", "display_id"]).select("graph_id", "new_id", F.col("id").alias("dst_id"), "response")


def replay(memories: DataFrame) -> DataFrame:
    """``graph_id, pos, line``: "[ref:..]" before every memory, "[final]" before the last one's."""
    last = Window.partitionBy("graph_id").orderBy(F.desc("pos"))
    refs = F.format_string("[ref:%s] %s", F.col("display_id").cast("string"), F.col("content"))
    return memories.select("graph_id", "pos", F.when(F.row_number().over(last) == 1, F.concat(F.lit("[final] "), refs)).otherwise(refs).alias("line"))
