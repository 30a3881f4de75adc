"""The registered queries over the memory graph and the event table, with their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import actions, ids, timers
from ..operators import append, dag, lookup, reach, score, search, temporal, transcript
from ..operators.recall import forest_edges, induced_edges, recall
from ..sources import schema, stimulus
from ..sources.adjacency import Adjacency
from ..sources.schema import RecallConfig
from ..sources.shared import cut, scratch
from ..sources.store import Appender, CancelTransaction
from ..streaming import respond
from . import graph
from .oracle_recall import recall_sql

Query = Callable[[SparkSession, str], DataFrame]

GRAPH = """with m as (
  select conv_id * 1000 + turn as rowid, lpad(cast(conv_id * 1000 + turn as varchar), 32, '0') as uuid,
         case role when 'assistant' then 'self' else 'other' end as kind, role, conv_id, turn, text,
         max(turn) over (partition by conv_id) as last
  from conversations
), e as (
  select rowid as src_id, rowid - 1 as dst_id from m where turn >= 1
  union select rowid, rowid - 2 from m where turn >= 2 and turn % 2 = 0
  union select a.rowid, b.rowid from m a join m b on a.turn = 0 and b.conv_id = a.conv_id - 1 and b.turn = b.last where a.conv_id % 3 <> 0
  union select a.rowid, b.rowid from m a join m b on a.turn = 1 and b.turn = 0 and b.conv_id = a.conv_id - 5
)
"""

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = graph.table(spark, sf_dir, "conversations")
    return graph.memories(c), graph.edges(c)


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Adjacency]:
    """The graph with its derived edges written for traversal, as a store has them."""
    m, e = _graph(spark, sf_dir)
    return m, Adjacency(e)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.table(spark, sf_dir, "events").withColumn("us", temporal.micros(F.col("ts")))


# --- lookups ---------------------------------------------------------------


@query(GRAPH + "select rowid, uuid, kind from m order by rowid desc limit 7 offset 7")
def mem_list_page(spark, sf_dir):
    m, _ = _graph(spark, sf_dir)
    return lookup.page(m.select("rowid", "uuid", "kind"), 2, 7)


@query(GRAPH + "select uuid from m order by rowid desc limit 5")
def mem_list_page_zero(spark, sf_dir):
    return lookup.page_ids(_graph(spark, sf_dir)[0], 0, 5)


@query(GRAPH + """select m.rowid, coalesce(string_agg(d.uuid, ',' order by d.uuid), '') as depends
from (select * from m order by rowid desc limit 10) m left join e on e.src_id = m.rowid left join m d on d.rowid = e.dst_id group by m.rowid""")
def mem_page_with_edges(spark, sf_dir):
    m, e = _graph(spark, sf_dir)
    page = lookup.page(m.select("rowid", "uuid"), 1, 10)
    return lookup.with_edges(page, e, m).select("rowid", F.array_join("edges", ",").alias("depends"))


@query(GRAPH + "select rowid, uuid, kind, text from m order by uuid desc")
def mem_all_desc(spark, sf_dir):
    m, _ = _graph(spark, sf_dir)
    return lookup.newest_first(m).select("rowid", "uuid", "kind", F.col("parts")[0]["content"].alias("text"))


@query(GRAPH + "select rowid, uuid, kind from m where rowid = 53002")
def mem_point_lookup(spark, sf_dir):
    m, _ = _graph(spark, sf_dir)
    return lookup.select_memory(m, rowid=53002).select("rowid", "uuid", "kind")


@query(GRAPH + "select rowid, uuid from m")
def mem_multi_get(spark, sf_dir):
    """All identifiers, and one that isn't there."""
    m, _ = _graph(spark, sf_dir)
    asked = m.select("uuid").unionAll(spark.createDataFrame([("no such id",)], "uuid string"))
    return lookup.select_memories(m, asked).select("rowid", "uuid")


@query(GRAPH + "select lpad(cast(event_id as varchar), 32, '0') as uuid from events where event_id in (select rowid from m)")
def mem_exists_batch(spark, sf_dir):
    m, _ = _graph(spark, sf_dir)
    keys = graph.table(spark, sf_dir, "events").select(ids.uuid_of(F.col("event_id")).alias("uuid"))
    return lookup.existing(m, keys)


@query(GRAPH + """select m.uuid, m.kind, coalesce(string_agg(d.uuid, ',' order by d.uuid), '') as depends
from m left join e on e.src_id = m.rowid left join m d on d.rowid = e.dst_id group by m.uuid, m.kind""")
def mem_full_with_edges(spark, sf_dir):
    m, e = _graph(spark, sf_dir)
    return lookup.with_edges(m.select("rowid", "uuid", "kind"), e).select("uuid", "kind", F.array_join("edges", ",").alias("depends"))


@query(GRAPH + "select e.src_id as of_id, d.rowid, d.kind from e join m s on s.rowid = e.src_id join m d on d.rowid = e.dst_id where s.kind = 'self'")
def dependencies_of(spark, sf_dir):
    m, e = _graph(spark, sf_dir)
    return lookup.neighbours(m.select("rowid", "kind"), e, m.where("kind = 'self'"), "dependencies").select("of_id", "rowid", "kind")


@query(GRAPH + "select e.dst_id as of_id, s.rowid, s.kind from e join m s on s.rowid = e.src_id join m d on d.rowid = e.dst_id where d.turn = 0")
def references_of(spark, sf_dir):
    m, e = _graph(spark, sf_dir)
    return lookup.neighbours(m.select("rowid", "kind"), e, m.where("turn = 0"), "references").select("of_id", "rowid", "kind")


@query(GRAPH + "select e.src_id as of_id, d.uuid from e join m d on d.rowid = e.dst_id")
def backward_edges_of(spark, sf_dir):
    m, e = _graph(spark, sf_dir)
    return lookup.backward_edges(m, e, m)


@query(GRAPH + "select rowid, uuid from (select m.rowid, m.uuid, count(e.src_id) as n from m left join e on e.dst_id = m.rowid group by 1, 2) where n <= 1")
def indegree_at_most(spark, sf_dir):
    m, e = _graph(spark, sf_dir)
    return lookup.memories_with_indegree_at_most(m, e, 1).select("rowid", "uuid")


@query("select conv_id, turn, role, 'other' as declared, role <> 'assistant' as valid from conversations")
def memory_validation(spark, sf_dir):
    """Memories declared "other" whose assistant turns carry a thinking part fail validation."""
    c = graph.table(spark, sf_dir, "conversations")
    think = F.when(F.col("role") == "assistant", F.array(schema.part("think", content=F.col("text"))))
    parts = F.coalesce(think, F.array(schema.part("text", content=F.col("text"))))
    data = schema.encode(F.lit("{}"), F.lit("other"), parts)
    row = c.withColumn("d", schema.decode(data))
    return row.select("conv_id", "turn", "role", F.col("d.kind").alias("declared"), schema.valid(F.col("d.kind"), F.col("d.parts")).alias("valid"))


# --- append ----------------------------------------------------------------


def _batch(m: DataFrame, targets) -> DataFrame:
    return m.select("uuid", "kind", "metadata", "parts", targets.alias("targets"), F.col("rowid").alias("arrival"))


@query(GRAPH + """, s as (select * from m where turn < 3), n as (select * from m where turn >= 3)
select n.uuid, (select max(rowid) from s) + row_number() over (order by n.rowid) as rowid from n""")
def append_dedupe(spark, sf_dir):
    """All memories, each twice, appended to a store that has the first turns."""
    m, _ = _graph(spark, sf_dir)
    stored = m.where("turn < 3")
    batch = _batch(m, F.array().cast("array<string>"))
    again = batch.withColumn("arrival", F.col("arrival") + 10**9)
    return append.append(stored.select("rowid", "uuid"), batch.unionAll(again)).memories.select("uuid", "rowid")


@query(GRAPH + """, r as (select rowid, uuid, row_number() over (order by rowid) as n from m)
select r.n as src_id, d.n as dst_id from r join r d on d.n <= r.n and d.rowid in (r.rowid - 1, r.rowid, r.rowid + 1)""")
def append_dangling(spark, sf_dir):
    """Edges to the id before, the own id, the next id and an unknown one: later and unknown targets drop."""
    m, _ = _graph(spark, sf_dir)
    around = F.array(*[ids.uuid_of(F.col("rowid") + d) for d in (-1, 0, 1)], F.lit("unknown"))
    return append.append(m.select("rowid", "uuid").limit(0), _batch(m, around)).edges


# --- recall ----------------------------------------------------------------


def _recalls(name: str, config: RecallConfig, roots: str, graph_id: str, rounds: int) -> None:
    """A recall query for all roots that the condition picks, in the graphs of ``graph_id``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m, e = _stored(spark, sf_dir)
        last = m.groupBy("conv_id").agg(F.max("turn").alias("last"))
        picked = m.join(last, "conv_id").where(roots).select(F.expr(graph_id).cast("bigint").alias("graph_id"), F.col("rowid").alias("node_id"))
        return recall(m, e, picked, config).select("graph_id", "node_id", "level", "dir", "parent_id", "refcount")

    run.__name__ = name
    query(GRAPH + recall_sql(f"select {graph_id} as graph_id, rowid as node_id from m where {roots}", config, rounds))(run)


# a graph for each conversation, or for ten of them, or one for all
_recalls("recall_refs", RecallConfig(2, -1, 1_000_000), "turn = 1", "conv_id", 4)
_recalls("recall_deps", RecallConfig(-1, 3, 1_000_000), "turn = last", "conv_id", 5)
_recalls("recall_both", RecallConfig(2, 3, 1_000_000), "turn = 1", "conv_id", 5)
_recalls("recall_budget", RecallConfig(5, 5, 12), "turn = last", "conv_id", 8)
_recalls("recall_many", RecallConfig(2, 2, 200), "turn = 0", "conv_id - conv_id % 10", 4)
_recalls("recall_unbounded", RecallConfig(0, 0, 10**9), "turn = last", "0", 24)


@query(GRAPH + recall_sql("""select 0 as graph_id, rowid as node_id from (select rowid from m order by rowid desc limit 5)
 union select 0, rowid from (select rowid from m where kind = 'other' order by rowid desc limit 10)""", RecallConfig(2, 3, 10), 5))
def recall_chat(spark, sf_dir):
    """A chat turn at the end of the table: the five latest memories and the last ten of the history, here
    the users' turns.  Where these use up the budget, as they do here, the recall is the roots."""
    m, e = _stored(spark, sf_dir)
    latest = lookup.page(m.select("rowid"), 1, 5)
    history = lookup.page(m.where("kind = 'other'").select("rowid"), 1, 10)
    roots = latest.unionByName(history).select(F.lit(0).cast("bigint").alias("graph_id"), F.col("rowid").alias("node_id"))
    return recall(m, e, roots, RecallConfig(2, 3, 10)).select("graph_id", "node_id", "level", "dir", "parent_id", "refcount")


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Adjacency]:
    """A chat turn at the end of every conversation: its latest two memories and its last two users' turns."""
    m, e = _stored(spark, sf_dir)
    own = m.select("conv_id", "turn", "rowid", "kind")
    late = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    latest = own.withColumn("n", F.row_number().over(late)).where("n <= 2")
    history = own.where("kind = 'other'").withColumn("n", F.row_number().over(late)).where("n <= 2")
    roots = latest.unionByName(history).select(F.col("conv_id").alias("graph_id"), F.col("rowid").alias("node_id"))
    return recall(m, e, roots, RecallConfig(2, 3, 10)), e


def _turns_sql(then: str = "select * from recalled") -> str:
    roots = """select conv_id as graph_id, rowid as node_id from (select *, row_number() over (partition by conv_id order by turn desc) as n from m) where n <= 2
 union select conv_id, rowid from (select *, row_number() over (partition by conv_id order by turn desc) as n from m where kind = 'other') where n <= 2"""
    return GRAPH + recall_sql(roots, RecallConfig(2, 3, 10), 5, then)


@query(_turns_sql())
def recall_turns(spark, sf_dir):
    """The flagship: what a chat turn in every conversation recalls, within the chat's budget."""
    return _turns(spark, sf_dir)[0].select("graph_id", "node_id", "level", "dir", "parent_id", "refcount")


@query(_turns_sql("select r.graph_id, e.src_id, e.dst_id from recalled r join e on e.src_id = r.node_id join recalled t on t.graph_id = r.graph_id and t.node_id = e.dst_id"))
def recall_induced_edges(spark, sf_dir):
    """The stored edges between the recalled memories."""
    recalled, e = _turns(spark, sf_dir)
    return induced_edges(recalled, e.edges)


@query(_turns_sql("select graph_id, case dir when 'ref' then node_id else parent_id end as src_id, case dir when 'ref' then parent_id else node_id end as dst_id from recalled where dir <> 'root'"))
def recall_forest(spark, sf_dir):
    return forest_edges(_turns(spark, sf_dir)[0]).select("graph_id", "src_id", "dst_id")


# --- graphs ----------------------------------------------------------------


@query(GRAPH + "select dst_id as src_id, src_id as dst_id from e")
def invert_edges(spark, sf_dir):
    return dag.invert(_graph(spark, sf_dir)[1])


def _two_graphs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    m = _graph(spark, sf_dir)[0]
    one = m.where("turn < 4").select(F.col("rowid").alias("id"), F.lit("one").alias("origin"))
    return one, m.where("turn >= 2").select(F.col("rowid").alias("id"), F.lit("two").alias("origin"))


@query(GRAPH + "select rowid as id, case when turn >= 2 then 'two' else 'one' end as origin from m")
def dag_update(spark, sf_dir):
    return dag.update(*_two_graphs(spark, sf_dir))


@query(GRAPH + "select rowid as id, case when turn < 4 then 'one' else 'two' end as origin from m")
def dag_insert(spark, sf_dir):
    return dag.insert(*_two_graphs(spark, sf_dir))


@query(GRAPH + "select m.rowid as src_id, m.rowid - 2 as dst_id, exists(select 1 from e where e.src_id = m.rowid and e.dst_id = m.rowid - 2) as present from m")
def has_edge_batch(spark, sf_dir):
    m, e = _graph(spark, sf_dir)
    return dag.has_edges(e, m.select(F.col("rowid").alias("src_id"), (F.col("rowid") - 2).alias("dst_id")))


@query(GRAPH + """select rowid as src_id, rowid + turn % 2 as dst_id, case when turn % 2 = 0 then 'loop'
when rowid + 1 not in (select rowid from m) then 'missing' end as problem from m""")
def edge_checks(spark, sf_dir):
    m, _ = _graph(spark, sf_dir)
    asked = m.select(F.col("rowid").alias("src_id"), (F.col("rowid") + F.col("turn") % 2).alias("dst_id"))
    return dag.check_edges(m.select(F.col("rowid").alias("id")), asked)


@query(GRAPH + "select m.rowid as id, coalesce(string_agg(cast(dst_id as varchar), ',' order by dst_id), '') as targets from m left join e on src_id = rowid group by 1")
def node_targets(spark, sf_dir):
    m, e = _graph(spark, sf_dir)
    out = dag.out_edges(m.select(F.col("rowid").alias("id")), e)
    return out.select("id", F.array_join(F.col("targets").cast("array<string>"), ",").alias("targets"))


@query("""with recursive i as (select conv_id * 1000 + turn as s, conv_id * 1000 + turn - 1 as d from conversations where turn >= 1
union select conv_id * 1000 + turn, conv_id * 1000 + turn - 2 from conversations where turn >= 2 and turn % 2 = 0),
p as (select s, d from i union select p.s, i.d from p join i on p.d = i.s) select s as src_id, d as dst_id from p""")
def ancestor_closure(spark, sf_dir):
    """The attention mask of each conversation: all pairs with a path."""
    return dag.reachable(graph.inner_edges(graph.table(spark, sf_dir, "conversations")))


def _conversations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = graph.table(spark, sf_dir, "conversations")
    return graph.memories(c).select(F.col("conv_id").alias("graph_id"), F.col("rowid").alias("id"), "kind", "metadata", "parts"), graph.inner_edges(c)


@query("select conv_id as graph_id, conv_id * 1000 + turn as id, row_number() over (partition by conv_id order by turn desc) as pos from conversations")
def toposort_conv(spark, sf_dir):
    """Every conversation's order, dependents first (each turn follows the one before, so it is unique)."""
    return dag.toposort(*_conversations(spark, sf_dir))


@query("select conv_id * 1000 + turn as id, (max(turn) over (partition by conv_id) - turn)::int as layer from conversations")
def toposort_layers(spark, sf_dir):
    nodes, edges = _conversations(spark, sf_dir)
    return dag.layers(nodes, edges)


RECURSIVE = GRAPH.replace("with m", "with recursive m", 1)


@query(RECURSIVE + """, p as (select rowid as id, 0 as layer from m where rowid not in (select dst_id from e) union select e.dst_id, layer + 1 from p join e on e.src_id = p.id)
select id, max(layer)::int as layer, row_number() over (order by max(layer), id) as pos from p group by id""")
def toposort_order(spark, sf_dir):
    """One order of the whole graph, with the links between conversations: by longest path, then by id."""
    m, e = _graph(spark, sf_dir)
    return dag.order(m.select(F.col("rowid").alias("id")), e)


@query(RECURSIVE + """, p as (select src_id, dst_id from e union select p.src_id, e.dst_id from p join e on e.src_id = p.dst_id),
a as (select rowid as src_id, (conv_id - b) * 1000 as dst_id from m, (values (0), (1), (2), (5), (11)) v(b))
select a.src_id, a.dst_id, p.src_id is not null as reaches from a left join p on p.src_id = a.src_id and p.dst_id = a.dst_id""")
def ancestor_check(spark, sf_dir):
    """Whether each memory depends on the first of its own and of some earlier conversations, by labels."""
    m, e = _graph(spark, sf_dir)
    labels = reach.label(m.select(F.col("rowid").alias("id")), e)
    back = F.explode(F.array(*map(F.lit, (0, 1, 2, 5, 11)))).alias("back")
    asked = m.select("rowid", "conv_id", back).select(F.col("rowid").alias("src_id"), ((F.col("conv_id") - F.col("back")) * 1000).alias("dst_id"))
    return reach.is_ancestor(labels, asked)


@query("select conv_id as graph_id, conv_id * 1000 + turn as id, row_number() over (partition by conv_id order by turn)::int as display_id from conversations")
def display_ids(spark, sf_dir):
    nodes, _ = _conversations(spark, sf_dir)
    return transcript.display_ids(nodes.select("graph_id", F.col("id").alias("node_id"), F.col("id").alias("seq")))


@query("""with d as (select conv_id as graph_id, turn, role, text, row_number() over (partition by conv_id order by turn) as n from conversations)
select graph_id, n as msg_seq, case role when 'assistant' then 'response' else 'request' end as msg_type, 1::bigint as part_seq, 'text' as part_kind,
  case role when 'assistant' then text else '---' || chr(10) || 'id: ' || n || chr(10) || 'depends: [' ||
    case when turn = 0 then '' when turn >= 2 and turn % 2 = 0 then (n - 2) || ', ' || (n - 1) else (n - 1)::varchar end
    || ']' || chr(10) || 'metadata: {"role":"' || role || '"}' || chr(10) || '---' || chr(10) || text end as content from d""")
def transcript_messages(spark, sf_dir):
    nodes, edges = _conversations(spark, sf_dir)
    order = dag.toposort(nodes, edges, direction="dependencies")
    shown = transcript.display_ids(nodes.select("graph_id", F.col("id").alias("node_id"), F.col("id").alias("seq")))
    out = transcript.messages(nodes.join(order, ["graph_id", "id"]), edges, shown)
    return out.select("graph_id", "msg_seq", "msg_type", "part_seq", "part_kind", "content")


@query("""with d as (select conv_id as graph_id, row_number() over (partition by conv_id order by turn) as pos, count(*) over (partition by conv_id) as n, text from conversations)
select graph_id, pos, case when pos = n then '[final] ' else '' end || '[ref:' || pos || '] ' || text as line from d""")
def transcript_replay(spark, sf_dir):
    nodes, edges = _conversations(spark, sf_dir)
    order = dag.toposort(nodes, edges, direction="dependencies")
    rows = nodes.join(order, ["graph_id", "id"]).select("graph_id", "pos", F.col("pos").alias("display_id"), F.col("parts")[0]["content"].alias("content"))
    return transcript.replay(rows)


_PARTS = """with d as (select conv_id as graph_id, turn, role, text, row_number() over w as n, lead(role) over w as next, lag(role) over w as prev, lag(turn) over w as before
  from conversations window w as (partition by conv_id order by turn)),
t as (select *, (role = 'assistant' and turn % 4 = 1) as calls, coalesce(prev = 'assistant' and before % 4 = 1, false) as owed from d),
x as (select *, (calls and coalesce(next, 'assistant') = 'assistant')::int as extra from t),
s as (select *, n + coalesce(sum(extra) over (partition by graph_id order by turn rows between unbounded preceding and 1 preceding), 0) as msg from x)
"""


def _with_parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Conversations whose memories have several parts: users' turns a split text and a file,
    every other answer a thought and two tool calls."""
    c = graph.table(spark, sf_dir, "conversations")
    p, text, turn = schema.part, F.col("parts")[0]["content"], F.col("turn")
    user = F.array(p("text", content=text), p("text", content=F.lit(" (more)")), p("file", file=F.lit("a.png"), mimetype=F.lit("image/png")))
    tools = [p("tool", name=F.lit(f"tool{i}"), args=F.concat(F.lit('{"turn":'), turn, F.lit("}")), result=F.concat(F.lit(f"r{i} "), turn), call_id=F.concat(F.lit(f"c{i}-"), turn)) for i in (1, 2)]
    own = F.when(turn % 4 == 1, F.array(p("think", content=F.lit("hm")), p("text", content=text), *tools)).otherwise(F.array(p("text", content=text)))
    parts = F.when(F.col("kind") == "self", own).otherwise(user)
    return graph.memories(c).withColumn("parts", parts), graph.inner_edges(c)


@query(_PARTS + """select graph_id, msg::bigint as msg_seq, 'response' as msg_type, p.i::bigint as part_seq, p.kind as part_kind, p.content, p.name as tool_name, p.call as call_id from s, lateral (
  select unnest(case when calls then [{'i': 1, 'kind': 'thinking', 'content': 'hm', 'name': null, 'call': null}, {'i': 2, 'kind': 'text', 'content': text, 'name': null, 'call': null},
    {'i': 3, 'kind': 'tool-call', 'content': '{"turn":' || turn || '}', 'name': 'tool1', 'call': 'c1-' || turn}, {'i': 4, 'kind': 'tool-call', 'content': '{"turn":' || turn || '}', 'name': 'tool2', 'call': 'c2-' || turn}]
    else [{'i': 1, 'kind': 'text', 'content': text, 'name': null, 'call': null}] end) as p) where role = 'assistant'
union all select graph_id, msg, 'request', 1 + 2 * owed::int, 'text', '---' || chr(10) || 'id: ' || n || chr(10) || 'depends: [' ||
    case when turn = 0 then '' when turn >= 2 and turn % 2 = 0 then (n - 2) || ', ' || (n - 1) else (n - 1)::varchar end
    || ']' || chr(10) || 'metadata: {"role":"' || role || '"}' || chr(10) || '---' || chr(10) || text || ' (more)', null, null from s where role <> 'assistant'
union all select graph_id, msg, 'request', 2 + 2 * owed::int, 'file', '[file failed to load image/png a.png]', null, null from s where role <> 'assistant'
union all select graph_id, msg + 1, 'request', i, 'tool-return', 'r' || i || ' ' || turn, 'tool' || i, 'c' || i || '-' || turn from s, range(1, 3) r(i) where calls""")
def transcript_parts(spark, sf_dir):
    """Messages of memories with thoughts, tool calls, files and split texts."""
    memories, edges = _with_parts(spark, sf_dir)
    nodes = memories.select(F.col("conv_id").alias("graph_id"), F.col("rowid").alias("id"), "kind", "metadata", "parts")
    order = dag.toposort(nodes, edges, direction="dependencies")
    shown = transcript.display_ids(nodes.select("graph_id", F.col("id").alias("node_id"), F.col("id").alias("seq")))
    return transcript.messages(nodes.join(order, ["graph_id", "id"]), edges, shown)


@query("""with d as (select conv_id as graph_id, conv_id * 1000 + turn as id, turn, text, row_number() over (partition by conv_id order by turn) as n from conversations)
select a.graph_id, a.id + 500 as new_id, b.id as dst_id, a.text as response from d a join d b on b.graph_id = a.graph_id and b.n in (1, a.turn + 2)""")
def reply_edges(spark, sf_dir):
    """Replies that name display ids -- the first, the next, the next again and an unknown one -- as edges to memories."""
    nodes, _ = _conversations(spark, sf_dir)
    shown = transcript.display_ids(nodes.select("graph_id", F.col("id").alias("node_id"), F.col("id").alias("seq")))
    c = graph.table(spark, sf_dir, "conversations")
    after = F.col("turn") + 2
    data = F.to_json(F.struct(F.array(F.lit(1).cast("bigint"), after, after, F.lit(9999).cast("bigint")).alias("depends"), F.col("text").alias("response")))
    results = c.select(F.col("conv_id").alias("graph_id"), (F.col("conv_id") * 1000 + F.col("turn") + 500).alias("new_id"), data.alias("data"))
    return transcript.replies(results, shown)


# --- events ----------------------------------------------------------------

CRON = {"quarter": "*/15 9-10 * JAN MON-FRI", "daily": "@daily", "list": "5,35 6 1,15 2 *"}
SPECIAL = {"15W": "0 0 15W * *", "1W": "0 0 1W * *", "LW": "0 0 LW * *", "L": "0 0 L 2 *", "5L": "0 0 * * 5L", "1#2": "0 0 * * 1#2", "either": "0 0 13 * 5"}
@query("""with d as (select distinct ts::date as d from events)
select 'quarter' as cron, d as day, h::int as hour, mi::int as minute from d, range(9, 11) a(h), range(0, 60, 15) b(mi) where month(d) = 1 and isodow(d) <= 5
union all select 'daily', d, 0, 0 from d
union all select 'list', d, 6, mi::int from d, (values (5), (35)) c(mi) where month(d) = 2 and day(d) in (1, 15)""")
def cron_jobs(spark, sf_dir):
    """The jobs of the days on which anything happened."""
    days = graph.table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    return temporal.cron_jobs(days, CRON)


@query("""with e as (select event_id, (ts::date + (event_id % 366)::int)::date as d from events),
f as (select event_id, d, (date_trunc('month', d))::date as a, last_day(d) as z from e),
w as (select '15W' as cron, event_id, d, a + 14 as t, a, z from f union all select '1W', event_id, d, a, a, z from f union all select 'LW', event_id, d, z, a, z from f)
select event_id, cron from w where d = case when isodow(t) = 6 then case when t = a then t + 2 else t - 1 end when isodow(t) = 7 then case when t = z then t - 2 else t + 1 end else t end
union all select event_id, 'L' from f where month(d) = 2 and d = z
union all select event_id, '5L' from f where isodow(d) = 5 and d + 7 > z
union all select event_id, '1#2' from f where isodow(d) = 1 and day(d) between 8 and 14
union all select event_id, 'either' from f where isodow(d) = 5 or day(d) = 13""")
def cron_dom_dow(spark, sf_dir):
    """Special days: which entries hold on the day on which each event falls due, up to a year later."""
    due = F.date_add(F.to_date("ts"), (F.col("event_id") % 366).cast("int"))
    days = graph.table(spark, sf_dir, "events").select("event_id", due.cast("timestamp").alias("at"))
    return temporal.cron_hits(days, F.col("at"), SPECIAL).select("event_id", "cron")


HITS = {"quarter": "*/15 9-17 * * MON-FRI", "night": "5-20 0-5 * * *", "either": "* * 13 * 5", "workday": "*/2 * LW JAN *"}


@query("""select event_id, 'quarter' as cron from events where minute(ts) % 15 = 0 and hour(ts) between 9 and 17 and isodow(ts) <= 5
union all select event_id, 'night' from events where minute(ts) between 5 and 20 and hour(ts) <= 5
union all select event_id, 'either' from events where day(ts) = 13 or isodow(ts) = 5
union all select event_id, 'workday' from events where minute(ts) % 2 = 0 and month(ts) = 1
  and ts::date = case isodow(last_day(ts)) when 6 then last_day(ts) - 1 when 7 then last_day(ts) - 2 else last_day(ts) end""")
def cron_hits(spark, sf_dir):
    """The events that fall on a minute of a calendar entry."""
    return temporal.cron_hits(graph.table(spark, sf_dir, "events"), F.col("ts"), HITS).select("event_id", "cron")


@query("""with e as (select event_id, ts, epoch_us(ts) // 60000000 as mi, epoch_us(timestamp '2024-01-01 00:03:00') // 60000000 as m0 from events)
select event_id, 'cron' as kind, 'half' as name from e where minute(ts) % 30 = 0
union all select event_id, 'cron', 'five' from e where minute(ts) = 5 and hour(ts) between 8 and 18 and isodow(ts) <= 5
union all select event_id, 'timer', 'beat' from e where mi >= m0 and (mi - m0) % 7 = 0""")
def stimulus_events(spark, sf_dir):
    """Events in the minute of a tick: the stimulus source, over the span of the table, joined to it."""
    stimulus.register(spark)
    e = _events(spark, sf_dir).withColumn("minute", F.floor(F.col("us") / 60_000_000))
    first, last = e.agg(F.min("minute"), F.max("minute")).head()
    if first is None:
        return spark.createDataFrame([], "event_id bigint, kind string, name string")
    ticks = spark.read.format("stimulus").options(
        cron=json.dumps({"half": "*/30 * * * *", "five": "5 8-18 * * 1-5"}), timers=json.dumps({"beat": ["2024-01-01T00:03:00", 420]}),
        start=stimulus.time_of(first).isoformat(), end=stimulus.time_of(last + 1).isoformat(),
    ).load()
    at = ticks.select("kind", "name", F.floor(F.unix_micros("at") / 60_000_000).alias("minute"))
    return e.select("event_id", "minute").join(at, "minute").select("event_id", "kind", "name")


@query("""with t as (select user_id as timer, min(epoch_us(ts)) as f, (user_id % 5 + 1) * 3600000000 as i from events group by user_id)
select timer, n, f + n * i as at_us from t, range(0, 25) r(n) where n * i <= 86400000000""")
def timer_ticks(spark, sf_dir):
    """For every user a timer from the first event, every 1 to 5 hours, for a day."""
    t = _events(spark, sf_dir).groupBy(F.col("user_id").alias("timer")).agg(F.min("us").alias("first_us"))
    return temporal.timer_ticks(t.withColumn("interval_us", (F.col("timer") % 5 + 1) * 3_600_000_000), F.col("first_us") + 86_400_000_000)


@query("""with t as (select event_id, epoch_us(ts) // 1000000 - epoch_us((select max(ts) from events)) // 1000000 as td, case when event_id % 4 > 0 then event_id % 4 * 600 end as i from events)
select event_id, case when td >= 0 then td::double when i is not null then (td + i * (1 + floor(-td / i)))::double end as wait from t""")
def timer_catchup(spark, sf_dir):
    e = _events(spark, sf_dir)
    now = e.agg(F.floor(F.max("us") / 1_000_000).alias("now"))
    interval = F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 4 * 600)
    # one row with the present time
    rows = e.join(F.broadcast(now), F.lit(True))
    return rows.select("event_id", timers.catch_up(F.floor(F.col("us") / 1_000_000) - F.col("now"), interval).alias("wait"))


_DOG = """with t as (select user_id, epoch_us(ts) as us, lead(epoch_us(ts)) over (partition by user_id order by ts) as nxt from (select distinct user_id, ts from events))
select user_id, us as last_us, us + {0} as expired_us from t where (nxt is null or nxt > us + {0})"""


@query(_DOG.format(3_600_000_000))
def watchdog_expired(spark, sf_dir):
    return temporal.watchdog_expiries(_events(spark, sf_dir), "user_id", F.col("us"), 3_600_000_000)


@query(_DOG.format(86_400_000_000) + " and us + 86400000000 <= (select max(epoch_us(ts)) from events)")
def watchdog_horizon(spark, sf_dir):
    e = _events(spark, sf_dir)
    end = e.agg(F.max("us")).head()[0]
    return temporal.watchdog_expiries(e, "user_id", F.col("us"), 86_400_000_000, F.lit(end))


def _traffic(spark, sf_dir):
    """Requests and responses made of the events."""
    e = _events(spark, sf_dir)
    req = e.where("event_type = 'view'").select(F.col("event_id").alias("request"), F.col("us").alias("req_us"))
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    # a response at an offset from the time of the event that it answers
    resp = e.where("event_type in ('click', 'error')").select((F.col("event_id") - 1).alias("request"), status.alias("status"), F.col("event_type").alias("body"))
    at = e.select(F.col("event_id").alias("request"), (F.col("us") + F.col("event_id") % 40 * 1_000_000).alias("resp_us"))
    return req, resp.join(at, "request")


def _exchange(spark, sf_dir):
    return temporal.exchange(*_traffic(spark, sf_dir))


_EXCHANGE = """with e as (select event_id, event_type, epoch_us(ts) as us from events),
r as (select a.event_id as request, a.us + a.event_id % 40 * 1000000 as resp_us, a.event_type = 'view' as known, a.us as req_us,
  case b.event_type when 'error' then 500 else 200 end as status, b.event_type as body from e a join e b on b.event_id = a.event_id + 1 where b.event_type in ('click', 'error'))
"""


@query(_EXCHANGE + """select e.event_id as request, us as req_us, coalesce(r.status, 504)::int as status, coalesce(r.body, 'Response action not invoked.') as body
from e left join r on r.request = e.event_id and resp_us between us and us + 30000000 where event_type = 'view'""")
def request_timeout(spark, sf_dir):
    return _exchange(spark, sf_dir)[0]


@query(_EXCHANGE + "select request, resp_us, case when known then 'late' else 'unknown' end as why from r where not known or resp_us > req_us + 30000000")
def late_responses(spark, sf_dir):
    return _exchange(spark, sf_dir)[1]


@query(_EXCHANGE + """select e.event_id::varchar as request, coalesce(r.resp_us // 1000, us // 1000 + 30000)::bigint as at_ms, coalesce(r.status, 504)::int as status,
coalesce(r.body, 'Response action not invoked.') as body, '' as why from e left join r on r.request = e.event_id and resp_us between us and us + 30000000 where event_type = 'view'
union all select request::varchar, (resp_us // 1000)::bigint, status::int, body, case when known then 'late' else 'unknown' end from r where not known or resp_us > req_us + 30000000""")
def response_log(spark, sf_dir):
    """Requests and responses as streams, settled by event time and written by the sink, read back from its epochs."""
    req, resp = _traffic(spark, sf_dir)
    out, at = scratch(spark, "responses"), lambda c: F.timestamp_micros(F.col(c))
    end = spark.range(1).select(F.lit("end").alias("request"), F.lit("2100-01-01").cast("timestamp").alias("req_ts"))  # moves the watermark past all others
    asked = cut(req.select(F.col("request").cast("string").alias("request"), at("req_us").alias("req_ts")).unionByName(end), "requests")
    said = cut(resp.select(F.col("request").cast("string").alias("request"), at("resp_us").alias("resp_ts"), "status", "body"), "said")
    respond.register(spark)
    streams = [spark.readStream.schema(t.schema).parquet(t._scratch_path) for t in (asked, said)]
    sink = respond.settle(*streams).writeStream.format("respond").option("path", out)
    with respond.keeping(spark):
        stream = sink.option("checkpointLocation", scratch(spark, "responses-checkpoint")).trigger(availableNow=True).start()
    stream.awaitTermination()
    return respond.written(spark, out).where("request <> 'end'").select("request", "at_ms", "status", "body", F.coalesce("why", F.lit("")).alias("why"))


@query("""select event_id, event_type as concept, case when event_id % 13 = 0 then 'uncaught' when event_type = 'error' then 'concept' when event_id % 5 = 4 then 'no_action'
when event_id % 5 = 3 then 'event_invoked' when event_id % 5 = 2 then 'ignored' end as category from events
where event_id % 13 = 0 or event_type = 'error' or event_id % 5 >= 2""")
def deadletter_classes(spark, sf_dir):
    e = graph.table(spark, sf_dir, "events")
    calls = e.select("event_id", F.col("event_type").alias("concept"), (F.col("event_id") % 5).cast("string").alias("action"), F.when(F.col("event_id") % 13 == 0, "boom").alias("error"))
    known = ["click", "view", "signup", "purchase"]
    concepts = spark.createDataFrame([(c,) for c in known], "concept string")
    actions = spark.createDataFrame([(c, str(a), "event" if a == 3 else "action") for c in known for a in range(4)], "concept string, action string, kind string")
    rules = spark.createDataFrame([(c, str(a)) for c in known for a in (0, 1)], "concept string, action string")
    return temporal.dead_letters(calls, concepts, actions, rules).select("event_id", "concept", "category")


@query("""with t as (select *, sum((event_type = 'signup')::int) over (partition by user_id order by ts, event_id) as epoch from events)
select user_id, epoch::bigint as epoch, min(event_id) as event_id from (select *, row_number() over (partition by user_id, epoch order by ts, event_id) as n from t where event_type = 'click') where n = 1 group by 1, 2""")
def once_per_epoch(spark, sf_dir):
    e = graph.table(spark, sf_dir, "events")
    out = temporal.once(e, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "click")
    return out.select("user_id", "epoch", "event_id")


@query("select user_id as cron, event_type as spec from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1 and event_type <> 'error'")
def cron_schedule_state(spark, sf_dir):
    """The schedule that is left after each user's last command (an error cancels)."""
    c = graph.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("cron"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "cancel").otherwise("schedule").alias("action"), F.col("event_type").alias("spec")
    )
    return temporal.apply_schedule(c)


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def event_props(spark, sf_dir):
    return graph.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""select page_id, coalesce(string_agg(regexp_extract(p, '^([^=]*)', 1) || '=' || regexp_extract(p, '=(.*)$', 1), ';' order by i), '') as query
from (select page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) as p, generate_subscripts(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), 1) as i from pages)
where p <> '' group by page_id union all select page_id, '' from pages where regexp_extract(url, '\\?([^#]*)', 1) = ''""")
def page_query_strings(spark, sf_dir):
    m = ids.query_multimap(F.col("url"))
    pairs = F.flatten(F.transform(F.map_entries(m), lambda kv: F.transform(kv["value"], lambda v: F.concat(kv["key"], F.lit("="), v))))
    return graph.table(spark, sf_dir, "pages").select("page_id", F.array_join(pairs, ";").alias("query"))


# --- the documented tier ---------------------------------------------------


@query("""with q as (select embedding as v from embeddings where vec_id = 0)
select vec_id, round(list_cosine_similarity(embedding::double[], q.v::double[]), 6) as score from embeddings, q order by list_cosine_similarity(embedding::double[], q.v::double[]) desc, vec_id limit 10""")
def cosine_topk(spark, sf_dir):
    v = graph.table(spark, sf_dir, "embeddings")
    q = v.where("vec_id = 0").select("embedding").head()[0]
    return score.cosine_topk(v, q, 10).select("vec_id", F.round("score", 6).alias("score"))


@query("""select label, (i - 1)::int as dim, round(avg(x::double), 6) as mean from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by 1, 2""")
def centroids(spark, sf_dir):
    return score.centroids(graph.table(spark, sf_dir, "embeddings")).select("label", "dim", F.round("mean", 6).alias("mean"))


@query("""with t as (select event_id, epoch_us((select max(ts) from events)) / 1e6 - epoch_us(ts) / 1e6 as age, value / 100.0 as rel, cast(json_extract(props, '$.k') as double) % 11 as imp from events)
select event_id, round(exp(-ln(2.0) * age / 86400) + rel + imp / 10, 6) as score from t""")
def hybrid_score(spark, sf_dir):
    e = _events(spark, sf_dir)
    end = e.agg(F.max("us")).head()[0]
    imp = F.from_json("props", "k bigint")["k"].cast("double") % 11
    out = score.hybrid(e, (F.lit(end) / 1e6 - F.col("us") / 1e6), F.col("value") / 100.0, imp, 86_400.0)
    return out.select("event_id", F.round("score", 6).alias("score"))


@query("select conv_id, turn, round((length(text) % 11 + turn % 11) / 2.0, 6) as importance from conversations")
def annotation_importance(spark, sf_dir):
    c = graph.table(spark, sf_dir, "conversations")
    data = F.to_json(F.struct(F.create_map(F.lit("novelty"), F.length("text") % 11, F.lit("intensity"), (F.col("turn") % 11).cast("int")).alias("importance")))
    return score.annotations(c.withColumn("data", data)).select("conv_id", "turn", F.round("importance", 6).alias("importance"))


@query("""with t as (select conv_id, length(text)::double as x, row_number() over (partition by conv_id order by turn desc) - 1 as b, count(*) over (partition by conv_id) as n from conversations)
select conv_id, round(sum(x * case when b = n - 1 then power(0.5, b) else 0.5 * power(0.5, b) end), 6) as ewma from t group by conv_id""")
def importance_ewma(spark, sf_dir):
    c = graph.table(spark, sf_dir, "conversations").withColumn("x", F.length("text").cast("double"))
    return score.ewma(c, "conv_id", "turn", "x", 0.5).select("conv_id", F.round("ewma", 6).alias("ewma"))


@query(GRAPH + ", i as (select rowid, (length(text) % 11)::double as x from m) select i.rowid as id, round(x + coalesce((select sum(j.x) / 2 from e join i j on j.rowid = e.src_id where e.dst_id = i.rowid), 0), 6) as importance from i")
def importance_propagated(spark, sf_dir):
    m, e = _graph(spark, sf_dir)
    own = m.select(F.col("rowid").alias("id"), (F.length(F.col("parts")[0]["content"]) % 11).alias("importance"))
    return score.propagate(own, e, 0.5).select("id", F.round("importance", 6).alias("importance"))


@query(GRAPH + "select rowid, uuid from m where conv_id = 53 and kind = 'self'")
def ask_with_parameters(spark, sf_dir):
    m, _ = _graph(spark, sf_dir)
    return lookup.ask(spark, "select rowid, uuid from {m} where conv_id = :conv and kind = :kind", {"conv": 53, "kind": "self"}, m=m)


@query("""select conv_id as graph_id, conv_id * 1000 + turn as id,
row_number() over (partition by conv_id order by case when turn = 1 then null else length(text) end nulls first, turn) as pos from conversations""")
def toposort_by_key(spark, sf_dir):
    """Without edges the key alone orders: texts by length, a missing key first, then ids."""
    c = graph.table(spark, sf_dir, "conversations")
    nodes = c.select(F.col("conv_id").alias("graph_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") != 1, F.length("text")).alias("size"))
    return dag.toposort(nodes, graph.inner_edges(c).limit(0), F.col("size"))


@query("select event_id, epoch_us(ts) // 1000000 + event_id % 90 as ready from events")
def sleep_ready(spark, sf_dir):
    e = _events(spark, sf_dir)
    now = F.floor(F.col("us") / 1_000_000)
    return e.select("event_id", timers.ready_at(now, F.lit(None).cast("bigint"), F.col("event_id") % 90).alias("ready"))


@query("select event_id, event_type as action, props as params from events")
def invocations(spark, sf_dir):
    calls = graph.table(spark, sf_dir, "events").select(F.col("event_type").alias("action"), F.col("props").alias("params"), F.col("event_id").alias("flow"))
    return temporal.invocations(calls).select(F.col("flow").alias("event_id"), "action", "params")


@query(GRAPH + "select uuid, kind, (select count(*) from e where e.src_id = m.rowid) as n_targets from m where kind = 'other'")
def memory_builders(spark, sf_dir):
    """New memories of users' turns, built as a batch and appended to an empty store."""
    m, e = _graph(spark, sf_dir)
    rows = lookup.with_edges(m, e)
    users = rows.where("kind = 'other'").select(*schema.create_other(F.col("uuid"), F.col("parts")[0]["content"], F.col("edges")), "rowid")
    return users.select("uuid", "kind", F.size("targets").cast("bigint").alias("n_targets"))


@query(GRAPH + """, q as (select rowid as id, (length(text) % 11 + turn % 11) / 2.0 as score from m), k as (select * from q order by score desc, id limit 20),
w as (select src_id as a, dst_id as b, 1.0 / (1 + src_id - dst_id) as w from e union all select dst_id, src_id, 0.5 / (1 + src_id - dst_id) from e),
h1 as (select id, max(score) as score from (select * from k union all select b, score * w * 0.5 from k join w on a = id) group by id),
h2 as (select id, max(score) as score from (select * from h1 union all select b, score * w * 0.5 from h1 join w on a = id) group by id)
select id, round(score, 9) as score from h2 order by h2.score desc, id limit 50""")
def recall_weighted(spark, sf_dir):
    """Hybrid recall: the best memories by score, then what weighted edges lead to, to a budget."""
    m, e = _graph(spark, sf_dir)
    scored = m.select(F.col("rowid").alias("id"), ((F.length(F.col("parts")[0]["content"]) % 11 + F.col("turn") % 11) / 2.0).alias("score"))
    near = 1 / (1 + F.col("src_id") - F.col("dst_id"))
    links = e.select("src_id", "dst_id", near.alias("weight")).unionAll(e.select(F.col("dst_id"), F.col("src_id"), near * 0.5))
    return score.weighted_recall(scored, links, 20, 2, 0.5, 50).select("id", F.round("score", 9).alias("score"))


@query("select user_id as cron, (select min(epoch_us(ts)) from events) as at_us from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1 and event_type = 'signup'")
def cron_reboot(spark, sf_dir):
    """Jobs of the schedules that ask for one at the start; each user's last command counts."""
    e = _events(spark, sf_dir)
    kind = F.col("event_type")
    commands = e.select(
        F.col("user_id").alias("cron"), F.col("event_id").alias("seq"), F.when(kind == "error", "cancel").otherwise("schedule").alias("action"),
        F.when(kind == "signup", "@reboot").otherwise("@daily").alias("spec"),
    )
    return temporal.reboots(temporal.apply_schedule(commands), e.agg(F.min("us")).head()[0])


@query("select event_id, event_type as action, props as params from events where event_type = 'view'")
def echoes(spark, sf_dir):
    """Actions that answer with what they were given."""
    calls = graph.table(spark, sf_dir, "events").select(F.col("event_type").alias("action"), F.col("props").alias("params"), F.col("event_id").alias("flow"))
    return temporal.echo(calls, "view").select(F.col("flow").alias("event_id"), "action", "params")


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' as at, true as back from events")
def iso_times(spark, sf_dir):
    e = graph.table(spark, sf_dir, "events")
    at = timers.iso(F.col("ts"))
    return e.select("event_id", at.alias("at"), (F.to_timestamp(at) == F.col("ts").cast("timestamp")).alias("back"))


# --- search ------------------------------------------------------------------

_WORDS = r"""t as (select id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from d),
p as (select id, term, count(*) as tf from t group by all), l as (select id, count(*) as len from t group by id),
n as (select count(*)::double as n, (select count(*) from t) / count(*)::double as mean from d),
w as (select term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) as idf from p, n group by term, n),
x as (select p.id, p.term, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) as part from p join l using (id) join w using (term), n)
"""


@query("with d as (select conv_id * 1000 + turn as id, text from conversations),\n" + _WORDS + """,
q as (select conv_id * 1000 as query_id, term, count(*) as times from t join conversations c on t.id = c.conv_id * 1000 and c.turn = 0 where conv_id % 20 = 0 group by all),
s as (select query_id, id, round(sum(times * part), 6) as score from q join x using (term) where id <> query_id group by all)
select query_id, id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) where rank <= 10""")
def bm25_search(spark, sf_dir):
    """The ten memories most relevant to the opening of every twentieth conversation."""
    c = graph.table(spark, sf_dir, "conversations")
    said = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    opened = c.where("turn = 0 and conv_id % 20 = 0").select((F.col("conv_id") * 1000).alias("query_id"), "text")
    return search.bm25(search.index(said), opened, 10, own=False)


@query(GRAPH + ", d as (select rowid as id, text from m),\n" + _WORDS + """,
a as (select text from m where kind = 'other' order by rowid desc limit 1), b as (select term, count(*) as times from (select unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from a) group by term),
r as (select id, round(sum(times * part), 6) as score from b join x using (term) group by id),
i as (select rowid as id, count(e.src_id)::double as refs from m left join e on e.dst_id = m.rowid group by rowid),
g as (select i.id, least(10.0, refs + coalesce((select sum(j.refs) / 2 from e join i j on j.id = e.src_id where e.dst_id = i.id), 0)) as imp from i),
ce as (select label, list(mean order by dim) as c from (select label, dim, avg(x) as mean from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as dim from embeddings) group by label, dim) group by label),
so as (select vec_id, list_cosine_similarity(embedding::double[], c) as sona from embeddings join ce using (label)),
q as (select rowid as id, round(exp(-ln(2.0) * ((select max(rowid) from m) - rowid) / 10000.0) + coalesce(r.score, 0) / (select max(score) from r) + g.imp / 10 + coalesce(so.sona, 0), 6) as score
  from m left join r on r.id = m.rowid join g on g.id = m.rowid left join so on so.vec_id = (m.conv_id * 8 + m.turn) % (select count(*) from embeddings)),
k as (select * from q order by score desc, id limit 20),
z as (select src_id as a, dst_id as b, 1.0 / (1 + src_id - dst_id) as w from e union all select dst_id, src_id, 0.5 / (1 + src_id - dst_id) from e),
h1 as (select id, max(score) as score from (select * from k union all select b, score * w * 0.5 from k join z on a = id) group by id),
h2 as (select id, max(score) as score from (select * from h1 union all select b, score * w * 0.5 from h1 join z on a = id) group by id)
select id, round(score, 9) as score from h2 order by h2.score desc, id limit 50""")
def recall_hybrid(spark, sf_dir):
    """What the last user's turn recalls: recency, full-text relevance, importance by references that is
    passed along edges, and likeness to the sona make one score; the best lead on along weighted edges."""
    m, e = _graph(spark, sf_dir)
    said = m.select(F.col("rowid").alias("id"), F.col("parts")[0]["content"].alias("text"))
    asked = lookup.page(m.where("kind = 'other'"), 1, 1).select(F.lit(0).alias("query_id"), F.col("parts")[0]["content"].alias("text"))
    found = search.bm25(search.index(said), asked).select("id", F.col("score").alias("hit"))
    most, newest = found.agg(F.max("hit")).head()[0], m.agg(F.max("rowid")).head()[0]
    refs = lookup.indegrees(m, e).select(F.col("rowid").alias("id"), F.col("refs").alias("importance"))
    passed = score.propagate(refs, e, 0.5).select("id", F.least(F.lit(10.0), "importance").alias("importance"))
    vectors = graph.table(spark, sf_dir, "embeddings")
    like = score.sona_likeness(vectors)
    n = vectors.count()
    own = m.select(F.col("rowid").alias("id"), ((F.col("conv_id") * 8 + F.col("turn")) % n).alias("vec_id"))
    rows = own.join(found, "id", "left").join(passed, "id").join(like, "vec_id", "left")
    scored = score.hybrid(
        rows, F.lit(newest) - F.col("id"), F.coalesce("hit", F.lit(0.0)) / F.lit(most or 1.0), F.col("importance"), 10_000.0, likeness=F.coalesce("likeness", F.lit(0.0))
    ).select("id", F.round("score", 6).alias("score"))
    near = 1 / (1 + F.col("src_id") - F.col("dst_id"))
    links = e.select("src_id", "dst_id", near.alias("weight")).unionAll(e.select(F.col("dst_id"), F.col("src_id"), near * 0.5))
    return score.weighted_recall(scored, links, 20, 2, 0.5, 50).select("id", F.round("score", 9).alias("score"))


# --- the store ---------------------------------------------------------------


@query("select event_id, lpad(event_id::varchar, 32, '0') as uuid, 16 as n_bytes, lpad(event_id::varchar, 32, '0') as back from events")
def uuid_forms(spark, sf_dir):
    """Identifiers as text, as 16 bytes, written with dashes, and back."""
    e = graph.table(spark, sf_dir, "events").select("event_id", ids.uuid_of(F.col("event_id")).alias("uuid"))
    dashed = F.concat_ws("-", *[F.substring("uuid", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return e.select("event_id", "uuid", F.length(ids.to_bytes(F.col("uuid"))).alias("n_bytes"), ids.from_bytes(ids.to_bytes(dashed)).alias("back"))


@query(GRAPH + """select uuid, kind, 2 + (turn % 4 = 1)::int as n_parts, (select count(*) from e where e.src_id = m.rowid) as n_targets, true as valid from m where kind = 'self'""")
def self_builders(spark, sf_dir):
    """Answers built as memories of their own kind: a thought, the text, and for every other one a tool call."""
    m, e = _graph(spark, sf_dir)
    p, text = schema.part, F.col("parts")[0]["content"]
    said = F.array(p("think", content=F.lit("hm")), p("text", content=text))
    call = F.array(p("tool", name=F.lit("look"), call_id=F.col("uuid"), args=F.lit("{}"), result=F.lit("1")))
    parts = F.when(F.col("turn") % 4 == 1, F.concat(said, call)).otherwise(said)
    rows = lookup.with_edges(m.where("kind = 'self'"), e, m)
    built = rows.select(*schema.create_self(F.col("uuid"), parts, F.col("edges")))
    return built.select(
        "uuid", "kind", F.size("parts").alias("n_parts"), F.size("targets").cast("bigint").alias("n_targets"), schema.valid(F.col("kind"), F.col("parts")).alias("valid")
    )


def _written(spark: SparkSession, sf_dir: str) -> Appender:
    """A store made by transactions: the first turns, a cancelled batch, then everything again in two batches."""
    m, e = _graph(spark, sf_dir)
    rows = lookup.with_edges(m, e)
    batch = rows.select("uuid", "kind", "metadata", "parts", F.col("edges").alias("targets"), F.col("rowid").alias("arrival"), "turn")
    store = Appender(spark, scratch(spark, "store"))
    with store.transaction() as t:
        t.add(batch.where("turn < 2"))
    with store.transaction() as t:
        t.add(batch.where("turn < 4"))
        raise CancelTransaction
    with store.transaction() as t:
        t.add(batch.where("turn < 3"))
        t.add(batch)
    return store


_STORED = GRAPH + ", r as (select rowid, uuid, kind, row_number() over (order by case when turn < 2 then 0 when turn < 3 then 1 else 2 end, rowid) as n from m), k as (select s.n as src_id, d.n as dst_id from e join r s on s.rowid = e.src_id join r d on d.rowid = e.dst_id where d.n <= s.n)\n"


@query(_STORED + "select n as rowid, uuid, kind from r")
def store_memories(spark, sf_dir):
    return _written(spark, sf_dir).memories().select("rowid", "uuid", "kind")


@query(_STORED + ", f as (select min(uuid) as a, max(uuid) as b, max(n) as c from r) select n as rowid, uuid, kind from r, f where uuid in (a, b) or n in (1, c)")
def store_lookup(spark, sf_dir):
    """Memories by uuid and by row number, read from those versions alone whose index may hold them."""
    store = _written(spark, sf_dir)
    ends = store.memories().agg(F.min("uuid"), F.max("uuid"), F.max("rowid")).head()
    return store.find(ends[:2], [1, ends[2]]).select("rowid", "uuid", "kind")


@query(_STORED + "select r.n as rowid, count(k.src_id) as refs from r left join k on k.dst_id = r.n group by r.n")
def store_indegrees(spark, sf_dir):
    """References counted as versions were written; those to memories that came later were dropped."""
    return _written(spark, sf_dir).indegrees()


@query("""with t as (select *, sum((event_type = 'signup')::int) over (partition by user_id order by ts, event_id) as epoch from events)
select user_id as key, epoch::bigint as epoch, min(event_id) as seq from (select *, row_number() over (partition by user_id, epoch order by ts, event_id) as n from t where event_type = 'click') where n = 1 group by 1, 2""")
def action_once(spark, sf_dir):
    """An action as a table function over each user's events: the first click after every sign-up."""
    e = graph.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    calls = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (kind == "signup").alias("reset"), (kind == "click").alias("fire"), "ts")
    return actions.once(calls.asTable().partitionBy("key").orderBy("ts", "seq"))
