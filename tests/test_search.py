"""Full-text search against a plain loop, and edges laid out for traversal."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from causeway.operators import score, search
from causeway.operators.recall import recall
from causeway.sources.adjacency import Adjacency
from causeway.sources.schema import RecallConfig


def test_bm25_against_a_loop(spark):
    rng = random.Random(1)
    words = [f"w{int(rng.expovariate(0.15))}" for _ in range(900)] + ["Über", "naïve", "x1"] * 20
    rng.shuffle(words)
    docs = [(i, " ".join(words[at : at + rng.randrange(12)])) for i, at in enumerate(range(0, 900, 12))] + [(900, None), (901, ""), (902, "über, ÜBER -- w0!")]
    queries = [(0, "w0 w1 W1 über"), (5, "nothing here"), (6, None), (7, docs[7][1])]
    said = {i: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in docs}
    n, mean = len(docs), sum(sum(c.values()) for c in said.values()) / len(docs)
    df = Counter(t for c in said.values() for t in c)
    want = []
    for q, text in queries:
        got = []
        for i, c in said.items():
            terms = [t for t in re.findall(r"[^\W_]+", (text or "").lower()) if t in c]
            if terms:
                s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in terms)
                got.append((-round(s, 6), i))
        want += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(got)[:8], 1)]
    held = search.index(spark.createDataFrame(docs, "id bigint, text string"))
    asked = spark.createDataFrame(queries, "query_id bigint, text string")
    assert sorted((r.query_id, r.id, r.score, r.rank) for r in search.bm25(held, asked, 8).collect()) == sorted(want)
    assert search.bm25(held, asked, own=False).where("id = query_id").count() == 0
    none = search.index(spark.createDataFrame([], "id bigint, text string"))
    assert search.bm25(none, asked, 3).count() == 0 and none.documents == 0


def test_a_search_reads_the_groups_of_its_terms(spark):
    held = search.index(spark.range(2000).select("id", F.concat(F.lit("t"), F.col("id") % 500).alias("text")))
    plan = held.postings.where("term = 't77'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,t77)]" in plan


def test_likeness_to_sonas(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (3, [2.0, 2.0], "b"), (4, [0.0, 0.0], "c"), (5, [1.0, 1.0], None)], "vec_id bigint, embedding array<float>, label string")
    got = {r.vec_id: round(r.likeness, 6) for r in score.sona_likeness(v).collect()}
    assert got == {1: 0.707107, 2: 0.707107, 3: 1.0, 4: 0.0, 5: 0.0}


def scans_behind_an_exchange(plan):
    """Names of the tables below any exchange of a printed plan."""
    out, depth = set(), []
    for line in plan.splitlines():
        at = len(line) - len(line.lstrip(" :+-|*"))
        depth = [d for d in depth if d < at]
        if "Exchange" in line:
            depth.append(at)
        elif "FileScan" in line and depth:
            out.add(line)
    return out


def test_edges_stay_where_they_are(spark):
    """With buckets no edge is shuffled, and recalls are the same."""
    rng = random.Random(8)
    es = sorted({(b, a) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.06})
    nodes, edges = spark.range(60).select(F.col("id").alias("rowid")), spark.createDataFrame(es, "src_id bigint, dst_id bigint")
    held = Adjacency(edges)
    roots = spark.createDataFrame([(0, 50), (0, 3), (1, 20)], "graph_id bigint, node_id bigint")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        front = roots.withColumnRenamed("node_id", "parent")
        for column, far in (("src_id", "dst_id"), ("dst_id", "src_id")):
            joined = front.join(held.near(column).select(F.col(column).alias("parent"), F.col(far).alias("child")), "parent")
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and not any("adjacency" in s for s in scans_behind_an_exchange(plan)), plan
    finally:
        spark.conf.set(key, before)
    config = RecallConfig(2, 3, 9)
    want = sorted(map(tuple, recall(nodes, edges, roots, config).collect()))
    assert sorted(map(tuple, recall(nodes, held, roots, config).collect())) == want and len(want) > 9
    assert sorted((r.src_id, r.dst_id) for r in held.edges.collect()) == es
    held.drop()
    assert not [t for t in spark.catalog.listTables() if t.name in held.tables.values()]


def test_no_join_where_roots_use_up_the_budget(spark):
    nodes = spark.range(20).select(F.col("id").alias("rowid"))
    broken = spark.range(1).select(F.raise_error(F.lit("read")).cast("bigint").alias("src_id"), F.lit(1).cast("bigint").alias("dst_id"))
    roots = spark.range(5).select(F.lit(0).cast("bigint").alias("graph_id"), F.col("id").alias("node_id"))
    assert recall(nodes, broken, roots, RecallConfig(2, 2, 5)).count() == 5


def test_best_of_many_queries_over_blocks(spark, monkeypatch):
    """The best of each query, copies that tie included, without a shuffle of pairs of query and document."""
    monkeypatch.setattr(search, "BLOCK", 16)
    rng = random.Random(4)
    docs = [(i, " ".join(f"w{int(rng.expovariate(0.3))}" for _ in range(rng.randrange(9)))) for i in range(80)] + [(i, "w0 w1 w2") for i in range(80, 120)]
    held = search.index(spark.createDataFrame(docs, "id bigint, text string"))
    asked = spark.createDataFrame(docs[::7], "query_id bigint, text string")
    every = {}
    for r in search.bm25(held, asked, own=False).collect():
        every.setdefault(r.query_id, []).append((-r.score, r.id))
    want = sorted((q, i, -s, n) for q, found in every.items() for n, (s, i) in enumerate(sorted(found)[:5], 1))
    best = search.bm25(held, asked, 5, own=False)
    assert sorted((r.query_id, r.id, r.score, r.rank) for r in best.collect()) == want and len(want) > 50
    assert "Aggregate(keys=[query_id" not in best._jdf.queryExecution().executedPlan().toString().replace("HashAggregate", "Aggregate")


def test_small_graphs_are_numbered_without_ranges(spark, monkeypatch):
    """Graphs of a chat's size need no ranges, which sampled and wrote every level once more; wide ones still have them."""
    from causeway.operators import recall as module

    rng = random.Random(3)
    es = [(b, a) for a in range(50) for b in range(a + 1, 50) if rng.random() < 0.06]
    nodes, edges = spark.range(50).select(F.col("id").alias("rowid")), spark.createDataFrame(es, "src_id bigint, dst_id bigint")
    roots = spark.createDataFrame([(0, 45), (0, 3), (1, 20)], "graph_id bigint, node_id bigint")
    ranges, number_rows = [], module.number_rows
    monkeypatch.setattr(module, "number_rows", lambda *a: ranges.append(1) or number_rows(*a))
    got = sorted(map(tuple, recall(nodes, edges, roots, RecallConfig(2, 3, 12)).collect()))
    assert not ranges and len(got) > 12
    monkeypatch.setattr(module, "WIDE", 0)
    assert sorted(map(tuple, recall(nodes, edges, roots, RecallConfig(2, 3, 12)).collect())) == got and ranges
