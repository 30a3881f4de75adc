"""Depths, orders and reachability of graphs that no task holds whole."""

import logging
import random

import pytest
from pyspark.sql import functions as F

from causeway.operators import dag, reach
from causeway.sources.shared import cut, running_sums, scratch_tables


def graph(spark, n, es):
    return spark.createDataFrame([(i,) for i in n], "id bigint"), spark.createDataFrame(sorted(es), "src_id bigint, dst_id bigint")


def longest(n, es):
    """Longest paths to each node by taking nodes off in turn; those on or behind cycles stay."""
    es = {(a, b) for a, b in es if a != b and a in n and b in n}
    left, out, level = set(n), {}, 0
    while top := {i for i in left if not any(b == i and a in left for a, b in es)}:
        out |= dict.fromkeys(top, level)
        left, level = left - top, level + 1
    return out


def closure(es):
    out = {}
    for a, b in es:
        out.setdefault(a, set()).add(b)
    got = set()
    for s in out:
        todo, seen = list(out[s]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        got |= {(s, x) for x in seen}
    return got


def test_running_sums(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"), (F.col("id") % 7).alias("v"))
    rows = sorted(running_sums(df, ["x"], F.col("v")).collect())
    total = 0
    for r in rows:
        assert r.before == total
        total += r.v
    assert running_sums(df.limit(0), ["x"], F.col("v")).count() == 0


def test_scratch_tables_go(spark, tmp_path):
    import os

    with scratch_tables(spark) as held:
        cut(spark.range(3), "gone")
        assert os.path.exists(held[0].removeprefix("file://"))
    assert not os.path.exists(held[0].removeprefix("file://"))


def test_chain_in_few_rounds(spark, caplog):
    n = 100_000
    nodes = spark.range(n)
    edges = spark.range(1, n).select(F.col("id").alias("src_id"), (F.col("id") - 1).alias("dst_id"))
    with caplog.at_level(logging.DEBUG, logger=dag.log.name):
        got = dag.layers(nodes, edges)
        assert got.where(F.col("layer") != n - 1 - F.col("id")).isEmpty() and got.count() == n
    assert sum(int(m.split()[0]) for m in caplog.messages) < 20


@pytest.mark.parametrize("seed,cycles", [(0, False), (1, False), (2, True), (3, True)])
def test_layers_of_random_graphs(spark, seed, cycles):
    rng = random.Random(seed)
    n = list(range(40))
    es = {(b, a) for a in n for b in n if (a < b or cycles and rng.random() < 0.02) and rng.random() < 0.08} | {(7, 7), (99, 3), (3, 99)}
    nodes, edges = graph(spark, n, es)
    assert {r.id: r.layer for r in dag.layers(nodes, edges).collect()} == longest(set(n), es)


def test_order_is_topological(spark):
    rng = random.Random(5)
    n = list(range(60))
    es = {(b, a) for a in n for b in range(a + 1, 60) if rng.random() < 0.05}
    nodes, edges = graph(spark, n, es)
    nodes = nodes.withColumn("k", F.when(F.col("id") % 3 > 0, -F.col("id")))
    at = {r.id: r.pos for r in dag.order(nodes, edges, "k").collect()}
    assert sorted(at.values()) == list(range(1, 61)) and all(at[a] < at[b] for a, b in es)
    depth = longest(set(n), es)
    assert sorted(n, key=at.get) == sorted(n, key=lambda i: (depth[i], i % 3 > 0, -i if i % 3 else 0, i))
    back = {r.id: r.pos for r in dag.order(nodes, edges, "k", "dependencies").collect()}
    assert all(back[i] == 61 - at[i] for i in n)
    assert dag.order(nodes.limit(0), edges).count() == 0


@pytest.mark.parametrize("seed,density", [(0, 0.03), (1, 0.1), (2, 0.3)])
def test_labels_equal_the_closure(spark, seed, density):
    rng = random.Random(seed)
    n = list(range(30))
    es = {(b, a) for a in n for b in range(a + 1, 30) if rng.random() < density} | {(4, 4), (5, 99)}
    nodes, edges = graph(spark, n, es)
    labels = reach.label(nodes, edges)
    want = closure({(a, b) for a, b in es if a != b and b < 30})
    asked = spark.createDataFrame([(a, b) for a in range(31) for b in range(31)], "src_id bigint, dst_id bigint")
    got = {(r.src_id, r.dst_id) for r in reach.is_ancestor(labels, asked).where("reaches").collect()}
    assert got == want and reach.is_ancestor(labels, asked).count() == 31 * 31
    assert labels.nodes.count() == 30 and labels.exceptions.count() <= len(es) and labels.in_order


def test_labels_where_ids_follow_no_order(spark):
    rng = random.Random(9)
    names = rng.sample(range(-50, 50), 25)
    es = {(names[b], names[a]) for a in range(25) for b in range(a + 1, 25) if rng.random() < 0.12}
    nodes, edges = graph(spark, names, es)
    labels = reach.label(nodes, edges) if not_a_cycle(names, es) else None
    asked = nodes.select(F.col("id").alias("src_id")).crossJoin(nodes.select(F.col("id").alias("dst_id")))
    assert not labels.in_order
    assert {(r.src_id, r.dst_id) for r in reach.is_ancestor(labels, asked).where("reaches").collect()} == closure(es)


def not_a_cycle(names, es):
    return len(longest(set(names), es)) == len(names)


def test_a_star_and_a_tree_need_no_exceptions(spark):
    star = {(i, 0) for i in range(1, 50)} | {(i, i // 2) for i in range(50, 90)}
    nodes, edges = graph(spark, range(90), star)
    labels = reach.label(nodes, edges)
    assert labels.exceptions.count() == 0
    rows = {r.id: r for r in labels.nodes.collect()}
    assert (rows[0].first, rows[0].last) == (0, 89) and sorted(r.first for r in rows.values()) == list(range(90))


def test_a_cycle_has_no_labels(spark):
    with pytest.raises(ValueError, match="cycle"):
        reach.label(*graph(spark, range(3), {(0, 1), (1, 2), (2, 0)}))


@pytest.mark.parametrize("seed,cycles", [(0, False), (1, False), (2, True), (3, True)])
def test_layers_over_blocks(spark, seed, cycles):
    """Paths that cross blocks of few nodes many times, with and without cycles."""
    rng = random.Random(seed)
    n = rng.sample(range(1000), 40)
    es = [(a, b) for a, b in (rng.sample(n, 2) for _ in range(70)) if cycles or n.index(a) < n.index(b)]
    nodes, edges = graph(spark, n, es)
    assert {r.id: r.layer for r in dag.layers(nodes, edges, block=7).collect()} == longest(set(n), es)


def test_layers_of_a_chain_between_conversations(spark, monkeypatch):
    """Conversations that refer to earlier ones, in one path through all: a block each turn at most, mostly all at once.
    Doubling over single nodes took a turn for every few conversations."""
    climbs, climb = [], dag.climb
    monkeypatch.setattr(dag, "climb", lambda *a, **b: climbs.append(1) or climb(*a, **b))
    es = [(c * 10 + t, c * 10 + t - 1) for c in range(60) for t in range(1, 5)] + [(c * 10 + t, (c - back) * 10 + to) for c in range(5, 60) for t, back, to in ((0, 1, 4), (1, 5, 0)) if t or c % 3]
    n = {x for e in es for x in e}
    nodes, edges = graph(spark, sorted(n), es)
    assert {r.id: r.layer for r in dag.layers(nodes, edges, block=75).collect()} == longest(n, es)
    assert len(climbs) <= 5
