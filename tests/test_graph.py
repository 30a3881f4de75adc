"""Golden vectors on a fixed graph, and random graphs against imperative restatements."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from causeway.operators import append, dag, lookup
from causeway.operators.recall import forest_edges, induced_edges, recall
from causeway.sources.schema import RecallConfig, part
from causeway.sources.shared import number_rows

G10 = [(2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (6, 4), (7, 5), (7, 6), (8, 7), (9, 3), (10, 8), (10, 9)]


def frames(spark, n, edges):
    nodes = spark.createDataFrame([(i, f"{i:032d}") for i in n], "rowid bigint, uuid string")
    return nodes, spark.createDataFrame(list(edges), "src_id bigint, dst_id bigint")


@pytest.fixture(scope="module")
def g10(spark):
    m, e = frames(spark, range(1, 11), G10)
    return m.cache(), e.cache()


CASES = [
    ([4], (1, 1, 100), range(1, 8), "21 42 43 54 64 75"),
    ([4], (2, 3, 10), range(1, 9), "21 42 43 54 64 75 87"),
    ([4], (0, 0, 100), [*range(1, 9), 10], "21 42 43 54 64 75 87 10-8"),
    ([4], (-1, 0, 100), range(1, 5), "21 42 43"),
    ([4], (5, 5, 5), range(2, 7), "42 43 54 64"),
    ([4], (5, 5, 6), range(2, 8), "42 43 54 64 75"),
    ([4], (5, 5, 8), range(1, 9), "21 42 43 54 64 75 87"),
    ([10], (5, 5, 5), [3, *range(7, 11)], "87 93 10-8 10-9"),
    ([4, 7], (5, 5, 4), range(4, 8), "54 64"),
    ([4, 99], (5, 5, 5), range(2, 7), "42 43 54 64"),
    ([2, 4, 7], (5, 5, 2), [2, 4, 7], ""),
]


def pairs(text):
    return sorted(tuple(map(int, p.split("-"))) if "-" in p else (int(p[0]), int(p[1])) for p in text.split())


@pytest.mark.parametrize("roots,config,nodes,links", CASES)
def test_golden_recall(spark, g10, roots, config, nodes, links):
    r = spark.createDataFrame([(0, i) for i in roots], "graph_id bigint, node_id bigint")
    got = recall(*g10, r, RecallConfig(*config))
    assert sorted(x.node_id for x in got.collect()) == list(nodes)
    assert sorted((x.src_id, x.dst_id) for x in forest_edges(got).collect()) == pairs(links)


def test_no_roots(spark, g10):
    r = spark.createDataFrame([], "graph_id bigint, node_id bigint")
    assert recall(*g10, r).count() == 0


def test_induced_edges(spark, g10):
    r = spark.createDataFrame([(0, 4)], "graph_id bigint, node_id bigint")
    got = recall(*g10, r, RecallConfig(-1, 0, 100))
    assert sorted((x.src_id, x.dst_id) for x in induced_edges(got, g10[1]).collect()) == [(2, 1), (3, 1), (4, 2), (4, 3)]


def walk(nodes, edges, roots, refs, deps, budget):
    """The traversal written as a plain loop over one graph."""
    out, back = {i: set() for i in nodes}, {i: set() for i in nodes}
    for s, d in edges:
        out[s].add(d)
        back[d].add(s)
    found = [r for r in sorted(roots) if r in out]
    seen, got = set(roots), {r: None for r in found}
    rc, front = {}, {0: {}, 1: {}}

    def offer(nxt, d, child, parent):
        rc[child] = rc.get(child, 0) + 1
        if child not in seen:
            seen.add(child)
            nxt[d][child] = parent

    for r in found:
        for c in sorted(back[r]):
            offer(front, 0, c, r)
        for c in sorted(out[r]):
            offer(front, 1, c, r)
    limit = {0: RecallConfig.reach(refs), 1: RecallConfig.reach(deps)}
    level = 1
    front = {d: f if level <= limit[d] else {} for d, f in front.items()}
    while (front[0] or front[1]) and len(seen) < budget:
        rc.clear()
        nxt = {0: {}, 1: {}}
        for d, near in ((0, back), (1, out)):
            for node, parent in front[d].items():
                got[node] = parent
                for c in sorted(near[node]):
                    offer(nxt, d, c, node)
        level += 1
        front = {d: f if level <= limit[d] else {} for d, f in nxt.items()}
    rest = [(n, p) for d in (0, 1) for n, p in front[d].items()]
    rest.sort(key=lambda x: -rc[x[0]])
    for n, p in rest[: max(0, budget - len(got))]:
        got[n] = p
    return got


def test_random_recalls(spark):
    """Many graphs at once: each is a block of ids of its own."""
    rng = random.Random(3)
    for refs, deps, budget in ((2, 3, 8), (0, 1, 12), (1, 0, 5), (-1, 2, 6)):
        nodes, edges, roots, want = [], [], [], {}
        for g in range(30):
            n = rng.randint(1, 14)
            ids = [g * 100 + i for i in range(n)]
            es = {(rng.choice(ids), rng.choice(ids)) for _ in range(rng.randint(0, 2 * n))}
            rs = {rng.choice(ids) for _ in range(rng.randint(1, 3))} | ({g * 100 + 99} if rng.random() < 0.2 else set())
            nodes += ids
            edges += es
            roots += [(g, r) for r in rs]
            want[g] = walk(ids, es, rs, refs, deps, budget)
        m, e = frames(spark, nodes, edges)
        got = recall(m, e, spark.createDataFrame(roots, "graph_id bigint, node_id bigint"), RecallConfig(refs, deps, budget)).collect()
        found = {}
        for r in got:
            found.setdefault(r.graph_id, {})[r.node_id] = r.parent_id
        assert found == {g: w for g, w in want.items() if w}


def test_golden_toposort(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(1, 11)], "graph_id bigint, id bigint")
    edges = spark.createDataFrame([(1, *x) for x in G10], "graph_id bigint, src_id bigint, dst_id bigint")
    order = [r.id for r in dag.toposort(nodes, edges).orderBy("pos").collect()]
    assert order == [10, 8, 7, 5, 6, 4, 2, 9, 3, 1]
    flat = dag.layers(nodes, edges.drop("graph_id")).orderBy("layer", "id").collect()
    assert [r.id for r in flat] == [10, 8, 9, 7, 5, 6, 4, 2, 3, 1]


def test_toposort_rules():
    # a cycle and what it leads to are left out; an edge to an absent node does not count
    assert dag.toposort_one([1, 2, 3, 4], [None] * 4, [(1, 2), (2, 1), (2, 3), (4, 9)]) == [4]
    assert dag.toposort_one([1, 2, 3], ["b", None, "a"], []) == [2, 3, 1]
    assert dag.toposort_one([1, 2, 3], ["b", "c", "a"], [], reverse=True) == [2, 1, 3]


def test_random_toposorts_are_linear_extensions():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 12)
        es = [(b, a) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.3]
        order = dag.toposort_one(list(range(n)), [rng.choice("abc") for _ in range(n)], es)
        at = {x: i for i, x in enumerate(order)}
        assert len(order) == n and all(at[s] < at[d] for s, d in es)


def test_indegree_golden(spark, g10):
    got = lookup.memories_with_indegree_at_most(*g10, 1).collect()
    assert [r.rowid for r in got] == [10, 9, 8, 7, 6, 5, 2]
    assert lookup.memories_with_indegree_at_most(*g10, None).count() == 0


def test_point_lookup_needs_a_key(spark, g10):
    assert lookup.select_memory(g10[0]).count() == 0
    assert lookup.select_memory(g10[0], uuid=f"{3:032d}").head().rowid == 3
    assert lookup.select_memories(g10[0], []).count() == 0
    assert lookup.page(g10[0], 1, -1).count() == 10
    assert lookup.has_uuid(g10[0], f"{3:032d}") and not lookup.has_uuid(g10[0], "3")


def test_reachable(spark):
    rng = random.Random(1)
    es = {(b, a) for a in range(15) for b in range(a + 1, 15) if rng.random() < 0.15} | {(3, 3)}
    got = {(r.src_id, r.dst_id) for r in dag.reachable(spark.createDataFrame(sorted(es), "src_id bigint, dst_id bigint")).collect()}
    want = set()
    for s in range(15):
        todo = deque([s])
        while todo:
            x = todo.popleft()
            for a, b in es:
                if a == x != b and (s, b) not in want:
                    want.add((s, b))
                    todo.append(b)
    assert got == want


def batch(spark, rows):
    df = spark.createDataFrame(rows, "uuid string, targets array<string>, arrival bigint")
    return df.withColumn("kind", F.lit("other")).withColumn("metadata", F.lit("{}")).withColumn("parts", F.array(part("text", content=F.lit("x"))))


def test_append_equals_row_by_row(spark):
    rng = random.Random(7)
    names = [f"u{i:02d}" for i in range(12)]
    store = {f"s{i}": i + 1 for i in range(3)}
    rows = [(rng.choice(names), rng.sample(names + list(store) + ["nowhere"], 3), i) for i in range(30)]
    ids, links = dict(store), set()
    for u, ts, _ in rows:
        if u not in ids:
            ids[u] = len(ids) + 1
            links |= {(ids[u], ids[t]) for t in ts if t in ids}
    held = spark.createDataFrame([(v, k) for k, v in store.items()], "rowid bigint, uuid string")
    got = append.append(held, batch(spark, rows))
    assert {r.uuid: r.rowid for r in got.memories.collect()} == {u: i for u, i in ids.items() if u not in store}
    assert {(r.src_id, r.dst_id) for r in got.edges.collect()} == links
    again = append.append(held.unionByName(got.memories.select("rowid", "uuid")), batch(spark, rows))
    assert again.memories.count() == 0 and again.edges.count() == 0


def test_invalid_memories_are_set_aside(spark):
    good = batch(spark, [("a", [], 1)])
    bad = batch(spark, [("b", [], 2)]).withColumn("parts", F.array(part("tool", name=F.lit("f"), call_id=F.lit("c"))))
    got = append.append(spark.createDataFrame([], "rowid bigint, uuid string"), good.unionByName(bad))
    assert [r.uuid for r in got.memories.collect()] == ["a"] and [r.uuid for r in got.quarantine.collect()] == ["b"]


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r.n == r.x + 1 for r in number_rows(df, ["x"]).collect())
    assert number_rows(df.limit(0), ["x"]).count() == 0


def test_store_publishes_whole_versions(spark, tmp_path):
    from causeway.sources.store import Appender, CancelTransaction

    store = Appender(spark, f"file://{tmp_path}/store")
    assert store.memories().count() == 0
    with store.transaction() as t:
        t.add(batch(spark, [("a", [], 1), ("b", ["a"], 2)]))
    with store.transaction() as t:
        t.add(batch(spark, [("c", ["b", "d"], 1)]))
        raise CancelTransaction
    with pytest.raises(ValueError), store.transaction() as t:
        t.add(batch(spark, [("c", [], 1)]))
        raise ValueError
    with store.transaction() as t:
        t.add(batch(spark, [("b", [], 1), ("e", ["a", "e"], 2)]))
    assert [(r.rowid, r.uuid) for r in store.memories().orderBy("rowid").collect()] == [(1, "a"), (2, "b"), (3, "e")]
    assert sorted((r.src_id, r.dst_id) for r in store.edges().collect()) == [(2, 1), (3, 1), (3, 3)]


def test_store_several_batches_or_none(spark, tmp_path):
    from pyspark.sql import functions as F

    from causeway.sources.store import Appender

    store = Appender(spark, f"file://{tmp_path}/store")
    good = batch(spark, [("a", [], 1)])
    with pytest.raises(Exception), store.transaction() as t:
        t.add(good)
        t.add(batch(spark, [("b", ["a"], 1)]).withColumn("kind", F.raise_error(F.lit("broken")).cast("string")))
    assert store.memories().count() == 0 and store.commits() == [] and not list((tmp_path / "store").glob("v-*"))
    with store.transaction() as t:
        t.add(good)
        t.add(batch(spark, [("b", ["a"], 1)]))
    assert [(r.rowid, r.uuid) for r in store.memories().orderBy("rowid").collect()] == [(1, "a"), (2, "b")] and len(store.commits()) == 1


def test_store_two_writers(spark, tmp_path, monkeypatch):
    """A writer that finds its number taken appends anew: no row number repeats, nothing is lost."""
    from causeway.sources.store import Appender

    one, two = (Appender(spark, f"file://{tmp_path}/store") for _ in range(2))
    publish = Appender.publish
    tries = []

    def slow(self, n, versions):
        tries.append(n)
        if len(tries) == 1:  # the other writer comes in between
            with two.transaction() as t:
                t.add(batch(spark, [("b", [], 1), ("c", ["b"], 2)]))
        return publish(self, n, versions)

    monkeypatch.setattr(Appender, "publish", slow)
    with one.transaction() as t:
        t.add(batch(spark, [("a", [], 1), ("b", [], 2)]))
    assert tries == [0, 0, 1]
    assert [(r.rowid, r.uuid) for r in one.memories().orderBy("rowid").collect()] == [(1, "b"), (2, "c"), (3, "a")]
    assert len(one.commits()) == 2
