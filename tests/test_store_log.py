"""The store's log as a stream, counts of references by version, actions as table functions."""

import pytest
from pyspark.sql import functions as F

from causeway.functions import actions
from causeway.operators import lookup
from causeway.sources.schema import part
from causeway.sources.store import Appender
from causeway.streaming.append import follow


@pytest.fixture
def add(spark):
    def write(store, rows):
        df = spark.createDataFrame(rows, "uuid string, targets array<string>, arrival bigint")
        df = df.withColumn("kind", F.lit("other")).withColumn("metadata", F.lit("{}")).withColumn("parts", F.array(part("text", content=F.lit("x"))))
        with store.transaction() as t:
            t.add(df)

    return write


def test_readers_see_each_commit_once(spark, tmp_path, add):
    store = Appender(spark, f"file://{tmp_path}/store")
    seen = []

    def each(memories, edges, epoch):
        seen.append((sorted(r.uuid for r in memories.collect()), edges.count()))

    def read():
        assert follow(store, each, f"file://{tmp_path}/cp").awaitTermination(60)

    add(store, [("a", [], 1), ("b", ["a"], 2)])
    read()
    read()
    add(store, [("b", [], 1), ("c", ["b", "a"], 2)])
    add(Appender(spark, store.path), [("d", ["c"], 1)])  # another writer
    read()
    assert seen == [(["a", "b"], 1), (["c", "d"], 3)]


def test_point_lookups_open_one_version(spark, tmp_path, add):
    store = Appender(spark, f"file://{tmp_path}/store")
    assert store.find(["a"], [1]).collect() == [] and store.holding(["a"]) == []
    # every version has uuids from all over the range, so only the filters tell them apart
    for i in range(6):
        add(store, [(f"{j:03}-{i}", [], j) for j in range(20)])
    add(store, [("000-0", [], 1)])  # a version without a new memory
    assert len(store.versions()) == 7
    hit = store.find(["007-3"])
    assert [(r.uuid, r.rowid) for r in hit.collect()] == [("007-3", 68)]
    assert len({f.split("/memories/")[0] for f in hit.inputFiles()}) == 1
    by_row = store.find(rowids=[41])
    assert [r.uuid for r in by_row.collect()] == ["000-2"] and len({f.split("/memories/")[0] for f in by_row.inputFiles()}) == 1
    every = [r.uuid for r in store.memories().collect()]
    assert sorted(r.uuid for r in store.find(every).collect()) == sorted(every) and len(every) == 120
    assert sorted(r.uuid for r in store.find(["000-0", "nowhere"], [120, 999]).collect()) == ["000-0", "019-5"]
    assert store.find(["nowhere"]).collect() == []


def test_large_versions_are_found_by_range(spark, tmp_path, add, monkeypatch):
    from causeway.sources import store as module

    monkeypatch.setattr(module, "MAX_BITS", 64)
    store = Appender(spark, f"file://{tmp_path}/store")
    for i in range(3):
        add(store, [(f"{i}-{j:03}", [], j) for j in range(20)])
    assert all(k.bloom is None for r in store.log().collect() for k in r["keys"])
    assert store.holding(["1-004"]) == store.versions()[1:2] and store.find(["1-004"]).count() == 1


def test_a_thousand_commits_open_from_one_snapshot(spark, tmp_path):
    store = Appender(spark, f"file://{tmp_path}/store")
    for n in range(1003):
        assert store.publish(n, [f"v-{n}", f"w-{n}"])
    assert not store.publish(7, ["other"])
    assert store.commits() == [[f"v-{n}", f"w-{n}"] for n in range(1003)]
    files = store.log().inputFiles()
    assert sum("/snapshots/000000001000/" in f for f in files) == 1 and sum("/published/" in f for f in files) == 3 and len(files) == 4
    # a snapshot that a writer left half done is not read
    (tmp_path / "store/snapshots/_left").mkdir()
    assert len(Appender(spark, store.path).commits()) == 1003 and store.holding(["a"]) == store.versions()


def test_indegrees_after_appends(spark, tmp_path, add):
    store = Appender(spark, f"file://{tmp_path}/store")
    assert store.indegrees().count() == 0
    names = []
    for i in range(5):
        add(store, [(f"n{i}", names[-2:], 1), (f"x{i}", names[:1], 2), (f"n{i}", ["x0"], 3)])
        names.append(f"n{i}")
    want = sorted(map(tuple, lookup.indegrees(store.memories(), store.edges()).collect()))
    assert sorted(map(tuple, store.indegrees().collect())) == want and len(want) == 10
    files = store.indegrees().inputFiles()
    assert any("/degrees/" in f for f in files) and not any("/edges/" in f for f in files)


def test_once_as_a_table_function(spark):
    rows = [(1, 1, False, True), (1, 2, False, True), (1, 3, True, False), (1, 4, False, True), (2, 5, False, False), (2, 6, True, True), (None, 7, False, True)]
    t = spark.createDataFrame(rows, "key bigint, seq bigint, reset boolean, fire boolean").repartition(3)
    got = actions.once(t.asTable().partitionBy("key").orderBy("seq")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 1), (1, 1, 4), (2, 1, 6), (None, 0, 7)], key=str)
    assert actions.once(t.limit(0).asTable().partitionBy("key").orderBy("seq")).collect() == []
