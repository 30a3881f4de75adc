"""Responses that find their request, those that don't, and a sink that keeps each epoch once."""

import datetime as dt

import pytest

from causeway.streaming import respond
from causeway.streaming.sources import table_stream

T = dt.datetime(2024, 1, 1)


def at(seconds):
    return T + dt.timedelta(seconds=seconds)


@pytest.fixture
def run(spark, tmp_path):
    respond.register(spark)

    def go(reqs, resps, name="out"):
        for kind, parts, schema in (("req", reqs, "request string, req_ts timestamp"), ("resp", resps, "request string, resp_ts timestamp, status int, body string")):
            for p in parts:
                spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{kind}")
        out = respond.settle(table_stream(spark, f"{tmp_path}/req", 1), table_stream(spark, f"{tmp_path}/resp", 1))
        q = out.writeStream.format("respond").option("path", f"file://{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return f"file://{tmp_path}/{name}"

    return go


def test_settle(spark, run):
    # the last rows of both streams only move the watermark
    reqs = [[("a", at(0)), ("b", at(0)), ("c", at(1)), ("d", at(5)), (None, at(1))], [("z", at(100_000))]]
    resps = [[("a", at(30), 200, "ok"), ("a", at(31), 201, "after"), ("c", at(2), 200, "first"), ("c", at(3), 200, "again"), ("b", at(40), 200, "slow"),
              ("x", at(1), 200, "?"), ("d", at(4), 200, "early"), ("d", at(6), None, None)], [("z", at(100_001), 200, "")], [("y", at(200_000), 200, "")]]
    path = run(reqs, resps)
    got = {(r.request, r.status, r.body) for r in respond.answers(spark, path).collect() if r.request not in "yz"}
    assert got == {("a", 200, "ok"), ("b", 504, respond.NO_ANSWER), ("c", 200, "first"), ("d", None, None)}
    dead = {(r.request, r.body, r.why) for r in respond.dead_letters(spark, path).collect() if r.request not in "yz"}
    assert dead == {("a", "after", "late"), ("b", "slow", "late"), ("c", "again", "repeated"), ("x", "?", "unknown"), ("d", "early", "unknown")}


def test_a_restarted_stream_goes_on(spark, run):
    path = run([[("a", at(0))]], [[("b", at(0), 200, "?")]])
    run([[("e", at(90_000))], [("f", at(90_001))]], [[("g", at(90_000), 200, "")], [("h", at(90_001), 200, "")]])
    rows = respond.written(spark, path).collect()
    assert sorted((r.request, r.status) for r in rows if r.request in "ab") == [("a", 504), ("b", 200)]


def test_an_epoch_counts_once(spark, tmp_path):
    schema = spark.createDataFrame([], respond.SETTLED).schema
    writer = respond._Writer({"path": f"file://{tmp_path}/out"}, schema)
    assert respond.written(spark, f"file://{tmp_path}/out").collect() == []
    rows = [("a", 1, 200, "é\n", None), ("b", 2, None, None, "late")]
    writer.commit([writer.write(iter(rows)), writer.write(iter([])), None], 0)
    writer.commit([writer.write(iter(rows))], 0)  # replayed
    writer.abort([writer.write(iter(rows)), None], 1)
    lost = writer.write(iter(rows))  # of a task that was tried twice
    writer.commit([writer.write(iter([("c", 3, 200, "", None)]))], 1)
    got = respond.written(spark, f"file://{tmp_path}/out").collect()
    assert sorted((r.request, r.at_ms, r.status, r.body, r.why, r.epoch) for r in got) == [("a", 1, 200, "é\n", None, 0), ("b", 2, None, None, "late", 0), ("c", 3, 200, "", None, 1)]
    assert len(list((tmp_path / "out/parts").iterdir())) == 3 and lost.name
    assert [r.request for r in respond.answers(spark, f"file://{tmp_path}/out").orderBy("request").collect()] == ["a", "c"]


def test_wrong_use(spark):
    schema = spark.createDataFrame([], respond.SETTLED).schema
    with pytest.raises(ValueError):
        respond._Writer({}, schema)
    with pytest.raises(ValueError):
        respond._Writer({"path": "file:///tmp/x"}, spark.createDataFrame([], "request string").schema)
    with pytest.raises(ValueError):
        respond.settle(None, None, 0)


def test_the_default_state_store_is_no_hindrance(spark, tmp_path):
    """Without settings of its own a session has a store that lacks column families: the stream failed there."""
    respond.register(spark)
    key = "spark.sql.streaming.stateStore.providerClass"
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, default)
    frames = [spark.createDataFrame([("a", at(0)), ("z", at(100_000))], "request string, req_ts timestamp"),
              spark.createDataFrame([("a", at(1), 200, "ok")], "request string, resp_ts timestamp, status int, body string")]
    streams = []
    for i, f in enumerate(frames):
        f.write.parquet(f"{tmp_path}/in{i}")
        streams.append(spark.readStream.schema(f.schema).parquet(f"{tmp_path}/in{i}"))
    path = f"file://{tmp_path}/out"
    try:
        with respond.keeping(spark):
            q = respond.settle(*streams).writeStream.format("respond").option("path", path).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and spark.conf.get(key) == default
    finally:
        spark.conf.set(key, before)
    assert [(r.request, r.status) for r in respond.answers(spark, path).where("request = 'a'").collect()] == [("a", 200)]
