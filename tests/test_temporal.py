"""Golden vectors of the time-driven operators, and their streaming forms against the batch forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from causeway.functions import cron, ids, timers
from causeway.operators import temporal, transcript
from causeway.sources.schema import part
from causeway.streaming import temporal as streams
from causeway.streaming.sources import load_files, table_stream


@pytest.mark.parametrize("td,interval,wait", [(-25, 10, 5), (-20, 10, 10), (-1, 60, 59), (-25, None, None), (7, 10, 7)])
def test_catch_up(spark, td, interval, wait):
    df = spark.createDataFrame([(td, interval)], "td int, i int")
    assert df.select(timers.catch_up(F.col("td"), F.col("i")).alias("w")).head().w == wait


@pytest.mark.parametrize("spec,first,last,want", [
    ("0 9 15W * *", "2025-02-01", "2025-02-28", ["2025-02-14"]), ("0 0 1W * *", "2024-06-01", "2024-06-30", ["2024-06-03"]),
    ("0 0 LW * *", "2024-03-01", "2024-03-31", ["2024-03-29"]), ("0 0 L 2 *", "2024-01-01", "2024-12-31", ["2024-02-29"]),
    ("0 0 * * 5L", "2024-01-01", "2024-01-31", ["2024-01-26"]), ("0 0 * * 1#2", "2024-01-01", "2024-01-31", ["2024-01-08"]),
    ("@weekly", "2024-01-01", "2024-01-10", ["2024-01-07"]), ("0 0 * * 7", "2024-01-01", "2024-01-10", ["2024-01-07"]),
])
def test_cron_days(spark, spec, first, last, want):
    days = spark.sql(f"select explode(sequence(date '{first}', date '{last}')) as day")
    assert [str(r.day) for r in temporal.cron_jobs(days, {"x": spec}).orderBy("day").collect()] == want


def test_days_are_the_same_in_python_and_columns(spark):
    specs = ["0 0 15W * *", "0 0 1W,30W * *", "0 0 LW * *", "0 0 L 2,4 *", "0 0 * * 5L", "0 0 * * 1#2,3#5", "0 0 13 * 5", "0 0 10-20/3 * MON-WED", "0 0 31 * *", "@monthly"]
    days = spark.sql("select explode(sequence(date '2023-12-01', date '2025-01-31')) as day")
    parsed = [cron.parse(s) for s in specs]
    for r in days.select("day", *[cron.matches_day(s, F.col("day")).alias(str(i)) for i, s in enumerate(parsed)]).collect():
        assert [r[str(i)] for i in range(len(specs))] == [cron.on(s, r.day) for s in parsed], r.day


def test_cron_parsing():
    s = cron.parse("5/10 1-3,9 * FEB MON-WED/2")
    assert (s.minutes, s.hours, s.months, s.weekdays) == ([5], [1, 2, 3, 9], [2], [1, 3])
    for bad in ("* * * *", "60 * * * *", "* 24 * * *", "* * 0 * *", "* * * feb *", "3-1 * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            cron.parse(bad)


def test_watchdog_counts(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet").withColumn("us", temporal.micros(F.col("ts")))
    end = F.lit(e.agg(F.max("us")).head()[0])
    for hours, both in ((1, (9147, 9134)), (24, (1214, 1081))):
        t = hours * 3_600_000_000
        assert (temporal.watchdog_expiries(e, "user_id", F.col("us"), t).count(), temporal.watchdog_expiries(e, "user_id", F.col("us"), t, end).count()) == both
    with pytest.raises(ValueError):
        temporal.watchdog_expiries(e, "user_id", F.col("us"), 0)


def run(df, name, spark, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_watchdog_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    hour = 3_600_000
    got = run(streams.watchdog(table_stream(spark, f"{tmp_path}/in"), "user_id", "ts", hour), "dogs", spark, tmp_path)
    us = e.withColumn("us", F.floor(temporal.micros(F.col("ts")) / 1000))
    # timers later than the last watermark have not fired
    end = us.agg(F.max("us")).head()[0]
    want = temporal.watchdog_expiries(us, "user_id", F.col("us"), hour).collect()
    inside = {(str(r.user_id), r.last_us) for r in want if r.expired_us <= end}
    found = {(r.key, r.last_ms) for r in got}
    assert len(found) == len(got) and inside <= found <= {(str(r.user_id), r.last_us) for r in want}


def test_timer_stream(spark, tmp_path):
    t = 1_000_000_000
    rows = [
        ("a", 1, "schedule", t + 10_000, 10_000, t), ("b", 2, "schedule", t + 15_000, None, t), ("c", 3, "schedule", t + 5_000, 1_000, t),
        ("c", 4, "cancel", None, None, t), ("z", 5, "cancel", None, None, t + 45_000),
    ]
    df = spark.createDataFrame(rows, "timer string, seq int, action string, first_ms bigint, interval_ms bigint, at bigint")
    for ts in (t, t + 45_000):
        df.where(F.col("at") == ts).withColumn("ts", F.timestamp_millis("at")).drop("at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = run(streams.timer_stream(table_stream(spark, f"{tmp_path}/in", 1)), "ticks", spark, tmp_path)
    assert sorted((r.timer, r.at_ms - t) for r in got) == [("a", 10_000), ("a", 20_000), ("a", 30_000), ("a", 40_000), ("b", 15_000)]


def test_once_stream(spark, tmp_path):
    rows = [("a", 1, False), ("a", 2, False), ("a", 3, True), ("a", 4, False), ("b", 5, True), ("b", 6, False)]
    spark.createDataFrame(rows, "key string, seq bigint, reset boolean").write.parquet(f"{tmp_path}/in")
    got = run(streams.once(table_stream(spark, f"{tmp_path}/in")), "first", spark, tmp_path)
    assert sorted((r.key, r.seq) for r in got) == [("a", 1), ("a", 4), ("b", 6)]


def test_exchange(spark):
    req = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "request int, req_us bigint")
    s = 1_000_000
    resp = spark.createDataFrame([(1, 29 * s, 200, "ok"), (3, 31 * s, 200, "slow"), (1, 30 * s, 201, "again"), (9, 0, 200, "?")], "request int, resp_us bigint, status int, body string")
    answers, dead = temporal.exchange(req, resp)
    assert sorted((r.request, r.status) for r in answers.collect()) == [(1, 200), (2, 504), (3, 504)]
    assert sorted((r.request, r.why) for r in dead.collect()) == [(1, "repeated"), (3, "late"), (9, "unknown")]


def test_exchange_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    late = t + dt.timedelta(hours=1)
    reqs = [[(1, t), (2, t)], [(3, late)], [(4, late + dt.timedelta(hours=1))]]
    resps = [[(1, t + dt.timedelta(seconds=5), 200, "ok")], [(3, late, 200, "ok")], [(9, late + dt.timedelta(hours=1), 200, "")]]
    for name, parts, schema in (("req", reqs, "request int, req_ts timestamp"), ("resp", resps, "request int, resp_ts timestamp, status int, body string")):
        for p in parts:
            spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    out = streams.exchange(table_stream(spark, f"{tmp_path}/req", 1), table_stream(spark, f"{tmp_path}/resp", 1))
    got = {(r.request, r.status) for r in run(out, "answers", spark, tmp_path)}
    assert {(1, 200), (2, 504), (3, 200)} <= got


def test_cron_stream(spark, tmp_path):
    days = spark.sql("select explode(sequence(timestamp '2024-01-01 00:00:00', timestamp '2024-01-02 23:59:00', interval 1 minute)) as timestamp")
    days.write.parquet(f"{tmp_path}/in")
    specs = {"q": "*/15 9 * * *", "d": "@daily"}
    got = run(streams.cron_stream(table_stream(spark, f"{tmp_path}/in"), specs), "jobs", spark, tmp_path)
    want = temporal.cron_jobs(days.select(F.to_date("timestamp").alias("day")).distinct(), specs).collect()
    assert sorted((r.cron, r.minute.hour, r.minute.minute) for r in got) == sorted((r.cron, r.hour, r.minute) for r in want)


def test_append_stream(spark, tmp_path):
    from causeway.sources.store import Appender
    from causeway.streaming.append import append_stream

    for rows in ([("a", [], 1), ("b", ["a"], 2)], [("b", ["z"], 3), ("c", ["b", "q"], 4)]):
        df = spark.createDataFrame(rows, "uuid string, targets array<string>, arrival bigint")
        df.withColumn("kind", F.lit("other")).withColumn("metadata", F.lit("{}")).withColumn("parts", F.array(part("text", content=F.lit("x")))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = Appender(spark, f"file://{tmp_path}/store")
    append_stream(table_stream(spark, f"{tmp_path}/in", 1), store, f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.uuid for r in store.memories().collect()) == ["a", "b", "c"]
    assert store.edges().count() == 2


def test_transcript_of_tools_and_files(spark):
    rows = [
        (1, "other", [("text", "a", None), ("text", "b", None), ("file", None, "f1")]), (2, "self", [("think", "hm", None), ("tool", None, "c1"), ("text", "ok", None)]),
        (3, "other", [("text", "more", None)]), (4, "self", [("tool", None, "c2")]), (5, "self", [("text", "x", None)]), (6, "self", [("tool", None, "c3")]),
    ]
    df = spark.createDataFrame(rows, "id bigint, kind string, raw array<struct<k:string,c:string,r:string>>")
    parts = F.transform("raw", lambda p: F.struct(
        p["k"].alias("kind"), p["c"].alias("content"), p["r"].alias("file"), F.lit("image/png").alias("mimetype"), F.lit(None).cast("string").alias("think_id"),
        F.lit(None).cast("string").alias("signature"), F.lit("fn").alias("name"), F.lit("{}").alias("args"), F.lit("7").alias("result"), p["r"].alias("call_id")))
    m = df.select(F.lit(1).cast("bigint").alias("graph_id"), "id", "kind", F.lit("{}").alias("metadata"), parts.alias("parts"), F.col("id").alias("pos"))
    e = spark.createDataFrame([(1, i + 1, i) for i in range(1, 6)], "graph_id bigint, src_id bigint, dst_id bigint")
    shown = transcript.display_ids(m.select("graph_id", F.col("id").alias("node_id"), F.col("id").alias("seq")))
    got = [(r.msg_seq, r.msg_type, r.part_kind, r.content if r.part_kind != "tool-call" else r.call_id) for r in transcript.messages(m, e, shown, header=False).orderBy("msg_seq", "part_seq").collect()]
    assert got == [
        (1, "request", "text", "ab"), (1, "request", "file", "[file failed to load image/png f1]"), (2, "response", "thinking", "hm"), (2, "response", "tool-call", "c1"),
        (2, "response", "text", "ok"), (3, "request", "tool-return", "7"), (3, "request", "text", "more"), (4, "response", "tool-call", "c2"), (5, "request", "tool-return", "7"),
        (6, "response", "text", "x"), (7, "response", "tool-call", "c3"), (8, "request", "tool-return", "7"),
    ]


def test_replies(spark):
    shown = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "graph_id bigint, id bigint, display_id int")
    r = spark.createDataFrame([(1, 99, '{"depends":[2,2,7],"response":"hi"}')], "graph_id bigint, new_id bigint, data string")
    assert [tuple(x) for x in transcript.replies(r, shown).collect()] == [(1, 99, 11, "hi")]


def test_identifiers(spark):
    df = spark.createDataFrame([("018cc251-f400-7000-8000-000000000000", "http://h/p?a=1&b=&a=2#x")], "u string, url string")
    r = df.select(ids.uuid7_millis(F.col("u")).alias("ms"), ids.from_bytes(ids.to_bytes(F.col("u"))).alias("back"), ids.query_multimap(F.col("url")).alias("q")).head()
    assert r.ms == 0x018CC251F400 and r.back == "018cc251f40070008000000000000000" and r.q == {"a": ["1", "2"], "b": [""]}


def test_load_files(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "one").write_bytes(b"abc")
    got = load_files(spark, spark.createDataFrame([("one", "t"), ("two", "t")], "file string, mimetype string"), f"{tmp_path}/f")
    assert {r.file: r.bytes for r in got.collect()} == {"one": bytearray(b"abc"), "two": None}
