"""The stimulus source: every tick once, in batches, in streams and over restarts."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from causeway.functions import cron
from causeway.sources import stimulus

SPECS = {"half": "*/30 * * * *", "noon": "0 12 * * MON-FRI", "lw": "15 3 LW * *"}
TIMERS = {"beat": ["2023-12-31T23:59:30", 5400], "once": ["2024-01-02T05:00:10", None]}


@pytest.fixture
def source(spark):
    stimulus.register(spark)
    return lambda kind: kind.format("stimulus").options(cron=json.dumps(SPECS), timers=json.dumps(TIMERS), start="2024-01-01T00:00", span="1000")


def want(first, end):
    """Minute by minute, and interval by interval."""
    utc = dt.timezone.utc
    a, b = (dt.datetime.fromisoformat(x).replace(tzinfo=utc) for x in (first, end))
    out, at = [], a
    while at < b:
        out += [(n, at) for n, s in SPECS.items() for p in [cron.parse(s)] if at.minute in p.minutes and at.hour in p.hours and cron.on(p, at.date())]
        at += dt.timedelta(minutes=1)
    for name, (began, interval) in TIMERS.items():
        at = dt.datetime.fromisoformat(began).replace(tzinfo=utc)
        while at < b:
            if at >= a:
                out.append((name, at))
            if interval is None:
                break
            at += dt.timedelta(seconds=interval)
    return sorted((n, t.timestamp()) for n, t in out)


def found(df):
    return sorted((r.name, r.us / 1e6) for r in df.select("name", F.unix_micros("at").alias("us")).collect())


def test_batch(spark, source):
    df = source(spark.read).option("end", "2024-01-04T06:31").load()
    assert found(df) == want("2024-01-01T00:00", "2024-01-04T06:31")
    assert df.rdd.getNumPartitions() > len(SPECS) + len(TIMERS)  # spans of entries
    none = spark.read.format("stimulus").options(start="2024-01-01T00:00", end="2024-01-02T00:00").load()
    assert none.count() == 0


@pytest.mark.parametrize("options", [{"cron": '{"x": "61 * * * *"}', "start": "2024-01-01", "end": "2024-01-02"}, {"cron": "{}"}, {"timers": '{"x": ["2024-01-01", 0]}', "start": "2024-01-01", "end": "2024-01-02"}])
def test_wrong_options_fail_at_once(spark, source, options):
    with pytest.raises(Exception):
        spark.read.format("stimulus").options(**options).load().collect()


def test_stream_goes_on_after_a_restart(spark, source, tmp_path):
    """Each run starts from the checkpoint of the one before; a run without new minutes adds nothing."""
    for end in ("2024-01-02T00:00", "2024-01-02T00:00", "2024-01-02T05:01", "2024-01-04T00:00"):
        df = source(spark.readStream).option("end", end).load()
        q = df.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert found(spark.read.parquet(f"{tmp_path}/out")) == want("2024-01-01T00:00", end)
