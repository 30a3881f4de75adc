"""Responses to requests: which of them still find their request, and a sink that keeps each epoch once.

:func:`settle` decides by event time: a request is open from its time until its timeout; the
first response inside that span answers it, a request that got none is answered 504, and every
other response is a dead letter (``why`` is "late", "repeated" or "unknown").  A response that
comes to Spark before its request waits for it.  A settled request is remembered for ``remember``
longer, to tell late and repeated responses from unknown ones; then its state goes.

The sink ``respond`` is a Python data source.  Tasks write files of their own; an epoch's commit
names the files that count, in one file under ``epochs`` that shows when it is whole.  An epoch
that is replayed finds that file and drops what its tasks wrote, so responses go out once.

    register(spark)
    with keeping(spark):
        settle(requests, responses).writeStream.format("respond").option("path", out).option("checkpointLocation", cp).start()
    answers(spark, out), dead_letters(spark, out)

State goes along with the rows, so any store holds it; :func:`keeping` has it kept on disk rather
than in memory, whatever the session is set to.  ``path`` is in a file system that driver and executors share (local, HDFS or S3 paths).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

SETTLED = "request string, at_ms bigint, status int, body string, why string"
NO_ANSWER = "Response action not invoked."
#: Many small stores on an executor: no space reserved ahead, memory bounded for all of them together.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


EVENT = "request string, ms bigint, kind int, status int, body string"
STATE = f"waiting array<struct<{EVENT}>>, requests array<struct<request string, ms bigint, done boolean>>"
#: Requests share a state by a hash, so that a call into Python, which takes about 10 ms, serves many of them.
BUCKETS = 1024


def _settle(timeout_ms: int, remember_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Events of a bucket of requests wait for the watermark; each request's are then taken in the order of their times.

    A bucket has one timeout, for the next time at which there is something to do: all that the
    watermark has passed is done at once.
    """

    def task(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = state.getCurrentWatermarkMs(), []
        waiting, asked = state.get if state.exists else ([], [])
        held = [tuple(r) for r in waiting]
        requests = {name: (ms, done) for name, ms, done in asked}
        for pdf in rows:
            status = [None if x is None else int(x) for x in pdf["status"].astype("object").where(pdf["status"].notna(), None)]
            held += zip(pdf["request"].tolist(), pdf["ms"].tolist(), pdf["kind"].tolist(), status, pdf["body"].tolist())

        def pass_to(name: str, ms: int) -> tuple[int, bool] | None:
            """What becomes of a request by the time ``ms``."""
            request = requests.get(name)
            if request is not None and not request[1] and ms > request[0] + timeout_ms:
                request = requests[name] = (request[0], True)
                out.append((name, request[0] + timeout_ms, 504, NO_ANSWER, None))
            if request is not None and ms > request[0] + timeout_ms + remember_ms:
                del requests[name]
                return None
            return request

        due = sorted((r for r in held if r[1] <= now), key=lambda r: (r[1], r[2], r[3] or 0, r[4] or ""))
        for name, ms, kind, status, body in due:
            request = pass_to(name, ms - 1)
            if kind == 0:  # the request; one that is repeated changes nothing
                requests.setdefault(name, (ms, False))
            elif request is None:
                out.append((name, ms, status, body, "unknown"))
            elif ms > request[0] + timeout_ms:
                out.append((name, ms, status, body, "late"))
            elif request[1]:
                out.append((name, ms, status, body, "repeated"))
            else:
                requests[name] = (request[0], True)
                out.append((name, ms, status, body, None))
        for name in list(requests):
            pass_to(name, now)
        later = [r for r in held if r[1] > now]
        ahead = [r[1] for r in later] + [ms + timeout_ms + (remember_ms if done else 0) + 1 for ms, done in requests.values()]
        if ahead:
            state.update((later, [(name, *r) for name, r in requests.items()]))
            state.setTimeoutTimestamp(min(ahead))
        elif state.exists:
            state.remove()
        if out:
            df = pd.DataFrame(out, columns=["request", "at_ms", "status", "body", "why"], dtype="object")
            yield df.astype({"at_ms": "int64", "status": "Int32"})

    return task


def settle(requests: DataFrame, responses: DataFrame, timeout_ms: int = 30_000, remember_ms: int = 3_600_000, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """``request, at_ms, status, body, why``; ``why`` is null for the one answer that each request gets.

    ``requests`` has ``request, req_ts``, ``responses`` has ``request, resp_ts, status, body``; rows without
    a request or a time are left out, and so are rows that come after the watermark has passed them.
    """
    if timeout_ms <= 0 or remember_ms < 0:
        raise ValueError("the timeout must be positive and what is remembered not negative")
    row = lambda ts, kind, status, body: [
        F.col("request").cast("string").alias("request"), F.col(ts).cast("timestamp").alias("ts"), F.lit(kind).alias("kind"),
        status.cast("int").alias("status"), body.cast("string").alias("body"),
    ]
    both = requests.select(*row("req_ts", 0, F.lit(None), F.lit(None))).unionByName(responses.select(*row("resp_ts", 1, F.col("status"), F.col("body"))))
    rows = both.where("request is not null and ts is not null").withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("request"), F.lit(buckets))).groupBy("bucket").applyInPandasWithState(_settle(timeout_ms, remember_ms), SETTLED, STATE, "append", "EventTimeTimeout")


# --- the sink ----------------------------------------------------------------


@dataclass
class Wrote(WriterCommitMessage):
    """The file of a task, None if it had no row."""

    name: str | None


class _Writer(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str], schema: StructType):
        if "path" not in options:
            raise ValueError("the sink needs the option path")
        self.path, self.columns = options["path"], schema.fieldNames()
        missing = {"request", "status", "body", "why"} - set(self.columns)
        if missing:
            raise ValueError(f"the sink needs the columns {sorted(missing)}")

    def _open(self, *below: str) -> tuple[fs.FileSystem, str]:
        where, path = fs.FileSystem.from_uri(self.path)
        return where, "/".join([path.rstrip("/"), *below])

    def write(self, iterator: Iterator) -> Wrote:
        out, name = None, f"{uuid.uuid4().hex}.json"
        try:
            for row in iterator:
                if out is None:
                    where, path = self._open("parts")
                    where.create_dir(path, recursive=True)
                    out = where.open_output_stream(f"{path}/{name}")
                out.write(json.dumps(dict(zip(self.columns, row)), default=str).encode() + b"\n")
        finally:
            if out is not None:
                out.close()
        return Wrote(name if out is not None else None)

    def commit(self, messages: list[Wrote | None], batchId: int) -> None:
        where, path = self._open("epochs")
        where.create_dir(path, recursive=True)
        done = f"{path}/{batchId:012}.json"
        if where.get_file_info(done).type != fs.FileType.NotFound:
            return self._drop(messages)  # written before the failure that made Spark replay it
        draft = f"{path}/_{uuid.uuid4().hex}"
        with where.open_output_stream(draft) as out:
            out.write(json.dumps({"epoch": batchId, "parts": [m.name for m in messages if m and m.name]}).encode())
        where.move(draft, done)

    def abort(self, messages: list[Wrote | None], batchId: int) -> None:
        self._drop(messages)

    def _drop(self, messages: list[Wrote | None]) -> None:
        for m in messages:
            if m and m.name:
                where, path = self._open("parts", m.name)
                where.delete_file(path)


class Respond(DataSource):
    @classmethod
    def name(cls) -> str:
        return "respond"

    def schema(self) -> str:
        return SETTLED

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _Writer(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Respond)


@contextmanager
def keeping(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside the block keep their state in RocksDB, whatever the session is
    set to; a stream takes a copy of the settings when it starts, the session gets its own back."""
    before = {name: spark.conf.get(name, None) for name in _STORE}
    try:
        for name, value in _STORE.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def written(spark: SparkSession, path: str, schema: str = SETTLED) -> DataFrame:
    """All rows of the epochs that were committed, with ``epoch``."""
    path = path.rstrip("/")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/epochs")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], f"{schema}, epoch bigint")
    named = spark.read.schema("epoch bigint, parts array<string>").json(f"{path}/epochs").select("epoch", F.explode("parts").alias("part"))
    rows = spark.read.schema(schema).json(f"{path}/parts").withColumn("part", F.element_at(F.split("_metadata.file_path", "/"), -1))
    return rows.join(named, "part").drop("part")


def answers(spark: SparkSession, path: str) -> DataFrame:
    """The answer of each request."""
    return written(spark, path).where("why is null").select("request", "at_ms", "status", "body")


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """Responses that found no open request."""
    return written(spark, path).where("why is not null").select("request", "at_ms", "status", "body", "why")
