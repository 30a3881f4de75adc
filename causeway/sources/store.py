"""A store of memories and edges as versioned parquet tables.

A version is a pair of table folders added to those before it.  A commit is a small file,
named by its number, that names the versions of one transaction; it is created without
overwriting, after all tables are written.  So a transaction of several batches shows whole
or not at all, and of several writers one gets a number, while the others append anew to
what they now find.  (The folder needs a file system whose create without overwrite is
atomic, as HDFS and local ones have.)

A commit also holds the range of keys of each version and, for versions of up to
``MAX_BITS / BITS`` memories, a bloom filter of their uuids; so a point lookup skips versions
before any is scanned.  In the files of larger versions the filters of parquet do the same
for row groups.  Every ``SNAPSHOT_EVERY`` commits the log so far is written as one table,
and readers open that and the few commit files after it.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.append import Appended, append
from .schema import EDGE, MEMORY
from .shared import remove


#: What a commit tells of the keys of a version.
KEYS = "version string, rows bigint, low string, high string, first bigint, last bigint, bloom string"
#: A commit file.
COMMIT = "n bigint, versions array<string>"
COMMIT_KEYS = f"{COMMIT}, keys array<struct<{', '.join(c.replace(' ', ':') for c in KEYS.split(', '))}>>"
#: Commits from one snapshot of the log to the next.
SNAPSHOT_EVERY = 100
#: Bits of a filter for each uuid (one false hit in 120), and of the largest filter.
BITS, MAX_BITS = 10, 1 << 16
#: How many edges of a version lead to each memory.
DEGREE = "rowid bigint, refs bigint"


class CancelTransaction(Exception):
    """Raised inside a transaction to drop it without an error."""


class Store:
    """The reading side."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _snapshot(self) -> int:
        """How many commits the latest snapshot holds, 0 without one."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshots")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def log(self) -> DataFrame:
        """Commits ``n, versions, keys``: the latest snapshot and the files of the commits after it.

        Commits are numbered without gaps, so those files are found by name, without listing the log.
        """
        held = n = self._snapshot()
        tail = []
        while self._exists(name := f"{self.path}/published/{n:012}.json"):
            tail.append(name)
            n += 1
        out = self.spark.read.schema(COMMIT_KEYS).json(tail) if tail else self.spark.createDataFrame([], COMMIT_KEYS)
        if held:
            out = self.spark.read.schema(COMMIT_KEYS).parquet(f"{self.path}/snapshots/{held:012}").unionByName(out)
        return out

    def commits(self) -> list[list[str]]:
        """The versions of each commit, in order."""
        return [r["versions"] for r in self.log().select("n", "versions").orderBy("n").collect()]

    def holding(self, uuids: Iterable[str] = (), rowids: Iterable[int] = ()) -> list[str]:
        """The versions that may hold one of the keys, by range and filter; those without keys may hold any.

        Only versions whose range has a key reach the driver.
        """
        uuids, rowids = sorted(set(uuids)), sorted(set(rowids))
        k = self.log().select("n", F.posexplode("versions").alias("at", "version"), F.col("keys").alias("all"))
        k = k.withColumn("key", F.get(F.filter("all", lambda x: x["version"] == F.col("version")), F.lit(0))).select("n", "at", "version", "key.*")
        by_uuid = F.exists(F.array(*map(F.lit, uuids)).cast("array<string>"), lambda u: u.between(F.col("low"), F.col("high")))
        by_row = F.exists(F.array(*map(F.lit, rowids)).cast("array<bigint>"), lambda r: r.between(F.col("first"), F.col("last")))
        unknown = F.col("rows").isNull()
        rows = k.toDF("n", "at", "version", "of", "rows", "low", "high", "first", "last", "bloom").where(unknown | by_uuid | by_row)
        found = rows.select("n", "at", "version", "low", "high", "bloom", (unknown | by_row).alias("sure")).orderBy("n", "at").collect()
        return [r["version"] for r in found if r["sure"] or self._may_hold(r["bloom"], [u for u in uuids if r["low"] <= u <= r["high"]])]

    def _may_hold(self, bloom: str | None, uuids: list[str]) -> bool:
        if bloom is None:
            return True
        jvm = self.spark.sparkContext._jvm
        found = jvm.org.apache.spark.util.sketch.BloomFilter.readFrom(jvm.java.io.ByteArrayInputStream(base64.b64decode(bloom)))
        return any(found.mightContainString(u) for u in uuids)

    def find(self, uuids: Iterable[str] = (), rowids: Iterable[int] = ()) -> DataFrame:
        """The memories with one of the keys, read from the versions that may hold them."""
        uuids, rowids = sorted(set(uuids)), sorted(set(rowids))
        m = self._table("memories", MEMORY, self.holding(uuids, rowids))
        hit = F.lit(False)
        for name, keys in (("uuid", uuids), ("rowid", rowids)):
            hit = hit | F.col(name).isin(keys) if keys else hit
        return m.where(hit)

    def versions(self) -> list[str]:
        return [v for c in self.commits() for v in c]

    def _table(self, name: str, schema: str, versions: list[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/{v}/{name}" for v in (self.versions() if versions is None else versions)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def memories(self) -> DataFrame:
        return self._table("memories", MEMORY)

    def edges(self) -> DataFrame:
        return self._table("edges", EDGE)

    def indegrees(self) -> DataFrame:
        """``rowid, refs`` of all memories: each version counted its own edges, only these counts are read."""
        counts = self._table("degrees", DEGREE).groupBy("rowid").agg(F.sum("refs").alias("refs"))
        return self.memories().select("rowid").join(counts, "rowid", "left").select("rowid", F.coalesce("refs", F.lit(0)).alias("refs"))


class Appender(Store):
    """The writing side; ``with appender.transaction() as t: t.add(batch)``."""

    def transaction(self) -> Transaction:
        return Transaction(self)

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path)
        self._keys: dict[str, dict] = {}

    def index(self, version: str) -> None:
        """Gather the range and filter of a version's keys for the commit that will name it."""
        m = self._table("memories", MEMORY, [version])
        key = m.agg(F.count(F.lit(1)), F.min("uuid"), F.max("uuid"), F.min("rowid"), F.max("rowid")).head()
        names = ("rows", "low", "high", "first", "last")
        self._keys[version] = {"version": version, **dict(zip(names, key)), "bloom": None}
        if 0 < key[0] * BITS <= MAX_BITS:
            out = self.spark.sparkContext._jvm.java.io.ByteArrayOutputStream()
            m._jdf.stat().bloomFilter("uuid", key[0], max(64, key[0] * BITS)).writeTo(out)
            self._keys[version]["bloom"] = base64.b64encode(bytes(out.toByteArray())).decode()

    def _write_snapshot(self, n: int) -> None:
        """The first ``n`` commits as one table, which shows when it is whole.  Only the writer of commit n - 1 does this."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        draft = f"{self.path}/snapshots/_{uuid.uuid4().hex}"
        self.log().where(F.col("n") < n).coalesce(1 + n // 100_000).write.parquet(draft)
        path = jvm.org.apache.hadoop.fs.Path(draft)
        path.getFileSystem(conf).rename(path, jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshots/{n:012}"))

    def publish(self, n: int, versions: list[str]) -> bool:
        """Create commit ``n``; False if another writer has created it."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/published/{n:012}.json")
        try:
            out = path.getFileSystem(conf).create(path, False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception) or path.getFileSystem(conf).exists(path):
                return False
            raise
        keys = [self._keys.pop(v) for v in versions if v in self._keys]
        out.write(bytearray(json.dumps({"n": n, "versions": versions, "keys": keys}).encode()))
        out.close()
        if (n + 1) % SNAPSHOT_EVERY == 0:
            self._write_snapshot(n + 1)
        return True


class Transaction:
    """Batches that are published together when the block ends; ``result`` is the last one's."""

    def __init__(self, store: Appender, attempts: int = 20):
        self.store, self.attempts = store, attempts
        self.result: Appended | None = None
        self.batches: list[DataFrame] = []

    def __enter__(self) -> Transaction:
        return self

    def add(self, batch: DataFrame) -> None:
        self.batches.append(batch)

    def _stage(self, base: list[str], staged: list[str]) -> None:
        for batch in self.batches:
            self.result = append(self.store._table("memories", MEMORY, base + staged), batch)
            staged.append(f"v-{uuid.uuid4().hex}")
            self.result.memories.write.option("parquet.bloom.filter.enabled#uuid", "true").parquet(f"{self.store.path}/{staged[-1]}/memories")
            self.store.index(staged[-1])
            self.result.edges.write.parquet(f"{self.store.path}/{staged[-1]}/edges")
            degrees = self.store._table("edges", EDGE, [staged[-1]]).groupBy(F.col("dst_id").alias("rowid")).agg(F.count(F.lit(1)).alias("refs"))
            degrees.write.parquet(f"{self.store.path}/{staged[-1]}/degrees")

    def __exit__(self, kind, error, trace) -> bool:
        if kind is not None:
            return issubclass(kind, CancelTransaction)
        for _ in range(self.attempts if self.batches else 0):
            commits, staged = self.store.commits(), []
            done = False
            try:
                self._stage([v for c in commits for v in c], staged)
                done = self.store.publish(len(commits), staged)
            finally:
                if not done:
                    for version in staged:
                        self.store._keys.pop(version, None)
                        remove(self.store.spark, f"{self.store.path}/{version}")
            if done:
                return False
        if self.batches:
            raise RuntimeError(f"other writers were first {self.attempts} times")
        return False
