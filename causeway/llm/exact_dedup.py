"""Exact deduplication by a stateful stream with disk-backed keyed state (native).

Documents are equal when their texts are identical after lower-casing A-Z only
(null counts as empty).  A narrow fingerprint table -- digest, stable identifier
and content locator -- is written to the shared folder and read as a *stream*; a
streaming aggregation keyed by digest, without watermark or expiry, keeps for each
digest the identifier and locator of the row that stays and the size of its group
in a RocksDB state store whose checkpoint lies in the shared folder.  The finished
state is read back once with Spark's state reader, written as a narrow table and joined
to the fingerprints.  Rows
that hit a digest already held are fetched by their locator and checked on their
full bytes; the texts of the others are not shuffled.

A locator is the file that has the row (as a hash of its path) and the row's number in
it.  Documents that don't come straight from files are written to the shared folder
first, so that they have locators.

Digests with many rows meet them by broadcast (:func:`common.meet`), so no task has all
copies of one.

Everything runs as DataFrame operations; no Python runs on the executors.

Defined results
    null text            counts as the empty text
    null ``doc_id``      sorts below every identifier; such a row can stay only in
                         a group that has none with an identifier
    repeated ``doc_id``  each row counts in ``group_size``; of rows with equal text
                         and the same identifier the one with the largest locator stays
    empty table          empty result
    extra columns        ignored; they never clash, as only two columns are read
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, meet, scratch

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Many small stores on an executor: no space reserved ahead, memory bounded for all of them
#: together, and those that are done with are soon closed.
_STORE = {
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}
#: Bits that locators of hits are hashed to: 2,048 rows of 32,768, which are broadcast; 8 MB is
#: below what Spark broadcasts by itself.
BITS = 2**26
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else; null becomes empty.

    ``lower`` does the same where all characters are ASCII, and is much faster.
    """
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def digest(body: Column) -> Column:
    """SHA-256 of a normalised text."""
    return F.unhex(F.sha2(body, 256))


def locator() -> Column:
    """Where a row of a file-based table stands: hash of the file's path, number of the row."""
    return F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def located(docs: DataFrame) -> DataFrame:
    """``docs`` itself if its rows have locators, else as a table in the shared folder."""
    try:
        docs.select(locator())
        return docs
    except AnalysisException:
        named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        held = cut(named, "documents")
        return held.select(*[F.col(n).alias(c) for n, c in zip(held.columns, docs.columns)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, locator`` of every row of a located table, written once to the shared folder."""
    return cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), digest(normalised(F.col(text_col))).alias("digest"), locator().alias("locator")
        ),
        "fingerprints",
    )


def run_stream(spark: SparkSession, source: str, schema, checkpoint: str) -> DataFrame:
    """Feed the fingerprints through the keyed state; return the state as a written table,
    as each read of the state itself opens the stores of all partitions again.

    State: digest -> (n, keeper), where keeper is the largest (doc_id, locator).  The stream
    runs in a session of its own, whose settings no other query sees.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    for name, value in _STORE.items():
        own.conf.set(name, value)
    rows = own.readStream.schema(schema).parquet(source)
    lowest = F.lit(-(2**63)).cast("long")  # a null identifier sorts below all
    held = rows.groupBy("digest").agg(
        F.count(F.lit(1)), F.max(F.struct(F.coalesce("doc_id", lowest).alias("rank"), "locator", "doc_id"))
    )
    query = (
        held.writeStream.outputMode("update").format("noop")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    state = spark.read.format("statestore").load(checkpoint)
    return cut(state.select(F.col("key.digest").alias("digest"), F.col("value.count").alias("n"), F.col("value.max").alias("keeper")), "state")


def _spot() -> tuple[Column, Column]:
    """Bucket and bit of a row's locator ``at`` among ``BITS`` bits."""
    spot = F.pmod(F.xxhash64("at.file", "at.row"), F.lit(BITS)) + 1
    return F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).cast("int").alias("bit")


def fetched(docs: DataFrame, hits: DataFrame, text_col: str) -> DataFrame:
    """``body`` of every row of ``docs`` whose locator is among ``hits`` (``at``), and of some others.

    The locators become bits, 8 MB whatever their number, which every task that scans the
    documents gets; a row whose bit is not set is passed over before its text is used, and no
    text is shuffled.  With h hits about h / ``BITS`` of the other rows are let through.
    """
    bits = hits.select(*_spot()).repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bucket, bit = _spot()
    rows = docs.select(locator().alias("at"), F.col(text_col).alias("text")).select(bucket, bit, "text")
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright("bit", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(bits), "bucket").where(F.getbit(byte, F.col("bit").bitwiseAND(7)) == 1)
    return met.select(normalised(F.col("text")).alias("body"))


def check_bytes(docs: DataFrame, decided: DataFrame, text_col: str) -> None:
    """Compare the full texts of all rows whose digest another row has, fetched by locator.

    Texts of a digest are folded to their least and greatest inside each task before
    they are shuffled, so a hot digest sends a row per task, not one per copy.  Rows
    fetched though nothing hit them have a digest of their own and change nothing.
    """
    hits = decided.where("group_size > 1").select(F.col("locator").alias("at"))
    same = fetched(docs, hits, text_col).groupBy(digest(F.col("body")).alias("digest")).agg(F.min("body").alias("lo"), F.max("body").alias("hi"))
    bad = same.where("lo <> hi").select(F.hex("digest")).head()
    if bad is not None:
        raise RuntimeError(f"different texts share the SHA-256 digest {bad[0]}")


def _decided(docs: DataFrame, id_col: str, text_col: str, verify: bool) -> DataFrame:
    spark = docs.sparkSession
    prints = fingerprints(docs, id_col, text_col)
    state = run_stream(spark, prints._scratch_path, prints.schema, scratch(spark, "dedup-state"))
    out = meet(prints, state, "digest").select(
        "doc_id",
        F.col("keeper.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("locator") == F.col("keeper.locator")).alias("kept"),
        "digest",
        "locator",
    )
    if verify:
        check_bytes(docs, out, text_col)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", verify: bool = True) -> DataFrame:
    """One row for every input row: ``doc_id, keep_id, group_size, kept, digest, locator``."""
    return _decided(located(docs), id_col, text_col, verify)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another row already stands for."""
    docs = located(docs)
    kept = _decided(docs, id_col, text_col, True).where("kept").select(F.col("locator").alias("_kept"))
    name = "_at"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, locator()).join(kept, F.col(name) == F.col("_kept"), "left_semi").drop(name)


def op3_query(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its decision, as the registered query returns it."""
    return exact_dedup(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE_SQL = """
with t as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h
  from documents
)
select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
       doc_id = max(doc_id) over (partition by h) as kept, h as text_sha256
from t
"""
