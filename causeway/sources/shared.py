"""Tables in the folder that all executors share, to cut long lineages safely."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where that is unset, a temporary folder, but
    only on one machine: executors of a cluster would each write to a disk of their own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="causeway-")
    return _own[app]


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    for held in _open:
        held.append(path)
    return out


#: The lists of the ``scratch_tables`` blocks that are open.
_open: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are cut inside the block are deleted at its end, so results must be written before.

    ``with scratch_tables(spark): recall(...).write.parquet(out)``
    """
    held: list[str] = []
    _open.append(held)
    try:
        yield held
    finally:
        _open.remove(held)
        for path in held:
            remove(spark, path)


def drop(df: DataFrame) -> None:
    """Delete the table behind a DataFrame made by :func:`cut`."""
    path = getattr(df, "_scratch_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def running_sums(df: DataFrame, order: list, value: Column | dict[str, Column], name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` (whole numbers) over all rows before each one in the given
    order, without bringing all rows to one task; several sums if ``value`` names several columns.

    Rows are dealt to ranges, which equal keys may share, and written; each range is summed
    on its own, on top of the sums of the ranges before it (one small row for each).
    """
    spark = df.sparkSession
    values = value if isinstance(value, dict) else {name: value}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    summed = {n: f"_value{i}" for i, n in enumerate(values)}
    ranged = df.withColumns({summed[n]: v.cast("long") for n, v in values.items()}).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = sorted(held.groupBy("_part").agg(*[F.sum(c).alias(c) for c in summed.values()]).collect(), key=lambda r: r["_part"])
    if not sizes:
        return held.select(*df.columns, *[F.lit(0).cast("long").alias(n) for n in values])
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = []
    for n, c in summed.items():
        first, total = {}, 0
        for r in sizes:
            first[r["_part"]], total = total, total + (r[c] or 0)
        offset = F.create_map(*[F.lit(x) for p in first for x in (p, first[p])])[F.col("_part")]
        sums.append((offset + F.coalesce(F.sum(c).over(inside), F.lit(0))).cast("long").alias(n))
    return held.select(*df.columns, *sums)


def number_rows(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """``df`` with 1, 2, 3 ... in the given order, without bringing all rows to one task.

    Rows are dealt to ranges and written; each range is numbered on its own, on top of
    the sizes of the ranges before it (one small row for each).
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    if not sizes:
        return held.select(*df.columns, F.lit(0).cast("long").alias(name))
    before, total = {}, 0
    for p, n in sizes:
        before[p], total = total, total + n
    offset = F.create_map(*[F.lit(x) for p in before for x in (p, before[p])])
    # the lower 33 bits of a monotonic id count the rows of a partition
    return held.select(*df.columns, (offset[F.col("_part")] + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("long").alias(name))
