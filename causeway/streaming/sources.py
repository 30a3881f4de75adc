"""Line and table sources, and the console sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder or file of parquet as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as a stream of lines ``text``."""
    return spark.readStream.format("text").load(path).select(F.col("value").alias("text"))


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").options(host=host, port=port).load().select(F.col("value").alias("text"))


def to_console(df: DataFrame):
    return df.writeStream.format("console").option("truncate", False)


def load_files(spark: SparkSession, wanted: DataFrame, folder: str) -> DataFrame:
    """``wanted(file, mimetype)`` with the bytes of ``folder/<file>``, null where there is none."""
    files = spark.read.format("binaryFile").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content").alias("bytes")
    )
    return wanted.join(files, "file", "left")
