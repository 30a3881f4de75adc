"""Edges laid out for traversal: once by source and once by target, in buckets.

A join with either end is then a join of buckets: only the frontier moves, never the edges,
however many levels a traversal has.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from .shared import remove, scratch


class Adjacency:
    """Two tables of ``edges(src_id, dst_id)``; ``near(column)`` is the one bucketed by that column."""

    def __init__(self, edges: DataFrame, buckets: int | None = None):
        self.spark = edges.sparkSession
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables, self.paths = {}, []
        pairs = edges.select("src_id", "dst_id")
        for column in ("src_id", "dst_id"):
            name, path = f"adjacency_{column}_{uuid.uuid4().hex}", scratch(self.spark, f"adjacency-{column}")
            # dealt as the buckets are, so that each is one file
            dealt = pairs.repartition(self.buckets, column)
            dealt.write.bucketBy(self.buckets, column).sortBy(column).option("path", path).saveAsTable(name)
            self.tables[column] = name
            self.paths.append(path)
            # the second copy is made from the first
            pairs = self.spark.table(name)

    def near(self, column: str) -> DataFrame:
        return self.spark.table(self.tables[column])

    @property
    def edges(self) -> DataFrame:
        return self.near("src_id")

    def drop(self) -> None:
        for name in self.tables.values():
            self.spark.sql(f"drop table if exists {name}")
        for path in self.paths:
            remove(self.spark, path)
