"""Continuous append: every micro-batch is one transaction of the store.

A batch that is replayed after a failure changes nothing, as appends are idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.schema import EDGE, MEMORY
from ..sources.store import COMMIT, Appender, Store


def append_stream(batches: DataFrame, store: Appender, checkpoint: str, **trigger) -> StreamingQuery:
    """``batches`` has the columns of :func:`causeway.operators.append.append`."""

    def write(batch: DataFrame, epoch: int) -> None:
        with store.transaction() as t:
            t.add(batch)

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def follow(store: Store, each: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, commits_per_batch: int = 100, **trigger) -> StreamingQuery:
    """The store's log as a stream: ``each(memories, edges, epoch)`` gets what every commit added, once.

    The commit files are the stream, so its checkpoint knows which commits a reader has seen.
    Only the names of a batch's versions reach the driver; an epoch that is replayed after a
    failure has the same commits.
    """
    # the folder is there from the first commit on
    log = store.spark.readStream.schema(COMMIT).option("maxFilesPerTrigger", commits_per_batch).json(f"{store.path}/published")

    def read(batch: DataFrame, epoch: int) -> None:
        versions = [v for r in batch.orderBy("n").collect() for v in r["versions"]]
        if versions:
            each(store._table("memories", MEMORY, versions), store._table("edges", EDGE, versions), epoch)

    return log.writeStream.foreachBatch(read).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
