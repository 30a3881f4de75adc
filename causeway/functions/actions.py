"""Actions as table functions: a Python UDTF over the rows of each key, in order.

    actions.once(events.asTable().partitionBy("user_id").orderBy("seq"))

Spark deals the rows by key and sorts them; an instance sees one key's rows one after the
other and holds a flag and a number, whatever their count.  The table has the columns
``key bigint, seq bigint, reset boolean, fire boolean``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.functions import udtf


class Once:
    """Answers the first firing, and the first after each reset, with its epoch."""

    def __init__(self) -> None:
        self.epoch, self.done = 0, False

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["reset"]:
            self.epoch, self.done = self.epoch + 1, False
        if row["fire"] and not self.done:
            self.done = True
            yield row["key"], self.epoch, row["seq"]


once = udtf(Once, returnType="key bigint, epoch bigint, seq bigint")
