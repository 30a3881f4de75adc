"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in a seeded hash order, are cut into blocks of ``block_rows``.
Weights that are given are taken as the exact fractions their decimals stand for; weights
by size are whole units of 1/``PERIOD`` by largest remainders, at least one each.  A source
of weight w releases its j-th block at slot floor(j / w) with deadline ceil((j + 1) / w); in
every slot the released block with the earliest deadline goes out.  On one stream this meets
all deadlines, so after any t slots a source has had less than one block more or less than
w * t.

The schedule repeats after as many slots as the weights' common denominator, so only one
period is laid out on the driver (or the phase, if that is shorter), and every document finds
its slot by arithmetic.  When a source has no block left, a new phase starts with the weights
of the others scaled up: nothing is dropped, and the bound holds inside each phase.

The driver lays out up to ``MAX_SOURCES`` sources.  With more, windows and earliest deadline
first run on Spark (:mod:`.edf`): there the schedule has no period, weights by size are whole
units of 1 / ``UNITS``, and given weights keep 40 bits after the heaviest.  The bound is the same.

Ranks inside a source are found without bringing a source together: its rows are dealt by
hash to sub-buckets of about ``SUB_ROWS``, counted, and ranked inside each sub-bucket on top
of the sum of the sub-buckets before it.

Defined results: a null source is a source of its own; rows that repeat a ``doc_id`` are
separate documents; a null ``doc_id`` takes a fixed place in the hash order; weights for
absent sources are ignored, sources without a weight get the least positive one; an empty
table gives an empty result.  Other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from fractions import Fraction
from math import gcd, lcm

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import edf

BLOCK_ROWS, PERIOD, MAX_SOURCES, SUB_ROWS, UNITS = 16, 1000, 512, 1500, 1024
TEMPERATURE = 0.7


def units(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole shares of ``period`` by largest remainders, at least 1 each."""
    total = sum(weights.values())
    exact = {k: period * w / total for k, w in weights.items()}
    out = {k: max(1, int(x)) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: max(0, period - sum(out.values()))]:
        out[k] += 1
    # what the least ones got is taken where it is missed least
    for _ in range(sum(out.values()) - period):
        out[max((k for k in out if out[k] > 1), key=lambda k: (out[k] - exact[k], k))] -= 1
    return out


def fractions(weights: Mapping[str, float | Fraction]) -> dict[str, int]:
    """The least whole numbers that stand as the weights do, decimals taken at their word."""
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    scale = lcm(*(w.denominator for w in exact.values()))
    whole = {k: int(w * scale) for k, w in exact.items()}
    common = gcd(*whole.values())
    return {k: n // common for k, n in whole.items()}


def lay_out(shares: Mapping[str, int], left: Mapping[str, int] | None = None) -> list[str]:
    """The source of every slot of one period: earliest deadline first among released blocks.

    With ``left`` it ends before the first slot of a source that has no block left.
    """
    period = sum(shares.values())
    waiting = [(0, k, 0) for k in sorted(shares)]  # (release, source, index of block)
    ready: list[tuple[int, str, int]] = []
    slots = []
    heapq.heapify(waiting)
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // shares[k]), k, j))
        _, k, j = heapq.heappop(ready)
        if left is not None and j >= left[k]:
            break
        slots.append(k)
        if j + 1 < shares[k]:
            heapq.heappush(waiting, ((j + 1) * period // shares[k], k, j + 1))
    return slots


def phases(blocks: Mapping[str, int], weights: Mapping[str, float | Fraction], period: int | None = PERIOD) -> list[dict]:
    """Phases until all blocks are out: for each source its share, offsets in the period,
    first block and number of blocks; ``start`` is the phase's first slot.  Weights are
    rounded to ``period``, or exact if it is None."""
    left = {k: n for k, n in blocks.items() if n > 0}
    used = dict.fromkeys(left, 0)
    out, start = [], 0
    while left:
        now = {k: weights[k] for k in left}
        shares = fractions(now) if period is None else units(now, max(period, 10 * len(left)))
        total = sum(shares.values())
        short = period is None and total > sum(left.values())
        slots = lay_out(shares, left if short else None)
        at: dict[str, list[int]] = {k: [] for k in left}
        for t, k in enumerate(slots):
            at[k].append(t)
        # the phase ends where a source would need a block that it doesn't have
        length = len(slots) if short else min(n // shares[k] * total + at[k][n % shares[k]] for k, n in left.items())
        took = {k: length // total * shares[k] + sum(t < length % total for t in at[k]) for k in left}
        out.append({"start": start, "period": total, "share": shares, "at": at, "first": {k: used[k] for k in left}, "took": took})
        start += length
        used = {k: used[k] + took[k] for k in left}
        left = {k: n - took[k] for k, n in left.items() if n > took[k]}
    return out


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = BLOCK_ROWS,
    period: int = PERIOD, temperature: float = TEMPERATURE, seed: int = 17,
) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``) with ``mix_source, phase, block, slot, position``.

    ``position`` orders the mixture.  Without ``weights`` a source of n documents weighs
    n ** temperature in units of 1 / ``period``.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.concat(F.lit("s:"), docs["source"].cast("string")), F.lit("null")).alias("name"),
        F.xxhash64(docs["doc_id"].cast("string"), F.lit(seed)).alias("dice"),
    )
    counted = rows.groupBy("name").count()
    if weights is None:
        weighed = counted.withColumn("weight", F.pow("count", F.lit(temperature)))
    else:
        given = {"null" if k is None else f"s:{k}": float(w) for k, w in weights.items() if float(w) > 0}
        least = min(given.values(), default=1.0)
        known = spark.createDataFrame(list(given.items()), "name string, weight double")
        weighed = counted.join(known, "name", "left").withColumn("weight", F.coalesce("weight", F.lit(least)))
    top = weighed.orderBy(F.desc("weight"), F.desc("count"), "name").limit(MAX_SOURCES + 1).collect()
    if not top:
        schema = f"row {rows.schema['row'].dataType.simpleString()}, mix_source string, phase int, block long, slot long, position long"
        return spark.createDataFrame([], schema)
    if len(top) > MAX_SOURCES:
        return mix_many(rows, counted, given if weights is not None else None, block_rows, temperature)
    total = {r["name"]: r["count"] for r in top}
    blocks = {k: -(-n // block_rows) for k, n in total.items()}
    target = {r["name"]: r["weight"] if weights is None else Fraction(str(r["weight"])) for r in top}
    plan = phases(blocks, target, period if weights is None else None)
    spans = [
        (k, i, p["start"], p["period"], p["first"][k], p["took"][k], p["at"][k])
        for i, p in enumerate(plan) for k in p["at"] if p["took"][k]
    ]
    spans_df = spark.createDataFrame(
        spans, "track string, phase int, start long, period long, first long, took long, at array<int>"
    )
    sizes = spark.createDataFrame([(k, -(-n // SUB_ROWS)) for k, n in total.items()], "name string, subs long")

    # sizes has at most MAX_SOURCES sources, spans a period's slots for each phase
    blocked = _blocked(rows.join(F.broadcast(sizes), "name"), block_rows)
    blocked = blocked.withColumn("track", F.col("mix_source")).withColumn("turn", F.col("block"))
    there = (F.col("turn") >= F.col("first")) & (F.col("turn") < F.col("first") + F.col("took"))
    out = blocked.join(F.broadcast(spans_df), "track").where(there)
    j = F.col("turn") - F.col("first")
    share = F.size("at")
    slot = F.col("start") + F.floor(j / share) * F.col("period") + F.element_at("at", (j % share + 1).cast("int"))
    return out.withColumn("slot", slot.cast("long")).select(
        "row", "mix_source", "phase", "block", "slot", (F.col("slot") * block_rows + F.col("within")).cast("long").alias("position")
    )


def _blocked(sized: DataFrame, block_rows: int) -> DataFrame:
    """Rows with ``mix_source, block, within`` by their rank in the hash order of their source; ``subs`` is how many
    sub-buckets the source has."""
    dealt = sized.withColumnRenamed("name", "mix_source").withColumn("sub", F.pmod(F.xxhash64("dice"), F.col("subs")))
    subs = dealt.groupBy("mix_source", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("mix_source").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = subs.select("mix_source", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("mix_source", "sub").orderBy("dice")
    ranked = dealt.withColumn("rank", F.row_number().over(inside)).join(offsets, ["mix_source", "sub"])
    place = F.col("offset") + F.col("rank") - 1
    return ranked.withColumn("block", F.floor(place / block_rows).cast("long")).withColumn("within", place % block_rows)


def whole_weights(given: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers that stand as the weights do; exact if the heaviest then has no more than 40 bits."""
    whole = fractions(given)
    most = max(whole.values(), default=1)
    return whole if most < 1 << 40 else {k: max(1, round(Fraction(n << 40, most))) for k, n in whole.items()}


def mix_many(rows: DataFrame, counted: DataFrame, given: Mapping[str, float] | None, block_rows: int, temperature: float) -> DataFrame:
    """:func:`mix` for sources of any number; none of their lists reaches the driver."""
    if given is None:
        weighed = counted.withColumn("weight", F.greatest(F.lit(1), F.round(F.pow("count", F.lit(temperature)) * UNITS)).cast("long"))
    else:
        whole = whole_weights(given)
        known = rows.sparkSession.createDataFrame(list(whole.items()), "name string, weight long")
        weighed = counted.join(known, "name", "left").withColumn("weight", F.coalesce("weight", F.lit(min(whole.values(), default=1))))
    sources = edf.cut(weighed.select("name", F.ceil(F.col("count") / block_rows).cast("long").alias("blocks"), "weight", F.ceil(F.col("count") / SUB_ROWS).cast("long").alias("subs")), "mix-sources")
    slots = edf.schedule(edf.windows(sources)).select(F.col("name").alias("mix_source"), "block", "slot", F.col("phase").cast("int").alias("phase"))
    # a block has at most block_rows rows; the sources' table is joined as its size tells
    out = _blocked(rows.join(sources.select("name", "subs"), "name"), block_rows).join(slots, ["mix_source", "block"])
    return out.select("row", "mix_source", "phase", "block", "slot", (F.col("slot") * block_rows + F.col("within")).cast("long").alias("position"))


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """The columns of ``docs`` in the order of the mixture: written as files, the files are
    numbered and filled in that order.  :func:`places` reads it from such files."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = mix(docs, weights).select("row", "position").repartitionByRange(parts, "position").sortWithinPartitions("position")
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def places(docs: DataFrame) -> dict[str, Column]:
    """``mix_part`` and ``mix_row``, whose order is that of the mixture, of a table that
    :func:`mixed` gave and that was written and read again; readers deal files in another
    order than they were written in.  Nulls if ``docs`` is not read from files."""
    number = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).cast("long")
    found = {"mix_part": number(r"^part-(\d+)") * 1000 + F.coalesce(number(r"-c(\d+)"), F.lit(0)), "mix_row": F.col("_metadata.row_index")}
    try:
        docs.select(*found.values())
    except AnalysisException:
        return {name: F.lit(None).cast("long") for name in found}
    return found


def op2_query(docs: DataFrame) -> DataFrame:
    placed = mix(docs.select("doc_id", "source"))
    return placed.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "phase", "block", "slot", "position")
