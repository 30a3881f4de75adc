"""MinHash near-deduplication with odd sketches.

A document's set is its distinct k-word shingles (A-Z lower-cased).  Two documents
are linked when ``100 * |A & B| >= percent * |A | B|``.  The steps:

1.  signature: ``samples`` MinHash values a document; the first ``bands * rows`` of
    them give ``bands`` band keys, all of them are folded into a parity bitmap, the
    odd sketch, which bit ``h(i, minhash_i)`` toggles.  Documents with equal sets are
    one class, stood for by the least ``doc_id``; only representatives go on.
2.  banding: representatives that share a band key meet.  XOR population counts of the odd
    sketches estimate the similarity; pairs estimated at ``floor`` or more are joined to a
    forest, of which at most one edge a member leaves the task.
3.  groups: connected components of these edges.  All links lie inside a group.
4.  confirmation: the full shingle sets of grouped representatives are compared exactly;
    again a forest of confirmed links leaves the task.  Components of the confirmed links
    are the answer, spread over classes.

A bucket or group of up to ``BLOCK`` members is compared at once.  A larger one is dealt to
blocks, all of which first meet ``CENTRES`` of its members: those of the centres that hang
together are its core, and members linked to the core are in one component with it, so
pairs of them need no look.  The other members then meet all, in pairs of blocks.  No task
holds a whole hot bucket, and a large group of near copies takes linear work.

Nothing is capped.  What can be missed is a link at the threshold that shares no band
(probability ``(1 - 0.8**4)**24`` = 3e-6) or that the sketch estimates below ``floor``
(more than five standard errors).

Defined results: null or blank text has the empty set, is linked with nothing and is
its own component; a null ``doc_id`` takes part in nothing and is returned as kept with
a null component; rows that repeat a ``doc_id`` share that identifier's component (with
different texts, the component links through both).  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, cut_narrow, drop, meet, mix, shingle_set, tidy
from .components import Forest, components

K, PERCENT = 4, 80
BANDS, ROWS, SAMPLES, BITS = 24, 4, 256, 512
FLOOR = 0.62
BLOCK, CENTRES = 512, 8

_SIGNATURE = "doc_id long, n_shingles long, class binary, sketch binary, bands array<long>"


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def minhash(shingles: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """``samples`` minima of affine maps modulo 2**32 of the shingle hashes."""
    a, b = _multipliers(samples)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(samples, np.uint32(0xFFFFFFFF))
    for i in range(0, len(low), 2048):
        part = low[i : i + 2048]
        table = a[:, None] * part[None, :]
        table += b[:, None]
        table ^= table >> np.uint32(15)
        np.minimum(best, table.min(axis=1), out=best)
    return best


def odd_sketch(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity bitmap (``bits // 64`` words): bit h(i, sample_i) is toggled for each i."""
    n = np.arange(len(samples), dtype=np.uint64)
    at = mix(samples.astype(np.uint64) | (n << np.uint64(32))) % np.uint64(bits)
    odd = (np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def estimate(differing: np.ndarray, samples: int = SAMPLES, bits: int = BITS) -> np.ndarray:
    """Similarity from the number of differing sketch bits."""
    share = np.minimum(differing / bits, 0.4999)
    return 1 + bits / (4 * samples) * np.log1p(-2 * share)


def most_bits(floor: float, samples: int = SAMPLES, bits: int = BITS) -> int:
    """The largest number of differing bits whose estimate is ``floor`` or more."""
    return int(np.flatnonzero(estimate(np.arange(bits // 2), samples, bits) >= floor)[-1])


def _signatures(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    salt = mix(np.arange(bands, dtype=np.uint64) + np.uint64(77))
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            s, digest = shingle_set(text.as_py(), k)
            keys: list | None = None
            sketch = b""
            if len(s):
                sig = minhash(s)
                sketch = odd_sketch(sig).tobytes()
                key = salt.copy()
                for j in range(rows):
                    key = mix(key * np.uint64(0x100000001B3) ^ sig[j : bands * rows : rows].astype(np.uint64))
                keys = key.view(np.int64).tolist()
            for col, v in zip(out, (doc_id, len(s), digest, sketch, keys)):
                col.append(v)
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "n_shingles", "class", "sketch", "bands"])


def signatures(docs: DataFrame, k: int = K, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Set size, digest of the set, odd sketch and band keys of every document."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda it: tidy(_signatures(it, k, bands, rows)), _SIGNATURE
    )


def _runs(batches: Iterator[pa.RecordBatch], n_key: int) -> Iterator[pa.Table]:
    """Tables of rows with equal key columns, out of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(i)) for i in range(n_key)]
        change = np.zeros(batch.num_rows, bool)
        for c in keys:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in keys)
        change[0] = last is not None and first != last
        cuts = np.flatnonzero(change).tolist()
        at = 0
        for c in cuts:
            if c > at:
                held.append(batch.slice(at, c - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], c
        held.append(batch.slice(at))
        last = tuple(c[-1] for c in keys)
    if held:
        yield pa.Table.from_batches(held)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def _forest_of(similar: Iterator[tuple[np.ndarray, np.ndarray]], ids: np.ndarray) -> list[tuple[int, int]]:
    forest, out = Forest(), []
    for i, j in similar:
        for x, y in zip(ids[i].tolist(), ids[j].tolist()):
            if forest.join(x, y):
                out.append((x, y))
    return out


Compare = Callable[[list[bytes], list[bytes]], np.ndarray]


def _core(linked: np.ndarray) -> list[int]:
    """Of the largest set of members that hang together, each one's neighbour on the way to
    the first of them, itself for the first; -1 for the others."""
    best: list[int] = [-1] * len(linked)
    seen: set[int] = set()
    for root in range(len(linked)):
        if root in seen:
            continue
        via, todo = {root: root}, [root]
        for x in todo:
            for y in np.flatnonzero(linked[x]).tolist():
                if y not in via:
                    via[y] = x
                    todo.append(y)
        seen |= set(via)
        if len(via) > sum(x >= 0 for x in best):
            best = [via.get(i, -1) for i in range(len(linked))]
    return best


def _meet_core(batches: Iterator[pa.RecordBatch], compare: Compare) -> Iterator[pa.RecordBatch]:
    """For each member of a block (side 1) a member of the core it is linked to, or null; the
    rows of side 0 are the group's centres."""
    for run in _runs(batches, 2):
        ids, side = np.asarray(run.column("doc_id")), np.asarray(run.column("side"))
        held = run.column("payload").to_pylist()
        centres, rows = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        centres = centres[np.argsort(ids[centres])]
        payloads = [held[i] for i in centres]
        via = _core(compare(payloads, payloads))
        core = [i for i, v in enumerate(via) if v >= 0]
        up = {int(ids[centres[i]]): int(ids[centres[via[i]]]) for i in core}
        found: list[int | None] = []
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            linked = compare([held[i] for i in part], [payloads[i] for i in core])
            first = linked.argmax(axis=1)
            hit = linked.any(axis=1)
            found += [up.get(d, int(ids[centres[core[f]]]) if h else None) for d, f, h in zip(ids[part].tolist(), first.tolist(), hit.tolist())]
        yield pa.RecordBatch.from_arrays(
            [run.column("key").combine_chunks().take(pa.array(rows)), pa.array(ids[rows]), pa.array(found, pa.int64())], names=["key", "a", "b"]
        )


def _meet_all(batches: Iterator[pa.RecordBatch], compare: Compare) -> Iterator[pa.RecordBatch]:
    """Forest of the links of each unit: of its members with each other, or of side 0 with side 1."""
    out: list[tuple[int, int]] = []
    for run in _runs(batches, 3):
        if run.num_rows < 2:
            continue
        ids, side = np.asarray(run.column("doc_id")), np.asarray(run.column("side"))
        held = run.column("payload").to_pylist()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(right)
        if same:
            right = left

        def similar():
            for at in range(0, len(left), 128):
                rows = left[at : at + 128]
                i, j = np.nonzero(compare([held[x] for x in rows], [held[x] for x in right]))
                i, j = rows[i], right[j]
                keep = i < j if same else ids[i] != ids[j]
                yield i[keep], j[keep]

        out += _forest_of(similar(), ids)
        if len(out) > 50_000:
            yield _edges(out)
            out = []
    yield _edges(out)


def linked(few: DataFrame, many: DataFrame, compare: Compare) -> DataFrame:
    """``a, b``: a forest of the links inside every key.

    Both tables have ``key, n`` (how many members the key has), ``doc_id, payload``: ``few`` the
    keys of up to ``BLOCK`` members, ``many`` the others.  ``compare`` gives the matrix of links
    between two lists of payloads.
    """
    blocks, block = F.ceil(F.col("n") / F.lit(float(BLOCK))).cast("int"), F.xxhash64("doc_id")
    zero = F.lit(0)
    large = cut(many.withColumn("mine", F.pmod(block, blocks).cast("int")), "large")
    order = Window.partitionBy("key").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")
    centres = large.withColumn("r", F.row_number().over(order)).where(F.col("r") <= CENTRES)
    spread = centres.select("key", F.explode(F.sequence(zero, blocks - 1)).alias("mine"), zero.alias("side"), "doc_id", "payload")
    met = spread.unionByName(large.select("key", "mine", F.lit(1).alias("side"), "doc_id", "payload"))
    star = cut(
        met.repartition("key", "mine").sortWithinPartitions("key", "mine", "side").mapInArrow(
            lambda it: tidy(_meet_core(it, compare)), "key long, a long, b long"
        ),
        "star",
    )
    rest = star.where("b is null").select("key", F.col("a").alias("doc_id"))
    # a row for each large key
    sizes = rest.groupBy("key").agg(F.count(F.lit(1)).alias("others")).join(large.groupBy("key").agg(F.max("n").alias("n")), "key")
    both = meet(large.drop("n"), sizes, "key")
    other_blocks = F.ceil(F.col("others") / F.lit(float(BLOCK))).cast("int")
    everyone = both.select("key", F.explode(F.sequence(zero, other_blocks - 1)).alias("lo"), F.col("mine").alias("hi"), F.lit(1).alias("side"), "doc_id", "payload")
    others = both.join(rest, ["key", "doc_id"], "left_semi").select(
        "key", F.pmod(block, other_blocks).cast("int").alias("lo"), F.explode(F.sequence(zero, blocks - 1)).alias("hi"), zero.alias("side"), "doc_id", "payload"
    )
    small = few.select("key", zero.alias("lo"), zero.alias("hi"), zero.alias("side"), "doc_id", "payload")
    units = small.unionByName(everyone).unionByName(others)
    found = units.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "side").mapInArrow(
        lambda it: tidy(_meet_all(it, compare)), "a long, b long"
    )
    return found.unionAll(star.where("b is not null").select("a", "b"))


def candidate_edges(reps: DataFrame, floor: float = FLOOR) -> DataFrame:
    """``a, b``: a forest of the sketch-similar pairs of every band bucket."""
    dealt = reps.select("doc_id", F.explode("bands").alias("key")).repartition("key")  # keys differ by band
    counts = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = dealt.join(counts, "key").select("doc_id", "key", "n")
    limit = most_bits(floor)

    def compare(left: list[bytes], right: list[bytes]) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(v), np.uint64).reshape(len(v), -1) for v in (left, right))
        return np.bitwise_count(x[:, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64) <= limit

    members = met.join(reps.select("doc_id", F.col("sketch").alias("payload")), "doc_id")
    return linked(members.where(F.col("n") <= BLOCK), members.where(F.col("n") > BLOCK), compare)


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of all left with all right sets.

    Shingles found on both sides become columns of 0/1 matrices, multiplied in chunks.
    """
    lv = np.concatenate([sets[i] for i in left])
    rv = np.concatenate([sets[i] for i in right])
    both = np.intersect1d(lv, rv)
    out = np.zeros((len(left), len(right)), np.float32)

    def places(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        col, row = [], []
        for r, i in enumerate(rows):
            at = np.searchsorted(both, sets[i])
            at[at == len(both)] = 0
            hit = at[both[at] == sets[i]] if len(both) else at[:0]
            col.append(hit)
            row.append(np.full(len(hit), r))
        return np.concatenate(col), np.concatenate(row)

    lc, lr = places(left)
    rc, rr = places(right)
    lo, ro = np.argsort(lc, kind="stable"), np.argsort(rc, kind="stable")
    lc, lr, rc, rr = lc[lo], lr[lo], rc[ro], rr[ro]
    step = 4096
    for at in range(0, len(both), step):
        a = np.zeros((len(left), step), np.float32)
        b = np.zeros((len(right), step), np.float32)
        s, e = np.searchsorted(lc, [at, at + step])
        a[lr[s:e], lc[s:e] - at] = 1
        s, e = np.searchsorted(rc, [at, at + step])
        b[rr[s:e], rc[s:e] - at] = 1
        out += a @ b.T
    return out


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [shingle_set(t.as_py(), k)[0].tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), batch.column(3), pa.array(packed, pa.binary())], names=["doc_id", "key", "n", "payload"]
        )


def confirmed_edges(docs: DataFrame, groups: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """``a, b``: a forest of the links, confirmed on the full sets, of every group."""
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    sized = meet(groups, sizes, "component").select(F.col("vertex").alias("doc_id"), F.col("component").alias("key"), "n")
    texts = docs.select(F.col("doc_id").cast("long"), "text")

    def sets(of: DataFrame) -> DataFrame:
        # always a merge join: a plan that broadcasts small groups only would change with size
        met = texts.join(of.hint("merge"), "doc_id").select("doc_id", "text", "key", "n")
        return met.mapInArrow(lambda it: tidy(_sets(it, k)), "doc_id long, key long, n long, payload binary")

    def compare(left: list[bytes], right: list[bytes]) -> np.ndarray:
        held = [np.frombuffer(v, np.uint64) for v in [*left, *right]]
        size = np.array([len(v) for v in held])
        if len(held) == 2:
            both = np.array([[len(np.intersect1d(held[0], held[1], assume_unique=True))]])
        else:
            both = _intersections(held, np.arange(len(left)), np.arange(len(left), len(held)))
        union = size[: len(left), None] + size[None, len(left) :] - both
        return 100 * both.astype(np.int64) >= percent * union.astype(np.int64)

    return linked(sets(sized.where(F.col("n") <= BLOCK)), sets(sized.where(F.col("n") > BLOCK)), compare)


def near_dedup(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``."""
    sig = cut(signatures(docs, k), "signatures")
    some = sig.where("n_shingles > 0 and doc_id is not null")
    # one representative of each class of equal sets: the row with the least doc_id
    rows = sig.count()
    lead = cut_narrow(some.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), rows, "classes")
    member = meet(some.select("doc_id", "class"), lead, "class").select("doc_id", "rep")
    # a doc_id may repeat with several texts, so each row keeps its own signature
    reps = sig.join(lead, (sig["doc_id"] == lead.rep) & (sig["class"] == lead["class"]), "left_semi")
    reps = reps.dropDuplicates(["doc_id", "class"])
    near = cut(candidate_edges(reps), "candidates")
    groups = cut_narrow(components(near), rows, "groups")
    links = confirmed_edges(docs, groups, k, percent)
    # copies hang on to their representative
    copies = member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionAll(copies))
    for table in (lead, near, groups):  # what is returned reads the signatures and the components only
        drop(table)
    out = sig.select("doc_id", "n_shingles").join(found.withColumnRenamed("vertex", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each near-duplicate group."""
    gone = near_dedup(docs, k, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
