"""Compression of vectors to codes: a codebook for each part, fitted by Elkan's variant of Lloyd's rounds.

Components become integers ``floor(SCALE * x)``, a vector is cut into ``PARTS`` equal
consecutive parts, and each part position has a codebook of ``ENTRIES`` entries, at first
those parts of the vectors of smallest ``vec_id``.  A round assigns every part to its nearest
entry and moves each entry to the floor of its parts' mean.

For each part of each vector a written table keeps the entry, an upper bound of the distance
to it, and a lower bound of the distance to *every* entry (a byte each, in steps that the
first codebook's spread sets).  When entries move, upper bounds grow by the movement of
their entry and lower bounds shrink by the movement of theirs.  An entry is passed over only
where the upper bound is strictly less than its lower bound, or strictly less than half its
distance to the present entry: it is then strictly farther away, so no tie is lost.  All
others are measured in integers, and among equal distances the lowest index wins.  Upper
bounds are rounded up and lower bounds down.

What moves between rounds are sums by entry: each task adds up its own, so at most
``ENTRIES`` numbers a dimension leave it, and the driver holds the codebooks alone.

Defined results: rows whose vector is null or holds a null or non-finite component are
dropped; repeated rows count each.  Rows without ``vec_id`` are coded, and come last where
the smallest are taken; of one ``vec_id`` the vector first by its packed bytes comes first.
With fewer rows than entries there are as many entries as rows.  Vectors of different lengths
have codebooks of their own; where a length can't be cut evenly, part p has the components
from ``p * length // PARTS`` on.  Components must stay below 2**20, as distances are held in
64 bits; larger ones raise an error.  Extra columns are ignored; ``label`` may be absent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, meet, tidy

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Vectors looked at in one go.
STEP = 1024


def bounds_of(dims: int, parts: int = PARTS) -> list[tuple[int, int]]:
    at = [p * dims // parts for p in range(parts + 1)]
    return list(zip(at, at[1:]))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all of ``c``, exact, as int64."""
    if not x.shape[1]:
        return np.zeros((len(x), len(c)), np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:  # every step is an exact double
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def above(square: np.ndarray) -> np.ndarray:
    """Square roots, rounded up."""
    return np.where(square > 0, np.nextafter(np.sqrt(square.astype(np.float64)), np.inf), 0.0)


def below(square: np.ndarray) -> np.ndarray:
    return np.where(square > 0, np.nextafter(np.sqrt(square.astype(np.float64)), 0.0), 0.0)


class Codebook:
    """Entries (k, dims) of one length of vectors, how far they have moved, and the steps of the lower bounds."""

    def __init__(self, entries: np.ndarray, parts: int = PARTS, before: Codebook | None = None):
        self.entries, self.at = entries, bounds_of(entries.shape[1], parts)
        between = [squared(entries[:, a:b], entries[:, a:b]) for a, b in self.at]
        #: A byte of a lower bound stands for so much.
        self.steps = before.steps if before else [max(1, -(-int(np.sqrt(d.max(initial=0))) * 2 // 255)) for d in between]
        self.half = [below(d) / 2 for d in between]
        far = [h + np.diag(np.full(len(h), np.inf)) for h in self.half]
        #: Half the distance to the nearest other entry.
        self.nearest = [f.min(axis=1, initial=np.inf) for f in far]
        self.moved = [above(((entries[:, a:b] - before.entries[:, a:b]) ** 2).sum(axis=1)) for a, b in self.at] if before else None

    def packed_bound(self, square: np.ndarray, p: int) -> np.ndarray:
        return np.minimum(255, np.floor(below(square) / self.steps[p])).astype(np.uint8)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, upper, lower) of vectors, by all distances."""
        n, parts = len(x), len(self.at)
        code, upper = np.zeros((n, parts), np.uint8), np.zeros((n, parts))
        lower = np.zeros((n, parts, len(self.entries)), np.uint8)
        for p, (a, b) in enumerate(self.at):
            d = squared(x[:, a:b], self.entries[:, a:b])
            code[:, p] = d.argmin(axis=1)  # the lowest index of equal ones
            upper[:, p] = above(d.min(axis=1))
            lower[:, p] = self.packed_bound(d, p)
        return code, upper, lower

    def again(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Assign anew after the entries have moved, in place; the number of distances measured."""
        measured = 0
        for p, (a, b) in enumerate(self.at):
            mine, c = x[:, a:b], self.entries[:, a:b]
            u = np.nextafter(upper[:, p] + self.moved[p][code[:, p]], np.inf)
            shrink = np.ceil(self.moved[p] / self.steps[p])
            lower[:, p] = np.maximum(lower[:, p] - shrink, 0).astype(np.uint8)
            doubt = np.flatnonzero(u >= self.nearest[p][code[:, p]])
            for tight in (False, True):
                at = code[doubt, p].astype(np.int64)
                open_ = (u[doubt, None] >= lower[doubt, p] * float(self.steps[p])) & (u[doubt, None] >= self.half[p][at])
                open_[np.arange(len(doubt)), at] = False
                some = open_.any(axis=1)
                doubt, open_ = doubt[some], open_[some]
                if not tight:  # the distance itself may close the rest
                    own = ((mine[doubt] - c[code[doubt, p]]) ** 2).sum(axis=1)
                    u[doubt] = above(own)
                    measured += len(doubt)
            if len(doubt):
                at = code[doubt, p].astype(np.int64)
                row, entry = np.nonzero(open_)
                found = ((mine[doubt[row]] - c[entry]) ** 2).sum(axis=1)
                measured += len(row)
                all_of = np.full(open_.shape, np.iinfo(np.int64).max)
                all_of[row, entry] = found
                all_of[np.arange(len(doubt)), at] = ((mine[doubt] - c[at]) ** 2).sum(axis=1)
                best = all_of.argmin(axis=1)
                lower[doubt[row], p, entry] = self.packed_bound(found, p)
                lower[doubt, p, at] = self.packed_bound(all_of[np.arange(len(doubt)), at], p)
                u[doubt] = above(all_of[np.arange(len(doubt)), best])
                code[doubt, p] = best
            upper[:, p] = u
        return measured

    def errors(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Squared distance of each vector to its entries, summed over parts."""
        total = np.zeros(len(x), np.int64)
        for p, (a, b) in enumerate(self.at):
            total += ((x[:, a:b] - self.entries[code[:, p], a:b]) ** 2).sum(axis=1)
        return total

    def digest(self) -> str:
        text = ",".join(str(v) for a, b in self.at for entry in self.entries[:, a:b].tolist() for v in entry)
        return hashlib.sha256(text.encode()).hexdigest()


def _pack(x: np.ndarray) -> bytes:
    return (x.astype(np.int16) if np.abs(x).max(initial=0) < 1 << 15 else x.astype(np.int32)).tobytes()


def _matrix(packed: list[bytes], dims: int) -> np.ndarray:
    if all(len(v) == 2 * dims for v in packed):
        return np.frombuffer(b"".join(packed), np.int16).reshape(len(packed), dims).astype(np.int64)
    return np.array([np.frombuffer(v, np.int16 if len(v) == 2 * dims else np.int32) for v in packed], np.int64).reshape(len(packed), dims)


def _prepare(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, packed, dims = [], [], []
        for i, v in enumerate(batch.column(2)):
            if not v.is_valid or v.values.null_count:
                continue
            x = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
            if np.isfinite(x).all():
                if np.abs(x).max(initial=0) >= scale << 20:
                    raise ValueError("components of 2**20 or more are too large to code")
                keep.append(i)
                packed.append(_pack(x))
                dims.append(len(x))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())), pa.array(packed, pa.binary()), pa.array(dims, pa.int32())],
            names=["vec_id", "label", "vec", "dims"],
        )


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of at most ``STEP`` rows of one length."""
    dims = batch.column("dims").to_numpy()
    for d in np.unique(dims):
        rows = batch.take(pa.array(np.flatnonzero(dims == d)))
        for at in range(0, rows.num_rows, STEP):
            yield int(d), rows.slice(at, STEP)


_STATE = ["vec_id", "label", "vec", "dims", "code", "upper", "lower"]


def _held(rows: pa.RecordBatch, dims: int, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, parts, k = rows.num_rows, len(book.at), len(book.entries)
    column = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
    return (
        _matrix(rows.column("vec").to_pylist(), dims), column("code", np.uint8).reshape(n, parts).copy(),
        column("upper", np.float64).reshape(n, parts).copy(), column("lower", np.uint8).reshape(n, parts, k).copy(),
    )


def _assign(batches: Iterator[pa.RecordBatch], books) -> Iterator[pa.RecordBatch]:
    """The state after an assignment: by all distances at first, then by the bounds that the rows bring."""
    for batch in batches:
        for dims, rows in _by_length(batch):
            book: Codebook = books.value[dims]
            if book.moved is None:
                x = _matrix(rows.column("vec").to_pylist(), dims)
                code, upper, lower = book.first(x)
            else:
                x, code, upper, lower = _held(rows, dims, book)
                book.again(x, code, upper, lower)
            new = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (code, upper, lower)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in _STATE[:4]), *new], names=_STATE)


def _finish(batches: Iterator[pa.RecordBatch], books) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dims, rows in _by_length(batch):
            book: Codebook = books.value[dims]
            x, code, upper, lower = _held(rows, dims, book)
            book.again(x, code, upper, lower)
            yield pa.RecordBatch.from_arrays(
                [rows.column("vec_id"), rows.column("label"), rows.column("dims"), pa.array([c.tobytes().hex() for c in code]), pa.array(book.errors(x, code), pa.int64())],
                names=["vec_id", "label", "dims", "code", "error"],
            )


def _sums(batches: Iterator[pa.RecordBatch], books) -> Iterator[pa.RecordBatch]:
    """Counts and sums of the parts of each entry in a task."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for dims, rows in _by_length(batch):
            book: Codebook = books.value[dims]
            k, parts = len(book.entries), len(book.at)
            n, total = held.setdefault(dims, (np.zeros((k, parts), np.int64), np.zeros((k, dims), np.int64)))
            x = _matrix(rows.column("vec").to_pylist(), dims)
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(x), parts)
            for p, (a, b) in enumerate(book.at):
                n[:, p] += np.bincount(code[:, p], minlength=k)
                np.add.at(total[:, a:b], code[:, p], x[:, a:b])
    out: list[list] = [[], [], [], [], []]
    for dims, (n, total) in held.items():
        for p, (a, b) in enumerate(bounds_of(dims, n.shape[1])):
            for entry in np.flatnonzero(n[:, p]).tolist():
                for c, v in zip(out, (dims, p, entry, int(n[entry, p]), total[entry, a:b].tolist())):
                    c.append(v)
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["dims", "part", "entry", "n", "total"])


def _moved(state: DataFrame, books, parts: int) -> dict[int, Codebook]:
    """The codebooks after one replacement; unused entries stay."""
    each = state.select("vec", "dims", "code").mapInArrow(lambda it: tidy(_sums(it, books)), "dims int, part int, entry int, n long, total array<long>")
    # outer, so that entries of parts without components count too
    wide = each.select("dims", "part", "entry", "n", F.posexplode("total").alias("i", "x"))
    out = {d: b.entries.copy() for d, b in books.value.items()}
    for r in wide.groupBy("dims", "part", "entry", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
        a, _ = bounds_of(r["dims"], parts)[r["part"]]
        out[r["dims"]][r["entry"], a + r["i"]] = r["x"] // r["n"]
    return {d: Codebook(e, parts, books.value[d]) for d, e in out.items()}


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, dict[int, Codebook]]:
    """``vec_id, label, dims, code, error`` of every vector, and the final codebook of each length.

    ``code`` has two hexadecimal digits a part; ``error`` is the squared distance, summed over parts.
    """
    if not 1 <= entries <= 256 or rounds < 1:
        raise ValueError("a code has one byte a part: 1 to 256 entries, and a round or more")
    spark = vectors.sparkSession
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label, F.col("embedding").cast("array<double>"))
    kind = rows.schema["label"].dataType.simpleString()
    ready = cut(rows.mapInArrow(lambda it: tidy(_prepare(it, scale)), f"vec_id long, label {kind}, vec binary, dims int"), "vectors")
    books = {}
    for d in sorted(r["dims"] for r in ready.select("dims").distinct().collect()):  # a row for each length
        first = ready.where(F.col("dims") == d).orderBy(F.asc_nulls_last("vec_id"), "vec").select("vec").limit(entries).collect()
        books[d] = Codebook(_matrix([bytes(r["vec"]) for r in first], d), parts)
    shape = f"vec_id long, label {kind}, vec binary, dims int, code binary, upper binary, lower binary"
    state = ready
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(books)
        after = cut(state.mapInArrow(lambda it, b=now: tidy(_assign(it, b)), shape), "state")
        drop(state)
        state, books = after, _moved(after, now, parts)
    last = spark.sparkContext.broadcast(books)
    out = cut(state.mapInArrow(lambda it: tidy(_finish(it, last)), f"vec_id long, label {kind}, dims int, code string, error long"), "codes")
    drop(state)
    return out, books


def op12_query(vectors: DataFrame) -> DataFrame:
    coded, books = compress(vectors)
    digests = [F.when(F.col("dims") == d, F.lit(b.digest())) for d, b in books.items()]
    # a text for each label, in which null differs from all others
    rows = coded.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error"))
    return meet(rows, sums, "_key").select(
        "vec_id", "code", "error", "label_error", (F.coalesce(*digests) if digests else F.lit(None).cast("string")).alias("codebooks_sha256")
    )


def _sql() -> str:
    """Two rounds over parts as rows; a distance and an entry in one number give the lowest index of equal ones."""
    near = """a{0} as (select x.vec_id, x.rn, x.part, min(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint * 64 + c.entry) as best
  from x join c{0} c on c.part = x.part group by all),
"""
    move = """c{1} as (select c.part, c.entry, coalesce(m.v, c.v) as v from c{0} c left join (
    select part, entry, list(floor(s / n)::bigint order by i) as v from (
      select x.part, a.best % 64 as entry, i, sum(x.v[i])::double as s, count(*) as n from x join a{0} a on a.rn = x.rn and a.part = x.part, range(1, 5) r(i) group by all) group by all) m
  on m.part = c.part and m.entry = c.entry),
"""
    return (
        """with k as (select vec_id, label, row_number() over (order by vec_id) as rn, list_transform(embedding, lambda y: floor(256 * y::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
x as (select vec_id, rn, p as part, e[p * 4 + 1 : p * 4 + 4] as v from k, range(16) r(p)),
c0 as (select part, rn - 1 as entry, v from x where rn <= 64),
"""
        + near.format(0) + move.format(0, 1) + near.format(1) + move.format(1, 2) + near.format(2)
        + """f as (select rn, vec_id, string_agg(lpad(format('{:x}', best % 64), 2, '0'), '' order by part) as code, sum(best // 64)::bigint as error from a2 group by rn, vec_id),
s as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256 from c2)
select f.vec_id, f.code, f.error, (sum(f.error) over (partition by k.label))::bigint as label_error, s.codebooks_sha256 from f join k using (rn), s"""
    )


#: For vectors of 64 components, as the tables have them.
ORACLE_SQL = _sql()
