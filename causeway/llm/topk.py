"""Exact top-k search by inner product with a pivot-distance index.

Vectors are quantised to ``floor(64 * x)``.  Lengthening each to the largest norm M by one
extra coordinate makes a larger inner product with a query (extra coordinate 0) the same
as a smaller distance: d(q, x)**2 = |q|**2 + M**2 - 2 q.x.  In that space

1.  pivots (and ring edges, the quantiles of the distances to each pivot) are fitted on a
    bounded sample of ``SAMPLE`` rows; every row is keyed by its nearest pivot and its ring
    of distance, an *annulus*.  Of each annulus the least and greatest distance to every
    pivot are kept, not only to its own.
2.  the triangle inequality bounds the distance from a query to an annulus from below by
    max(d(q,p) - high, low - d(q,p), 0) over all pivots p.  A query sorts the annuli by that
    bound and expands to them in rounds, each ``GROWTH`` times as many rows as the one
    before; after each round its k-th best score is its threshold, and it stops at the
    first annulus whose bound can no longer reach that.
3.  annuli of many rows are split by hash into units of about ``UNIT`` rows; queries meet
    units in blocks, and only scores that reach the threshold leave a unit, k at most.

``PIVOTS`` and ``RINGS`` are the same at every size, so at most ``PIVOTS * RINGS`` annuli
exist, whatever the data, and their spans are held by the driver and every task.  Results
are exact: bounds carry slack for rounding, ties at the threshold are kept, and ties in
score go to the smaller ``vec_id``.  How much is visited depends on the data: clustered
vectors prune well, directions at random in many dimensions hardly at all.

Defined results: vectors null, empty, or holding null or non-finite components take no part,
nor do rows without ``vec_id``.  An inner product needs equal lengths, so vectors meet those
of their own length only.  Rows with the query's ``vec_id`` are its own.  If a ``vec_id``
divisible by the step repeats, its vector (of a length) whose packed numbers come first in
the order of bytes is the query; as
candidates, each row counts.  Scores are exact while |q| |x| < 2**53.  Extra columns are
ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, tidy
from .subword import fit_in_one_task, share

K, STEP, SCALE = 20, 20, 64
SAMPLE, PIVOTS, RINGS = 10_000, 64, 8
UNIT, GROWTH = 8192, 8


def quantise(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(scale * values.astype(np.float64))


def _prepare(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, packed, dims, norms = [], [], [], []
        for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            if vec_id is None or not v.is_valid or not len(v.values):
                continue
            x = quantise(v.values.to_numpy(zero_copy_only=False), scale)
            if np.isfinite(x).all():
                ids.append(vec_id)
                packed.append((x.astype(np.int16) if np.abs(x).max() < 1 << 15 else x).tobytes())
                dims.append(len(x))
                norms.append(float(x @ x))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64())],
            names=["vec_id", "vec", "dims", "norm2"],
        )


def _matrix(packed: list[bytes], dims: int) -> np.ndarray:
    """Rows of ``dims`` numbers, packed in two bytes each, or in eight where they need it."""
    if all(len(x) == 2 * dims for x in packed):
        return np.frombuffer(b"".join(packed), np.int16).reshape(len(packed), dims).astype(np.float64)
    return np.array([np.frombuffer(x, np.int16 if len(x) == 2 * dims else np.float64) for x in packed], np.float64).reshape(len(packed), dims)


def _longer(x: np.ndarray, most: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))
    return np.concatenate([x, rest[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(0.0, square))


def fit_pivots(x: np.ndarray, pivots: int, rings: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Pivots by a few rounds of k-means from spread-out rows; ring edges (pivots, rings - 1)."""
    rng = np.random.default_rng(5)
    centre = x[rng.choice(len(x), min(pivots, len(x)), replace=False)]
    for _ in range(rounds):
        near = _distances(x, centre).argmin(axis=1)
        for p in range(len(centre)):
            if (near == p).any():
                centre[p] = x[near == p].mean(axis=0)
    d = _distances(x, centre)
    near = d.argmin(axis=1)
    cuts = np.arange(1, rings) / rings
    edges = np.array([np.quantile(d[near == p, p], cuts) if (near == p).any() else np.zeros(rings - 1) for p in range(len(centre))])
    return centre, edges.reshape(len(centre), rings - 1)


def assign(x: np.ndarray, centre: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The annulus of each lengthened row, and its distances to all pivots."""
    d = _distances(x, centre)
    near = d.argmin(axis=1)
    r = d[np.arange(len(d)), near]
    return near * (edges.shape[1] + 1) + (r[:, None] > edges[near]).sum(axis=1), d


def spans(annulus: np.ndarray, d: np.ndarray) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Rows, least and greatest distances to the pivots of each annulus."""
    return {int(a): (int((annulus == a).sum()), d[annulus == a].min(axis=0), d[annulus == a].max(axis=0)) for a in np.unique(annulus)}


def reach(q: np.ndarray, centre: np.ndarray, low: np.ndarray, high: np.ndarray, most: float) -> np.ndarray:
    """The greatest inner product that each query (row) could have in each annulus."""
    d = _distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), centre)
    out = np.empty((len(q), len(low)))
    for i, row in enumerate(d):
        away = np.maximum(row - high, low - row).max(axis=1) - 1e-6 * (1 + row.max())
        out[i] = ((q[i] @ q[i]) + most - np.maximum(0.0, away) ** 2) / 2
    return out


def _assign(batches: Iterator[pa.RecordBatch], index, dims: int) -> Iterator[pa.RecordBatch]:
    centre, edges, most = index.value
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            found, _ = assign(_longer(_matrix(part.column(1).to_pylist(), dims), most), centre, edges)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.int32())], names=["vec_id", "vec", "annulus"])


def _spans(batches: Iterator[pa.RecordBatch], index, dims: int) -> Iterator[pa.RecordBatch]:
    """The spans of the annuli in a task."""
    centre, _, most = index.value
    held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            d = _distances(_longer(_matrix(part.column(0).to_pylist(), dims), most), centre)
            for a, new in spans(part.column(1).to_numpy(), d).items():
                old = held.get(a, new)
                held[a] = (new[0] + (old[0] if a in held else 0), np.minimum(old[1], new[1]), np.maximum(old[2], new[2]))
    rows = [(a, n, lo.tolist(), hi.tolist()) for a, (n, lo, hi) in held.items()]
    columns = list(zip(*rows)) if rows else [()] * 4
    types = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["annulus", "n", "low", "high"])


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, by score and then smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _scan(batches: Iterator[pa.RecordBatch], k: int, dims: int) -> Iterator[pa.RecordBatch]:
    """The pairs that reach a query's threshold, k at most in each unit, out of rows sorted by
    (unit, kind): the vectors of a unit (kind 0), then queries (kind 1)."""
    unit = None
    ids: list[int] = []
    packed: list[bytes] = []
    vectors = id_array = None

    for batch in batches:
        names = batch.schema.names
        annulus, sub, kind, vec_id, vec, floor = (batch.column(names.index(n)).to_pylist() for n in ("annulus", "sub", "kind", "vec_id", "vec", "floor"))
        out: list[list] = [[], [], []]
        at = 0
        while at < len(kind):
            if (annulus[at], sub[at]) != unit:
                unit, ids, packed, vectors = (annulus[at], sub[at]), [], [], None
            end = at
            while end < len(kind) and end - at < 256 and kind[end] == kind[at] and (annulus[end], sub[end]) == unit:
                end += 1
            if kind[at] == 0:
                ids += vec_id[at:end]
                packed += vec[at:end]
            elif ids:
                if vectors is None:
                    vectors, id_array = _matrix(packed, dims), np.array(ids, np.int64)
                scores = _matrix(vec[at:end], dims) @ vectors.T
                for row, q, t in zip(scores, vec_id[at:end], floor[at:end]):
                    hit = np.flatnonzero((row >= t) & (id_array != q)) if t is not None else np.flatnonzero(id_array != q)
                    hit = hit[_best(id_array[hit], row[hit], k)]
                    out[0] += [q] * len(hit)
                    out[1] += row[hit].tolist()
                    out[2] += id_array[hit].tolist()
            at = end
        types = (pa.int64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["query_id", "score", "vec_id"])


def _expand(batches: Iterator[pa.RecordBatch], index, spans_of, dims: int, start: int, stop: int) -> Iterator[pa.RecordBatch]:
    """The annuli that a query visits in a round: by their greatest possible score, those
    with ``start`` rows or more before them and less than ``stop``, down to its threshold."""
    centre, _, most = index.value
    annuli, size, low, high = spans_of.value
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = part.column(1).to_pylist()
            best = reach(_matrix(rows, dims), centre, low, high, most)
            for may, vec_id, x, t in zip(best, part.column(0).to_pylist(), rows, part.column(2).to_pylist()):
                order = np.argsort(-may, kind="stable")
                before = np.cumsum(size[order]) - size[order]
                go = (before >= start) & (before < stop)
                if t is not None:
                    go &= may[order] >= t - 1e-6 * (1 + abs(t))
                found = annuli[order[go]].tolist()
                for c, v in zip(out, (found, [vec_id] * len(found), [x] * len(found), [t] * len(found))):
                    c += v
        types = (pa.int32(), pa.int64(), pa.binary(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["annulus", "vec_id", "vec", "floor"])


_RESULT = "query_id long, rank int, vec_id long, score long"


def _search(ready: DataFrame, dims: int, n: int, most: float, k: int, step: int) -> DataFrame:
    """The k best of every query among ``n`` vectors of one length, ``most`` their greatest square."""
    spark = ready.sparkSession
    sample = ready.where(share(F.col("vec_id"), F.lit(SAMPLE / n))).select("vec_id", "vec")

    def fit(held: list[tuple]) -> bytes:
        out = io.BytesIO()
        x = _longer(_matrix([v for _, v in sorted(held)], dims), most) if held else np.zeros((1, dims + 1))
        centre, edges = fit_pivots(x, PIVOTS, RINGS)
        np.savez(out, centre=centre, edges=edges)
        return out.getvalue()

    got = np.load(io.BytesIO(fit_in_one_task(sample, fit)))
    index = spark.sparkContext.broadcast((got["centre"], got["edges"], most))
    keyed = cut(ready.select("vec_id", "vec").mapInArrow(lambda it: tidy(_assign(it, index, dims)), "vec_id long, vec binary, annulus int"), "annuli")
    # at most PIVOTS * RINGS annuli a task, and as many in all
    parts = keyed.select("vec", "annulus").mapInArrow(lambda it: _spans(it, index, dims), "annulus int, n long, low array<double>, high array<double>")
    each = parts.select("annulus", "n", F.posexplode(F.arrays_zip("low", "high")).alias("p", "d"))
    each = each.groupBy("annulus", "p").agg(F.sum("n").alias("n"), F.min("d.low").alias("low"), F.max("d.high").alias("high"))
    radii = sorted(each.groupBy("annulus").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("p", "low", "high"))).alias("d")).collect())
    spans_of = spark.sparkContext.broadcast((
        np.array([r["annulus"] for r in radii]), np.array([r["n"] for r in radii]),
        np.array([[x["low"] for x in r["d"]] for r in radii]), np.array([[x["high"] for x in r["d"]] for r in radii]),
    ))
    subs = F.create_map(*[F.lit(int(v)) for r in radii for v in (r["annulus"], -(-r["n"] // UNIT))])[F.col("annulus")]
    members = keyed.select(
        "annulus", F.pmod(F.xxhash64("vec_id"), subs).cast("int").alias("sub"), F.lit(0).alias("kind"), "vec_id", "vec", F.lit(None).cast("double").alias("floor")
    )
    asked = keyed.where(F.col("vec_id") % step == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    queries = asked.withColumn("floor", F.lit(None).cast("double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, start, stop = None, 0, UNIT
    while True:
        visits = queries.select("vec_id", "vec", "floor").mapInArrow(
            lambda it, a=start, b=stop: _expand(it, index, spans_of, dims, a, b), "annulus int, vec_id long, vec binary, floor double"
        )
        spread = visits.select("annulus", F.explode(F.sequence(F.lit(0), (subs - 1).cast("int"))).alias("sub"), F.lit(1).alias("kind"), "vec_id", "vec", "floor")
        dealt = members.unionByName(spread).repartition("annulus", "sub").sortWithinPartitions("annulus", "sub", "kind")
        found = dealt.mapInArrow(lambda it: tidy(_scan(it, k, dims)), "query_id long, score double, vec_id long")
        if best is not None:
            found = found.unionByName(best.select("query_id", "score", "vec_id"))
        best = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        if stop >= n:
            break
        floors = best.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
        queries = asked.join(floors, "vec_id", "left")
        start, stop = stop, stop * GROWTH
    drop(keyed)
    return best.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def top_k(vectors: DataFrame, k: int = K, step: int = STEP, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of every query (``vec_id % step == 0``)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
    ready = cut(rows.mapInArrow(lambda it: tidy(_prepare(it, scale)), "vec_id long, vec binary, dims int, norm2 double"), "vectors")
    # a row for each length that vectors have
    lengths = ready.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("most")).orderBy("dims").collect()
    out = vectors.sparkSession.createDataFrame([], _RESULT)
    for dims, n, most in lengths:
        out = out.unionByName(_search(ready.where(F.col("dims") == dims), dims, n, most, k, step))
    drop(ready)
    return out


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
