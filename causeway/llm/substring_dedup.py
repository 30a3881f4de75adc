"""Substring deduplication by Rabin-Karp hashes of fixed-length word windows.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of the whole text, unchanged; a window is
``k`` consecutive words of one document.  A word is removed when a window covering it
has a word sequence that also starts in a document with a smaller ``doc_id``; windows
are judged on the input, not on what is left.

1.  Documents are dealt to *homes*, ranges of ``doc_id`` of about equal numbers, and each
    home, in the order of ``doc_id``, to *chunks* of ``CHUNK_WINDOWS`` windows.  So the
    order of chunks is the order of their documents.
2.  Each chunk sends its distinct window hashes to buckets of the hash space, sorted and
    packed; nothing is sent for each document.  A window that a third of all documents
    share costs its bucket one entry a chunk.
3.  Each bucket is counted by sorting: the first chunk of a hash owns it, every other chunk
    that has it gets it in its removal list.
4.  The lists meet their homes.  Inside a chunk the least ``doc_id`` of a hash is found on
    the spot; positions of listed windows, and of windows that an earlier document of the
    chunk has, merge into maximal removal intervals, and the kept words are digested.

Windows are told apart by 80 bits of two independent hashes over BLAKE2b digests of their
words: among n windows a false repeat is expected n*n / 2**81 times (0.004 for 10**11).

Homes and buckets follow the bytes of text and ``spark.sql.shuffle.partitions``, so a home
stays at about ``HOME_BYTES`` or less; the driver holds a number for each home.

Defined results: null or blank text has no words; fewer than ``k`` words have no window;
a null ``doc_id`` neither owns nor loses anything; rows that repeat a ``doc_id`` are one
document that starts its windows in both texts, and lose what smaller ids own (they share a
home, which is for identifiers that hardly repeat).  Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import folded, tidy, window_hashes, word_hashes

K = 13
CHUNK_WINDOWS = 600_000
CHUNK_BYTES, HOME_BYTES, BUCKET_BYTES = 4 << 20, 64 << 20, 96 << 20
PER_PARTITION = 4
#: More bits of a window than its hash has.
_CHECK = np.uint64((1 << 16) - 1)


def _encoded(text) -> bytes:
    value = text.as_py()
    return value.encode("utf-8", "surrogatepass") if value else b""


def _windows(body: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and 16 more bits of every window."""
    pair = window_hashes(word_hashes(body), k)
    return folded(pair), pair[1] & _CHECK


def _planes(values: np.ndarray, size: int) -> bytes:
    """The lower ``size`` bytes as big-endian byte planes: sorted values have long runs in the first."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :].T).tobytes()


def _unplanes(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 8 - size :] = planes.T
    return out.view(">u8").ravel().astype(np.uint64)


def _runs(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts (h, c), and where in it each distinct pair starts."""
    order = np.argsort(h)
    x, y = h[order], c[order]
    same = x[1:] == x[:-1]
    if (same & (y[1:] != y[:-1])).any():  # hashes that are equal in their first 64 bits only
        order = np.lexsort((c, h))
        x, y = h[order], c[order]
        same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    return order, np.flatnonzero(np.append(True, ~same))


def _least(values: np.ndarray, order: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For every place the least value of its run."""
    out = np.empty_like(values)
    out[order] = np.repeat(np.minimum.reduceat(values[order], start), np.diff(np.append(start, len(values))))
    return out


def _chunks(doc_ids: np.ndarray, windows: np.ndarray, most: int) -> np.ndarray:
    """The chunk of every row of a home that is sorted by ``doc_id``: a new one starts with
    the first identifier after ``most`` windows.  Rows of one identifier stay together."""
    out = np.zeros(len(doc_ids), np.int64)
    held = chunk = 0
    for i, n in enumerate(windows.tolist()):
        if held >= most and doc_ids[i] != doc_ids[i - 1]:
            held, chunk = 0, chunk + 1
        out[i] = chunk
        held += n
    return out


def _pack(chunk: int, hashes: list[np.ndarray], checks: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Rows (bucket, chunk, hashes, checks) of one chunk."""
    h, c = np.concatenate(hashes), np.concatenate(checks)
    order, start = _runs(h, c)
    h, c = h[order[start]], c[order[start]]
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(h)]
    spans = list(zip(cuts, cuts[1:]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(bucket[s]) for s, _ in spans], pa.int32()), pa.array([chunk] * len(spans), pa.int64()),
            pa.array([_planes(h[s:e], 8) for s, e in spans], pa.binary()), pa.array([_planes(c[s:e], 2) for s, e in spans], pa.binary()),
        ],
        names=["bucket", "chunk", "hashes", "checks"],
    )


def _deal(batches: Iterator[pa.RecordBatch], k: int, buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    """Packed hashes of the chunks, out of rows sorted by home and ``doc_id``."""
    home = last = None
    chunk = held = packed = 0
    hashes: list[np.ndarray] = []
    checks: list[np.ndarray] = []

    for batch in batches:
        for at, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if doc_id is None:
                continue
            ends = at != home or held >= most and doc_id != last
            if hashes and (ends or packed >= 4 * most):
                yield _pack(home << 32 | chunk, hashes, checks, buckets)
                hashes, checks, packed = [], [], 0
            if ends:
                chunk = 0 if at != home else chunk + 1
                home, held = at, 0
            h, c = _windows(_encoded(text), k)
            if len(h):
                hashes.append(h)
                checks.append(c)
            held, packed, last = held + len(h), packed + len(h), doc_id
    if hashes:
        yield _pack(home << 32 | chunk, hashes, checks, buckets)


def _losses(h: np.ndarray, c: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all entries of a bucket, those whose hash an earlier chunk has."""
    lost = chunk > _least(chunk, *_runs(h, c)) if len(h) else np.zeros(0, bool)
    return h[lost], c[lost], chunk[lost]


def _lists(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """One row for each home: its chunks, the length of each one's list, the hashes."""
    h, c, chunk = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((h, chunk))
    h, c, chunk = h[order], c[order], chunk[order]
    start = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
    length = np.diff(np.append(start, len(h)))
    homes = chunk[start] >> 32
    rows: list[list] = [[], [], [], [], []]
    for at in np.split(np.arange(len(start)), np.flatnonzero(np.diff(homes)) + 1):
        s, e = start[at[0]], start[at[-1]] + length[at[-1]]
        for col, v in zip(rows, (int(homes[at[0]]), (chunk[start[at]] & 0xFFFFFFFF).tobytes(), length[at].tobytes(), _planes(h[s:e], 8), _planes(c[s:e], 2))):
            col.append(v)
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[0], pa.int64()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["home", "chunks", "lengths", "hashes", "checks"]
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removal lists, packed for each home, out of rows sorted by bucket."""
    bucket, held = None, []
    out: list[tuple[np.ndarray, ...]] = []

    def finish() -> None:
        if held:
            found = _losses(*(np.concatenate(x) for x in zip(*held)))
            if len(found[0]):
                out.append(found)

    for batch in batches:
        for b, chunk, hashes, checks in zip(*(c.to_pylist() for c in batch.columns)):
            if b != bucket:
                finish()
                bucket, held = b, []
                if sum(len(x[0]) for x in out) > 2_000_000:
                    yield _lists(out)
                    out = []
            h = _unplanes(hashes, 8)
            held.append((h, _unplanes(checks, 2), np.full(len(h), chunk, np.int64)))
    finish()
    if out:
        yield _lists(out)


def intervals(at: np.ndarray, k: int) -> np.ndarray:
    """Maximal [start, end) word intervals covered by windows that start at ``at``."""
    if not len(at):
        return np.zeros((0, 2), np.int64)
    gap = np.flatnonzero(np.diff(at) > k)
    return np.stack([at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)] + k], axis=1)


def _listed(h: np.ndarray, c: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which (h, c) are in one of the lists."""
    out = np.zeros(len(h), bool)
    if not lists:
        return out
    lost_h, lost_c = (np.concatenate(x) for x in zip(*lists))
    order = np.argsort(lost_h)
    lost_h, lost_c = lost_h[order], lost_c[order]
    at = np.searchsorted(lost_h, h)
    for step in (0, 1):  # two windows that share their first 64 bits stand side by side
        near = np.minimum(at + step, len(lost_h) - 1)
        out |= (lost_h[near] == h) & (lost_c[near] == c)
    return out


def _remove(texts: pa.Table, lists: pa.Table, k: int, most: int) -> pa.Table:
    """The rows of a home, and what its chunks lose to other chunks and in themselves."""
    texts = texts.combine_chunks()
    lost: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for chunks, lengths, hashes, checks in zip(*(lists.column(n).to_pylist() for n in ("chunks", "lengths", "hashes", "checks"))):
        cuts = np.cumsum(np.frombuffer(lengths, np.int64))[:-1]
        pieces = zip(np.split(_unplanes(hashes, 8), cuts), np.split(_unplanes(checks, 2), cuts))
        for chunk, piece in zip(np.frombuffer(chunks, np.int64).tolist(), pieces):
            lost.setdefault(chunk, []).append(piece)
    doc_ids = texts.column("doc_id").to_pylist()
    order = sorted(range(len(doc_ids)), key=lambda i: (doc_ids[i] is not None, doc_ids[i] or 0))
    nulls = sum(d is None for d in doc_ids)
    column = texts.column("text")
    ids = np.array([doc_ids[i] for i in order[nulls:]], np.int64)
    n_windows = np.array([max(0, len(_encoded(column[i]).split()) - k + 1) for i in order[nulls:]], np.int64)
    chunk_of = _chunks(ids, n_windows, most)
    out: list[list] = [[], [], [], [], [], []]

    def put(i: int, body: bytes, at: np.ndarray) -> None:
        words, spans = body.split(), intervals(at, k)
        n, gone = len(words), int((spans[:, 1] - spans[:, 0]).sum())
        for s, e in reversed(spans.tolist()):
            del words[s:e]
        kept = b" ".join(words)
        for col, v in zip(out, (doc_ids[i], n, gone, hashlib.sha256(kept).hexdigest(), spans.tolist(), kept)):
            col.append(v)

    for i in order[:nulls]:
        put(i, _encoded(column[i]), np.zeros(0, np.int64))
    for rows in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(chunk_of)) + 1):
        if not len(rows):
            continue
        bodies = [_encoded(column[order[nulls + r]]) for r in rows.tolist()]
        found = [_windows(b, k) for b in bodies]
        h, c = (np.concatenate(x) for x in zip(*found))
        size = np.array([len(x) for x, _ in found])
        gone = np.zeros(len(h), bool)
        if len(h):
            owner = np.repeat(ids[rows], size)
            gone = owner > _least(owner, *_runs(h, c))
            gone |= _listed(h, c, lost.get(int(chunk_of[rows[0]]), []))
        for r, b, mine in zip(rows.tolist(), bodies, np.split(gone, np.cumsum(size)[:-1])):
            put(order[nulls + r], b, np.flatnonzero(mine))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary())
    return pa.table([pa.array(x, t) for x, t in zip(out, types)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept"])


def _home(doc_id: Column, bounds: list[int]) -> Column:
    """The number of bounds below ``doc_id``: first among every n-th of them, then in its stretch."""
    n = max(1, int(len(bounds) ** 0.5))
    long = [F.lit(b).cast("long") for b in bounds]
    coarse = F.array(*long[::n])
    fine = F.array(*[F.array(*long[i : i + n]) for i in range(0, len(bounds), n)])

    def below(edges: Column) -> Column:
        return F.size(F.filter(edges, lambda b: b < doc_id))

    far = below(coarse)
    return F.when(far == 0, 0).otherwise((far - 1) * n + below(F.element_at(fine, far))).cast("long")


def substring_dedup(docs: DataFrame, k: int = K, chunk_windows: int = CHUNK_WINDOWS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, removed, kept`` of every row.

    ``removed`` lists the maximal removal intervals as word offsets [start, end);
    ``kept`` is the kept text (words joined by one space, UTF-8).
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    # small inputs have homes of about a chunk, so that no more rows than that are dealt
    few = min(PER_PARTITION * parts, -(-size // CHUNK_BYTES))
    homes, buckets = max(1, few, -(-size // HOME_BYTES)), max(1, few, -(-size // BUCKET_BYTES))
    shares = [i / homes for i in range(1, homes)] or [0.5]
    cuts = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * homes))).head()[0] or [0]
    # identifiers that are null have homes of their own
    none = -1 - F.pmod(F.xxhash64("text"), F.lit(homes))
    home = F.when(F.col("doc_id").isNull(), none).otherwise(_home(F.col("doc_id"), sorted(set(cuts))))
    texts = rows.select(home.alias("home"), "doc_id", "text").repartition(parts, "home")
    dealt = texts.sortWithinPartitions("home", "doc_id").mapInArrow(
        lambda it: tidy(_deal(it, k, buckets, chunk_windows)), "bucket int, chunk long, hashes binary, checks binary"
    )
    lists = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(
        lambda it: tidy(_count(it)), "home long, chunks binary, lengths binary, hashes binary, checks binary"
    )
    # both sides are dealt by home, so the texts are shuffled once
    return texts.groupBy("home").cogroup(lists.groupBy("home")).applyInArrow(
        lambda a, b: _remove(a, b, k, chunk_windows),
        "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<array<long>>, kept binary",
    )


def op1_query(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs).select(
        "doc_id", "n_words", "n_removed", "kept_sha256", F.size("removed").cast("long").alias("n_intervals")
    )


ORACLE_SQL = r"""
with d as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), win as (
  select doc_id, i, array_to_string(w[i:i + 12], ' ') as s
  from d, unnest(range(1, len(w) - 11)) as u(i) where len(w) >= 13
), own as (
  select s, min(doc_id) as o from win group by s having count(distinct doc_id) > 1
), lost as (
  select win.doc_id, win.i from win join own on win.s = own.s and win.doc_id > own.o
), gone as (
  select distinct doc_id, i + j as p from lost, unnest(range(0, 13)) as v(j)
), runs as (
  select doc_id, count(*) as n_removed,
         sum(case when g is null or p > g + 1 then 1 else 0 end) as n_intervals
  from (select doc_id, p, lag(p) over (partition by doc_id order by p) as g from gone) group by doc_id
), word as (
  select doc_id, p, w[p] as x from d, unnest(range(1, len(w) + 1)) as t(p)
), kept as (
  select word.doc_id, string_agg(x, ' ' order by word.p) as body
  from word anti join gone on word.doc_id = gone.doc_id and word.p = gone.p group by word.doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
       sha256(coalesce(body, '')) as kept_sha256, coalesce(n_intervals, 0)::bigint as n_intervals
from d left join runs on d.doc_id = runs.doc_id left join kept on d.doc_id = kept.doc_id
"""
