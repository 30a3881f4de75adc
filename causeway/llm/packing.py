"""Packing of whole texts into training sequences along a space-filling curve.

1.  Texts become token ids.  The tokenizer drops white space and joins nothing across it,
    so a worker codes a word that it has met lately once only.
2.  A document's ids are hashed to a vector of ``BUCKETS`` signed, damped counts, and that
    is projected to ``DIMS`` dimensions.  Each coordinate is cut to ``BITS`` bits by a fixed
    squashing function, so a document's key follows from its text alone, and the cell's
    place on the Hilbert curve is the key.
3.  Documents are range-sorted by that key: its quantiles bound the ranges, equal keys are
    told apart by a hash of the row, so copies by the million spread over ranges.  The sums
    of tokens of the ranges (one number each) give every range its place in one stream of
    all tokens, and the stream is cut every ``LENGTH`` tokens.  A range is numbered inside
    one task, in a single pass over sorted rows.
4.  What is left at the end of the stream is cut into sequences that are powers of two
    long, which need no padding.

The ids are written once and shuffled once, at two bytes a token for vocabularies up to
65,536.

Defined results: null is the empty text, which has the end mark alone.  Rows that repeat an
identifier, or have none, are packed each for itself.  A text may be cut anywhere, into as
many pieces as it needs.  Without rows there is no sequence.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, tidy

LENGTH, END = 4096, 2
BUCKETS, DIMS, BITS = 256, 4, 10
#: Ranges for each shuffle partition, so that hashing them to tasks comes out even.
RANGES = 8
#: Words that a worker remembers, about 60 bytes each, and a hash table while they are looked up.
WORDS = 400_000
#: Words coded in one go.
TOGETHER = 256
#: Bits of a sort key that tell rows of one Hilbert key apart.
SPREAD = 23


# --- ids ---------------------------------------------------------------------


#: What a tokenizer does before its merges if its words may be coded without these rules: words of
#: Latin letters, lowered, pass all of them as they are.
_RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)


def _merges_alone(path: str):
    """The tokenizer without its rules, cutting at white space; the whole one if its rules are others."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tok = Tokenizer.from_file(path)
    held = json.loads(tok.to_str())
    if (held["normalizer"], held["pre_tokenizer"]) == _RULES:
        tok.normalizer = normalizers.Sequence([])
        tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok


class WordIds:
    """Ids of texts by a tokenizer that drops white space and lower-cases.

    Words are what lies between ASCII white space; a run of ASCII marks after a Latin letter
    is cut off, as the tokenizer does itself.  ASCII letters are lowered first, unless a text
    might hold a special token.  Words are looked up as Arrow strings; only new ones become
    Python's.  Once ``limit`` words are held, those met once since the last time go.
    """

    # all marks but the apostrophe, which may begin an ending
    loose = r"([a-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~]+)([\x20\x09-\x0D]|\z)"
    latin = r"^[a-zÀ-ÖØ-öø-ÿ]+$"

    def __init__(self, path: str, limit: int = WORDS):
        from tokenizers import Tokenizer

        self.tok, self.merges = Tokenizer.from_file(path), _merges_alone(path)
        self.starts = sorted({t.content[:2].lower() for t in self.tok.get_added_tokens_decoder().values()})
        self.size, self.limit = self.tok.get_vocab_size(), limit
        suffix = self.tok.model.end_of_word_suffix
        #: Which ids end a word; words of letters alone have one such id each, their last.
        self.last = np.zeros(self.size, bool)
        if suffix:
            self.last[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
        self.rest()

    def rest(self) -> None:
        """Hold no words."""
        self.words = pa.array([], pa.string())
        self.start = self.length = self.seen = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _forget(self) -> None:
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > self.limit // 2:
            keep = np.sort(keep[np.argpartition(-self.seen[keep], self.limit // 2)[: self.limit // 2]])
        self.words = self.words.take(pa.array(keep))
        length = self.length[keep]
        ends = np.cumsum(length)
        self.pool = self.pool[np.repeat(self.start[keep] - (ends - length), length) + np.arange(length.sum())]
        self.start, self.length, self.seen = ends - length, length, np.zeros(len(keep), np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _latin(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words of Latin letters, and the number of each word."""
        bounds = np.append(np.arange(0, len(words), TOGETHER), len(words)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), pc.utf8_lower(words)), " ").to_pylist()
        found = [np.array(e.ids, np.int32) for e in self.merges.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.int32), *found])
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)

    def _apart(self, words: list[str]) -> list[list[int]]:
        """Ids of words of any kind, coded together as words that are cut already."""
        found: list[list[int]] = []
        parts = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for part, e in zip(parts, self.tok.encode_batch(parts, is_pretokenized=True, add_special_tokens=False)):
            if None in e.word_ids:  # a special token
                found += self._encode(part)
                continue
            ids, at = e.ids, np.cumsum(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part))).tolist()
            found += [ids[a:b] for a, b in zip([0, *at], at)]
        return found

    def _learn(self, words: pa.StringArray) -> None:
        """Append the ids of new words, in their order, to the table."""
        latin = pc.match_substring_regex(words, self.latin).to_numpy(zero_copy_only=False)
        order, lengths, ids = [np.flatnonzero(latin)], [], []
        got, length = self._latin(words.filter(pa.array(latin)))
        if len(length) != len(order[0]):  # the tokenizer tells no ends of words
            latin, order, got, length = np.zeros(len(words), bool), [np.zeros(0, np.int64)], got[:0], length[:0]
        lengths.append(length)
        ids.append(got)
        places = np.flatnonzero(~latin)
        texts = words.take(pa.array(places)).to_pylist()
        letters = np.fromiter(map(str.isalpha, texts), bool, len(texts))
        plain, other = np.flatnonzero(letters), np.flatnonzero(~letters)
        joined = [plain[i : i + TOGETHER].tolist() for i in range(0, len(plain), TOGETHER)]
        for own, got in zip(joined, self._encode([" ".join([texts[i] for i in own]) for own in joined])):
            got = np.array(got, np.int32)
            stops = np.flatnonzero(self.last[got])
            if len(stops) == len(own):
                order.append(places[own])
                lengths.append(np.diff(stops, prepend=-1))
                ids.append(got)
            else:  # letters that the tokenizer takes apart
                other = np.append(other, own)
        found = self._apart([texts[i] for i in other])
        order.append(places[other])
        lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
        ids.append(np.fromiter(chain.from_iterable(found), np.int32, int(lengths[-1].sum())))
        length, own = np.concatenate(lengths).astype(np.int64), np.concatenate(order).astype(np.int64)
        back = np.argsort(own)  # from the order of coding to that of the words
        begin = len(self.pool) + np.cumsum(length) - length
        self.start, self.length = np.concatenate([self.start, begin[back]]), np.concatenate([self.length, length[back]])
        self.pool = np.concatenate([self.pool, *ids])
        self.seen = np.concatenate([self.seen, np.zeros(len(words), np.int64)])
        self.words = pa.concat_arrays([self.words, words])

    def code(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of each text."""
        if len(self.words) > self.limit:
            self._forget()
        low = pc.ascii_lower(texts)
        open_ = pc.replace_substring_regex(low, pattern=self.loose, replacement=r"\1 \2\3")
        for s in self.starts:
            open_ = pc.if_else(pc.match_substring(low, s), texts, open_)
        lists = pc.ascii_split_whitespace(open_)
        # each distinct word of the texts is looked up once
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.string())
        own = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(own < 0)
        if len(new):
            own[new] = len(self.words) + np.arange(len(new))
            self._learn(distinct.take(pa.array(new)))
        idx = own[words.indices.to_numpy(zero_copy_only=False)]
        self.seen += np.bincount(idx, minlength=len(self.seen))
        length = self.length[idx]
        ends = np.cumsum(length)
        ids = self.pool[np.repeat(self.start[idx] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        counts = lists.value_lengths().to_numpy(zero_copy_only=False)
        sums, stop = np.append(0, ends), np.cumsum(counts)
        return ids, sums[stop] - sums[stop - counts]


def slices(column: pa.StringArray, size: int) -> Iterator[tuple[int, pa.StringArray]]:
    """Parts of a column of about ``size`` bytes of text each, and where they begin; null as empty."""
    column = pc.fill_null(column, "")
    weight = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) // size
    at = [0, *(np.flatnonzero(np.diff(weight)) + 1).tolist(), len(column)] if len(column) else []
    for a, b in zip(at, at[1:]):
        yield a, column.slice(a, b - a)


# --- keys --------------------------------------------------------------------


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (n, dims) with coordinates of ``bits`` bits.

    From the axes' bits, high to low, each cell's orientation is undone (an exchange with the
    first axis, or its inversion); a Gray code turned back and interleaved is the place.
    """
    x = cells.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(dims):
            inside = (x[i] & bit) > 0
            swap = np.where(inside, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inside, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(level)) & one > 0, (one << np.uint64(level)) - one, np.uint64(0))
    x ^= turn
    out = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            out = (out << one) | ((axis >> np.uint64(level)) & one)
    return out.astype(np.int64)


class Curve:
    """Hilbert keys of documents from their ids."""

    def __init__(self, vocabulary: int, buckets: int = BUCKETS, dims: int = DIMS, bits: int = BITS):
        scrambled = mix(np.arange(1, vocabulary + 1, dtype=np.uint64))
        self.bucket = (scrambled % np.uint64(buckets)).astype(np.int64)
        self.sign = np.where(scrambled >> np.uint64(63), 1.0, -1.0)
        self.axes = np.linalg.qr(np.random.default_rng(11).normal(size=(buckets, dims)))[0]
        self.buckets, self.bits = buckets, bits

    def vectors(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Unit vectors of hashed counts (n, buckets); zero for documents without ids."""
        row = np.repeat(np.arange(len(counts)), counts)
        sums = np.bincount(row * self.buckets + self.bucket[ids], weights=self.sign[ids], minlength=len(counts) * self.buckets)
        v = sums.reshape(len(counts), self.buckets)
        v = np.sign(v) * np.log1p(np.abs(v))
        return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)

    def keys(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        # a unit vector's coordinate on any axis is about 1 / sqrt(buckets)
        z = self.vectors(ids, counts) @ self.axes * np.sqrt(self.buckets)
        cells = np.clip((0.5 + 0.5 * np.tanh(z / 2)) * (1 << self.bits), 0, (1 << self.bits) - 1)
        return hilbert(cells.astype(np.int64), self.bits)


# --- the stream --------------------------------------------------------------


def ends(total: int, length: int = LENGTH) -> list[int]:
    """Where the sequences after the last full one end: powers of two, the largest first."""
    at, out = total - total % length, []
    for bit in range(length.bit_length() - 1, -1, -1):
        if (total % length) >> bit & 1:
            at += 1 << bit
            out.append(at)
    return out


def cuts(begin: int, end: int, total: int, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(sequence, its start, the piece's end) of each piece of what the stream has from ``begin`` to ``end``."""
    full = total // length
    out, at = [], begin
    while at < end and at < full * length:
        s = at // length
        stop = min(end, (s + 1) * length)
        out.append((s, s * length, stop))
        at = stop
    starts = full * length
    for n, stop in enumerate(ends(total, length)):
        if at < end and starts <= at < stop:
            out.append((full + n, starts, min(end, stop)))
            at = min(end, stop)
        starts = stop
    return out


#: What a worker builds from a tokenizer file, and the words it has met, kept from task to task.
_loaded: dict[tuple, tuple[WordIds, Curve]] = {}


def _coder(path: str, words: int) -> tuple[WordIds, Curve]:
    if (path, words) not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = WordIds(path, words)
        _loaded[path, words] = ids, Curve(ids.size)
    return _loaded[path, words]


def _code(batches: Iterator[pa.RecordBatch], path: str, end: int, words: int, step: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    coder, curve = _coder(path, words)
    kind = np.uint16 if max(coder.size, end + 1) <= 1 << 16 else np.uint32
    for batch in batches:
        for at, held in slices(batch.column(1), step):  # a bounded amount of text at a time
            ids, n = coder.code(held)
            keys = curve.keys(ids, n)
            # the end mark after every document's ids
            stream = np.insert(ids, np.cumsum(n), end).astype(kind)
            bounds = np.append(0, np.cumsum(n + 1)) * stream.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(held), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(stream)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(held)), packed.cast(pa.binary()), pa.array(n + 1, pa.int64()), pa.array(keys, pa.int64())],
                names=["doc_id", "ids", "doc_tokens", "key"],
            )


def _pieces(batches: Iterator[pa.RecordBatch], first, total: int, length: int) -> Iterator[pa.RecordBatch]:
    """Cut rows sorted by (range, key, place); a range's tokens follow those of the ranges before it."""
    here, at = None, 0
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for r, doc_id, packed, n in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if r != here:
                here, at = r, int(first.value[r])
            ids = np.frombuffer(packed, np.uint16 if len(packed) == 2 * n else np.uint32).astype("<u4")
            begin = at
            for sequence, opened, stop in cuts(begin, begin + n, total, length):
                for c, v in zip(out, (doc_id, at - begin, stop - at, ids[at - begin : stop - begin].tobytes(), n, sequence, at - opened)):
                    c.append(v)
                at = stop
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=_NAMES)


_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, words: int = WORDS) -> DataFrame:
    """``PIECE`` of every whole text: ``ids`` (little-endian, four bytes each) from ``start`` on
    stand in sequence ``sequence_id`` from ``offset`` on; the document has ``doc_tokens`` ids,
    ``end`` being the last.  Neighbours on the curve share sequences.

    ``length`` must be a power of two.  The tokenizer's file must be readable under the path
    ``tokenizer`` on every executor, drop white space and lower-case.
    """
    if length & (length - 1) or length < 1:
        raise ValueError("length must be a power of two")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = rows.mapInArrow(lambda it: tidy(_code(it, tokenizer, end, words)), "doc_id long, ids binary, doc_tokens long, key long")
    coded = cut(coded.withColumn("place", F.monotonically_increasing_id()), "coded")
    # rows of one Hilbert key are spread by a hash of their place in the written table
    key = F.shiftleft("key", SPREAD) + F.pmod(F.xxhash64("place"), F.lit(1 << SPREAD))
    keyed = coded.select("doc_id", "ids", "doc_tokens", "place", key.alias("key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = RANGES * parts
    bounds = keyed.agg(F.percentile_approx("key", [(i + 1) / n for i in range(n - 1)], 10 * n)).head()[0]
    if bounds is None:
        return spark.createDataFrame([], PIECE)
    edges = spark.sparkContext.broadcast(np.unique(np.array(bounds, np.int64)))

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges.value, keys.to_numpy(), side="right").astype(np.int32))

    ranged = keyed.withColumn("range", range_of("key"))
    # one small row for each range
    sizes = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.sum("doc_tokens").alias("n")).collect()}
    tokens = np.array([sizes.get(i, 0) for i in range(n)], np.int64)
    first, total = spark.sparkContext.broadcast(np.cumsum(tokens) - tokens), int(tokens.sum())
    dealt = ranged.repartition(parts, "range").sortWithinPartitions("range", "key", "place").select("range", "doc_id", "ids", "doc_tokens")
    return dealt.mapInArrow(lambda it: tidy(_pieces(it, first, total, length)), PIECE)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids`` (``array<int>``): whole sequences (bounded, at most ``length`` ids each)."""
    held = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in row), "<u4").astype(np.int32) for row in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "n_tokens", "ids"])

    return held.select("sequence_id", "n_tokens", "p").mapInArrow(task, "sequence_id long, n_tokens long, ids array<int>")


def op11_query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
