"""Shared folder, lineage cutting and hashing of words used by several operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import remove, scratch

HOT = 4


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again (cuts lineage)."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


#: Narrow rows that a file of a table should have.
ROWS_A_FILE = 200_000


def cut_narrow(df: DataFrame, rows: int, name: str) -> DataFrame:
    """:func:`cut` for about ``rows`` rows of a few numbers: into as many files as these fill, or
    one for each core if that is more, however many partitions the last shuffle had."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cut(df.coalesce(max(cores, -(-rows // ROWS_A_FILE))), name)


def drop(df: DataFrame) -> None:
    """Delete the table behind a DataFrame made by :func:`cut`."""
    path = getattr(df, "_scratch_path", None)
    if path:
        remove(df.sparkSession, path)


def tidy(batches: Iterator) -> Iterator:
    """Pass on what a task makes; at its end give memory back that it no longer needs, so a
    worker that runs many tasks, of one query after the other, holds what the last one holds."""
    try:
        yield from batches
    finally:
        _digests.forget()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)


def meet(rows: DataFrame, about: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to ``about``, which has one row for each ``key`` and in ``n`` the number
    of its rows.  Keys with more than 1/``HOT`` of a shuffle partition's share of all rows are
    at most ``HOT`` for each partition, so they meet their rows by broadcast, whatever the
    data, and no task gets all rows of one; the others are shuffled."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = about.agg(F.sum("n")).head()[0] or 0
    hot = F.col("n") > max(1, total // (HOT * parts))
    told = [c for c in about.columns if c != key]
    met = rows.join(F.broadcast(about.where(hot).select(key, F.struct(*told).alias("_about"))), key, "left")
    rest = met.where("_about is null").drop("_about").join(about.where(~hot), key)
    return met.where("_about is not null").select(*rows.columns, "_about.*").unionByName(rest.select(*rows.columns, *told))


# --- hashing ---------------------------------------------------------------

class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


#: A base for each of the two hashes of a window.
_BASES = _Powers(0x9E3779B97F4A7C15 | 1), _Powers(0xD6E8FEB86659FD93 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Digests:
    """BLAKE2b digests of words, as two 64-bit numbers; a worker keeps those met lately."""

    def __init__(self, limit: int = 50_000):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.table = np.zeros((2, 0), np.uint64)

    def get(self, words: list[bytes]) -> np.ndarray:
        """An array (2, number of words)."""
        if len(self.at) > self.limit:
            self.forget()
        at = self.at
        if new := list(dict.fromkeys(filterfalse(at.__contains__, words))):
            at.update(zip(new, range(len(at), len(at) + len(new))))
            digests = b"".join([blake2b(w, digest_size=16).digest() for w in new])
            fresh = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
            n = len(at)
            if n > self.table.shape[1]:
                self.table = np.concatenate([self.table, np.zeros((2, max(n, 4096)), np.uint64)], axis=1)
            self.table[:, n - len(new) : n] = fresh
        return self.table[:, np.fromiter(map(at.__getitem__, words), np.int64, len(words))]


_digests = _Digests()


def word_hashes(text: bytes) -> np.ndarray:
    """Two independent 64-bit hashes (2, n) of the words ``[^\\x20\\x09-\\x0D]+`` of ``text``."""
    return _digests.get(text.split())


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Two Rabin-Karp hashes (2, m) of every run of ``k`` words, by prefix sums, from theirs.

    Together they identify a run by 128 bits.  As words enter by a cryptographic digest, no
    pattern of characters makes them equal (patterns of thousands of words could, so ``k``
    should stay below 1,000).
    """
    n = words.shape[1] - k + 1
    if n <= 0:
        return np.zeros((2, 0), np.uint64)
    out = np.empty((2, n), np.uint64)
    for lane, base in enumerate(_BASES):
        up, down = base.get(words.shape[1] + 1)
        total = np.zeros(words.shape[1] + 1, np.uint64)
        np.cumsum(words[lane] * up[:-1], out=total[1:])
        out[lane] = mix((total[k:] - total[:n]) * down[:n] + np.uint64(k))
    return out


def folded(pair: np.ndarray) -> np.ndarray:
    """One 64-bit number for two."""
    return mix(pair[0] ^ mix(pair[1] + np.uint64(1)))


def shingle_set(text: str | None, k: int) -> tuple[np.ndarray, bytes]:
    """Sorted distinct hashes of the ``k``-word shingles of lower-cased (A-Z) ``text``, and a
    digest of the set that goes by all 128 bits of each.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not words.shape[1]:
        return words[0], blake2b(b"", digest_size=16).digest()
    pair = window_hashes(words, min(k, words.shape[1]))
    found, at = np.unique(folded(pair), return_index=True)
    return found, blake2b(np.ascontiguousarray(pair[:, at]).tobytes(), digest_size=16).digest()
