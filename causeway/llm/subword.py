"""Hashed word and character n-gram features, and sampling of training rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _Powers, mix, tidy


_chars = _Powers(0xA24BAED4963EE407 | 1)


def word_features(words: list[str], lo: int, hi: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words, one after the other, and how many each word has.

    A word has a feature for itself and one for each of the ``lo``- to ``hi``-grams of
    ``<word>``; all are hashed together, by prefix sums over the characters.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = "".join([f"<{w}>" for w in words])
    code = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    start = end - size
    up, down = _chars.get(len(code) + 1)
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code + np.uint64(1)) * up[:-1], out=total[1:])
    owner = np.repeat(np.arange(len(words)), size)
    room = np.repeat(end, size) - np.arange(len(code))
    hashes = [mix((total[end] - total[start]) * down[start] + np.uint64(1 << 40))]
    owners = [np.arange(len(words))]
    for n in range(lo, hi + 1):
        at = np.flatnonzero(room >= n)
        hashes.append(mix((total[at + n] - total[at]) * down[at] + np.uint64(n)))
        owners.append(owner[at])
    by = np.concatenate(owners)
    order = np.argsort(by, kind="stable")
    ids = (np.concatenate(hashes) % np.uint64(buckets)).astype(np.int64)
    return ids[order], np.bincount(by, minlength=len(words))


def document_features(words: Iterable[str], lo: int, hi: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of a document and how often each occurs."""
    counted = Counter(words)
    ids, n = word_features(list(counted), lo, hi, buckets)
    times = np.repeat(np.fromiter(counted.values(), np.float64, len(counted)), n)
    at, inverse = np.unique(ids, return_inverse=True)
    return at, np.bincount(inverse, times, len(at)).astype(np.float32)


class WordScores:
    """Sums of folded feature scores: a linear model over averaged features.

    ``table`` has a row for each bucket and a column for each score.  As a document's
    vector is the mean of its features' vectors, its scores are sums over words, and a
    task computes those of each distinct word once (it forgets them at ``limit`` words).
    """

    def __init__(self, table: np.ndarray, lo: int, hi: int, limit: int = 120_000):
        self.table, self.lo, self.hi = table, lo, hi
        # numbers held and worked on at a time, for one score or for hundreds
        self.limit, self.step = min(limit, 2_000_000 // (table.shape[1] + 1)), max(100, 100_000 // (table.shape[1] + 4))
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, self.table.shape[1] + 1))

    def _learn(self, words: list[str]) -> None:
        got = []
        for i in range(0, len(words), self.step):
            ids, n = word_features(words[i : i + self.step], self.lo, self.hi, len(self.table))
            sums = np.add.reduceat(self.table[ids].astype(np.float64), np.cumsum(n) - n, axis=0)
            got.append(np.concatenate([sums, n[:, None]], axis=1))
        self.rows = np.concatenate([self.rows, *got])

    def means(self, docs: Iterable[list[str]]) -> np.ndarray:
        """Mean scores over all features of each document's words; zeros without words."""
        if len(self.at) > self.limit:
            self._forget()
        at, new, places, times, sizes = self.at, [], [], [], []
        for words in docs:
            counted = Counter(words)
            for w in counted:
                i = at.get(w)
                if i is None:
                    i = at[w] = len(at)
                    new.append(w)
                places.append(i)
            times += counted.values()
            sizes.append(len(counted))
        if new:
            self._learn(new)
        out = np.zeros((len(sizes), self.table.shape[1]))
        size = np.array(sizes, np.int64)
        full = np.flatnonzero(size)
        if len(full):
            parts = self.rows[places] * np.array(times, np.float64)[:, None]
            total = np.add.reduceat(parts, (np.cumsum(size) - size)[full], axis=0)
            out[full] = total[:, :-1] / total[:, -1:]
        return out


def groups(column, size: int = 1 << 20):
    """The strings of an Arrow column in lists of about ``size`` characters."""
    held, n = [], 0
    for value in column:
        text = value.as_py()
        held.append(text)
        n += len(text or "")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def share(key: Column, fraction: Column) -> Column:
    """True for about ``fraction`` of all keys, chosen by hash (the same at every run)."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < fraction * (1 << 30)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the identifier as text, modulo ``n``; null without identifier."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fit_in_one_task(rows: DataFrame, fit: Callable[[list[tuple]], bytes]) -> bytes:
    """Run ``fit`` over a bounded sample inside one task; the packed model."""
    import pyarrow as pa

    def task(batches):
        held = [tuple(r.values()) for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([fit(held)], pa.binary())], names=["model"])

    got = rows.repartition(1).mapInArrow(lambda it: tidy(task(it)), "model binary").head()
    return bytes(got[0]) if got else fit([])  # without rows no task runs
