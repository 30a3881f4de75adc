"""SentencePiece models on the ``tokenizers`` library.

The model protobuf is parsed here, field by field, and rebuilt as a tokenizer: the
normaliser (precompiled character map, extra spaces, dummy prefix), the metaspace marker,
the pieces with their unigram scores -- or, for a model of type BPE, the merges those
scores rank -- and byte fallback.  Executors encode batches of whole texts on the
library's threads.

If no piece holds the marker after another character, no merge or piece can cross the
start of a marked word.  Texts are then cut there, which changes no result, and a worker
codes a word that it has met lately once only; otherwise texts are encoded in one go.  What
a worker builds from the model file stays with it from task to task.

Defined results: null is encoded as the empty text (no ids).  Special pieces (control,
unknown) written out in a text are ordinary text.  Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator, Mapping
from itertools import chain, compress, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .subword import groups

# Fixed values of the published model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: New words coded in one go.
TOGETHER = 128
#: Words that a worker remembers, about 300 bytes each.
WORDS = 80_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of every field of a protobuf message."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def parse(data: bytes) -> dict:
    """Pieces ``(text, score, type)`` and the settings that matter for coding."""
    out = {"pieces": [], "type": UNIGRAM, "byte_fallback": False, "charsmap": b"", "dummy_prefix": True, "squeeze": True, "escape": True, "suffix": False}
    for number, value in _fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    text = v.decode("utf-8")
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            out["pieces"].append((text, score, kind))
        elif number == 2:
            for k, v in _fields(value):
                if k == 3:
                    out["type"] = v
                elif k == 35:
                    out["byte_fallback"] = bool(v)
                elif k == 24:
                    out["suffix"] = bool(v)
        elif number == 3:
            for k, v in _fields(value):
                name = {2: "charsmap", 3: "dummy_prefix", 4: "squeeze", 5: "escape"}.get(k)
                if name:
                    out[name] = v if name == "charsmap" else bool(v)
    return out


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All ways to join two pieces to a third, best score of the result first.

    The result's score alone ranks a merge in the model; among equal ones the leftmost
    is taken, as the library does among merges of one rank.
    """
    score = {t: (-s, i) for i, (t, s, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
    out = []
    for t in score:
        for cut in range(1, len(t)):
            a, b = t[:cut], t[cut:]
            if a in score and b in score:
                out.append((score[t], score[a][1], score[b][1], a, b))
    return [(a, b) for *_, a, b in sorted(out)]


def cuts(model: dict) -> bool:
    """Whether no piece holds the marker after another character."""
    return not any(MARK in t.lstrip(MARK) for t, _, kind in model["pieces"] if kind in (NORMAL, USER_DEFINED))


def build(model: dict):
    """A ``tokenizers.Tokenizer`` that codes as the parsed model does."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    pieces = model["pieces"]
    unk = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
    if model["type"] == UNIGRAM:
        # pieces that are no text must never win a path
        vocab = [(t, s if kind in (NORMAL, USER_DEFINED) else -1e6) for t, s, kind in pieces]
        core = models.Unigram(vocab, unk, byte_fallback=model["byte_fallback"])
    elif model["type"] == BPE:
        core = models.BPE(
            {t: i for i, (t, *_) in enumerate(pieces)}, _merges(pieces), unk_token=pieces[unk][0],
            byte_fallback=model["byte_fallback"], fuse_unk=True,
        )
    else:
        raise ValueError(f"model type {model['type']} is not supported")
    tok = Tokenizer(core)
    steps = []
    if model["charsmap"]:
        steps.append(normalizers.Precompiled(model["charsmap"]))
    if model["squeeze"]:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["dummy_prefix"]:
        steps.append(normalizers.Prepend(" "))
    if model["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    tok.normalizer = normalizers.Sequence(steps)
    if cuts(model):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    user = [AddedToken(t, normalized=True) for t, _, kind in pieces if kind == USER_DEFINED]
    if user:
        tok.add_tokens(user)
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model["dummy_prefix"]:
        steps.append(decoders.Strip(content=" ", left=1))
    tok.decoder = decoders.Sequence(steps)
    return tok


def load(path: str):
    with open(path, "rb") as f:
        return build(parse(f.read()))


#: What a worker process has built from a model, kept from task to task.
_loaded: dict[tuple, object] = {}


def _tokenizer(path: str):
    if ("whole", path) not in _loaded:
        _loaded["whole", path] = load(path)
    return _loaded["whole", path]


def _coder(path: str, parity: bool, held: int):
    """What codes texts, and with ``parity`` compares them with the library."""
    if ("code", path, parity, held) not in _loaded:
        with open(path, "rb") as f:
            by_word = cuts(parse(f.read()))
        checks = None
        if parity:
            import sentencepiece

            checks = sentencepiece.SentencePieceProcessor(model_file=path)
        _loaded["code", path, parity, held] = WordCoder(path, checks, held) if by_word else Whole(_tokenizer(path), checks)
    return _loaded["code", path, parity, held]


class WordCoder:
    """Codes marked words, each distinct one once, and joins their ids to texts' ids.

    For tokenizers that cut at marked words (``cuts``).  ``checks`` is a sentencepiece
    processor to compare every distinct word with, or None.  Once ``limit`` words are held,
    those seen once since the last time are forgotten, and of the others at most the half
    of ``limit`` seen most stays, so memory does not follow the vocabulary of the corpus.
    """

    def __init__(self, path: str, checks=None, limit: int = WORDS):
        with open(path, "rb") as f:
            self.model = parse(f.read())
        self.words = build(self.model)
        # the bytes that a piece says, as the decoder joins them; None if it says nothing
        self.said = [
            t.encode() if kind in (NORMAL, USER_DEFINED) else bytes([int(t[3:5], 16)]) if kind == BYTE else None for t, _, kind in self.model.pop("pieces")
        ]
        self.first = np.array([t is not None and t.startswith(MARK.encode()) for t in self.said])
        self.normalise = self.words.normalizer.normalize_str
        self.words.normalizer = None
        self.checks, self.limit = checks, limit
        self.plain = not self.model["charsmap"] and not self.model["squeeze"] and self.model["dummy_prefix"] and self.model["escape"]
        self.find = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.rest()

    def rest(self) -> None:
        """Hold no words."""
        self.at: dict[str, int] = {}
        self.fresh: list[tuple] = []
        self.start = self.length = self.seen = np.zeros(0, np.int64)
        self.pool, self.back, self.same = np.zeros(0, np.int32), np.zeros(0, bool), np.zeros(0, bool)

    def _forget(self) -> None:
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > self.limit // 2:
            keep = np.sort(keep[np.argpartition(-self.seen[keep], self.limit // 2)[: self.limit // 2]])
        words = list(self.at)
        self.at = {words[i]: n for n, i in enumerate(keep.tolist())}
        length = self.length[keep]
        ends = np.cumsum(length)
        self.pool = self.pool[np.repeat(self.start[keep] - (ends - length), length) + np.arange(length.sum())]
        self.start, self.length, self.seen = ends - length, length, np.zeros(len(keep), np.int64)
        self.back, self.same = self.back[keep], self.same[keep]

    def _learn(self, new: list[str]) -> None:
        # words with one mark, at their start, keep apart when they are joined, and their
        # first pieces are those that start with a mark
        joins = [self.model["dummy_prefix"] and w[0] == MARK != w[-1] and w.count(MARK) == 1 for w in new]
        joined, alone = list(compress(new, joins)), [w for w, j in zip(new, joins) if not j]
        for i in range(0, len(joined), TOGETHER * 64):
            groups_of = [joined[j : j + TOGETHER] for j in range(i, min(len(joined), i + TOGETHER * 64), TOGETHER)]
            texts = ["".join(g) for g in groups_of]
            coded = self.words.encode_batch_fast(texts, add_special_tokens=False)
            theirs = self.checks.encode([t[1:].replace(MARK, " ") for t in texts], num_threads=1) if self.checks is not None else [None] * len(texts)
            for g, text, e, other in zip(groups_of, texts, coded, theirs):
                ids = e.ids
                try:
                    good = b"".join([self.said[x] for x in ids]) == text.encode() and (other is None or ids == other)
                except TypeError:  # a piece that says nothing
                    good = False
                starts = np.flatnonzero(self.first[ids]) if good else ()
                if len(starts) == len(g):
                    self._hold(g, np.diff(starts, append=len(ids)), ids, True, True)
                else:  # word by word, to tell which ones differ
                    self._one_by_one(g)
        for i in range(0, len(alone), TOGETHER * 64):
            self._one_by_one(alone[i : i + TOGETHER * 64])

    def _one_by_one(self, new: list[str]) -> None:
        ids = [e.ids for e in self.words.encode_batch_fast(new, add_special_tokens=False)]
        spaced = [w.replace(MARK, " ") for w in new]
        cut = self.model["dummy_prefix"]
        # decoding drops the space of the dummy prefix, so it is given one more to drop
        first = [self.words.token_to_id(MARK)] if cut else []
        back = self.words.decode_batch([first + i for i in ids], skip_special_tokens=False)
        same = [True] * len(new)
        if self.checks is not None:
            theirs = self.checks.encode([x[1:] if cut and x[0] == " " else x for x in spaced], num_threads=1)
            lone = [self.checks.piece_to_id(MARK)]  # a lone space can't be given without its prefix
            same = [x == (lone if w == MARK and cut else y) for w, x, y in zip(new, ids, theirs)]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        self._hold(new, length, list(chain.from_iterable(ids)), [x == y for x, y in zip(back, spaced)], same)

    def _hold(self, words: list[str], length: np.ndarray, ids: list[int], back: bool | list[bool], same: bool | list[bool]) -> None:
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words))))
        self.fresh.append((length, np.array(ids, np.int32), np.full(len(words), back), np.full(len(words), same)))

    def _settle(self) -> None:
        """Append what was learned to the tables."""
        length, ids, back, same = (np.concatenate(x) for x in zip(*self.fresh))
        self.fresh = []
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.seen = np.concatenate([self.seen, np.zeros(len(length), np.int64)])
        self.pool, self.back, self.same = np.concatenate([self.pool, ids]), np.concatenate([self.back, back]), np.concatenate([self.same, same])

    def code(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and for each text their number, round trip and parity."""
        if len(self.at) > self.limit:
            self._forget()
        words: list[str] = []
        counts = []
        for t in texts:
            before = len(words)
            if t or not self.plain:
                words += self.find((" " + t).replace(" ", MARK) if self.plain else self.normalise(t))
            counts.append(len(words) - before)
        at = self.at
        if new := list(dict.fromkeys(filterfalse(at.__contains__, words))):
            self._learn(new)
            self._settle()
        idx = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
        self.seen += np.bincount(idx, minlength=len(self.seen))
        length = self.length[idx]
        ends = np.cumsum(length)
        ids = self.pool[np.repeat(self.start[idx] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        stop = np.cumsum(counts)
        begin = stop - counts

        def total(x: np.ndarray) -> np.ndarray:
            sums = np.append(0, np.cumsum(x))
            return sums[stop] - sums[begin]

        marks = np.array([MARK in t for t in texts], bool)
        bad_back, bad_same = total(~self.back[idx]), total(~self.same[idx])
        return ids, total(length), (bad_back == 0) & ~marks, bad_same == 0


class Whole:
    """The same as :class:`WordCoder` for models whose pieces cross words."""

    def __init__(self, tok, checks=None):
        self.tok, self.checks = tok, checks

    def rest(self) -> None:
        """It holds no words."""

    def code(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        back = self.tok.decode_batch(ids, skip_special_tokens=False)
        same = [True] * len(ids) if self.checks is None else [a == b for a, b in zip(ids, self.checks.encode(texts, num_threads=1))]
        flat = np.array([x for i in ids for x in i], np.int32)
        return flat, np.array([len(i) for i in ids], np.int64), np.array([a == b for a, b in zip(back, texts)], bool), np.array(same, bool)


def _code(batches: Iterator[pa.RecordBatch], path: str, parity: bool, step: int = 1 << 18, words: int = WORDS) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ.setdefault("RAYON_NUM_THREADS", "2")  # each thread has a memory pool of its own
    coder = _coder(path, parity, words)
    for batch in batches:
        names = batch.schema.names
        at = 0
        for held in groups(batch.column("text"), step):  # a bounded amount of text at a time
            texts = [(t or "").encode("utf-8", "replace").decode("utf-8") for t in held]
            ids, n, back, same = coder.code(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids, pa.int32()))
            shown = pa.array(same) if parity else pa.nulls(len(texts), pa.bool_())
            passed = [(c, batch.column(c).slice(at, len(texts))) for c in names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(x for _, x in passed), lists, pa.array(n, pa.int64()), pa.array(back), shown],
                names=[*(c for c, _ in passed), "ids", "n_tokens", "round_trip", "parity"],
            )
            at += len(texts)
    coder.rest()


def encode(docs: DataFrame, model_path: str = MODEL, parity: bool = False, words: int = WORDS, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """``doc_id``, the columns of ``carry``, and ``ids, n_tokens, round_trip, parity`` of every whole text.

    ``round_trip``: decoding the ids gives the text back (a model that normalises or
    squeezes spaces loses what it normalises).  ``parity``: the ids of every word (of the
    text, if that isn't cut) equal those of the sentencepiece library; null unless asked
    for.  A worker remembers at most ``words`` distinct words.  ``carry`` has further columns of ``docs`` by the name they get, none of which may
    be a name of this table.  The model file must be readable under ``model_path`` on every
    executor.
    """
    carry = carry or {}
    if taken := {"text", "doc_id", "ids", "n_tokens", "round_trip", "parity"} & set(carry):
        raise ValueError(f"columns to carry have names of this table: {sorted(taken)}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(name) for name, c in carry.items()], "text")
    passed = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:-1])
    return rows.mapInArrow(
        lambda it: tidy(_code(it, model_path, parity, words=words)),
        f"doc_id long, {passed}ids array<int>, n_tokens long, round_trip boolean, parity boolean",
    )


def decode(coded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(model_path)
        for b in batches:
            ids = [x or [] for x in b.column(1).to_pylist()]
            texts = tok.decode_batch(ids, skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(task, "doc_id long, text string")


def op7_query(docs: DataFrame, parity: bool = True) -> DataFrame:
    return encode(docs, parity=parity, words=3 * WORDS)
