"""Hierarchical language identification.

First the language *family* is predicted (one linear support vector machine against the
rest for each family), then, inside the family, one-versus-one linear machines between
its languages vote with their margins.  Features are hashed words and character n-grams
of the lower-cased letter runs, averaged over the document, so each machine folds into a
number a bucket and scoring is a sum over words.

Machines are trained by subgradient descent on the hinge loss (numpy, AdaGrad steps), each
in a group of its own, on a sample of about ``PER_LANGUAGE`` documents of every language
(expected size; chosen by a hash of ``doc_id``), of which a family's machine takes about
``OTHERS`` of the other families.  Tasks turn the sample into features before it is dealt
to machines, so no whole text is.  Rows with null lang, text or doc_id teach nothing.
lang, source and doc_id are no inputs.

Defined results: ``und`` with score 0 for a text that is null or has no letter, and for
all texts if nothing could be learned; with one language learned, all texts with a letter
are of it, with score 1; a null ``doc_id`` is not held out.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, tidy
from .subword import WordScores, document_features, groups, remainder, share

# Families of languages by their two-letter codes.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

BUCKETS, LO, HI = 1 << 16, 1, 3
PER_LANGUAGE, OTHERS, EPOCHS, RATE, DECAY = 700, 4_000, 8, 0.5, 1e-5
FOLDS, HELD_OUT = 4, 2
#: Signs that count as word characters without being letters or decimal digits: fractions, circled and Roman numbers.
_NUMERALS = {c: " " for c in range(sys.maxunicode + 1) if chr(c).isnumeric() and not chr(c).isalpha() and not chr(c).isdecimal()}
_NUMERAL = frozenset(map(chr, _NUMERALS))
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    text = text.lower()
    if not text.isascii() and not _NUMERAL.isdisjoint(text):
        text = text.translate(_NUMERALS)
    return _LETTERS.findall(text)


def family(lang: str) -> str:
    """The family of a language code; an unknown code is a family of its own."""
    return FAMILY_OF.get(re.split("[-_]", lang.lower())[0], lang)


def machine(data: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """A linear machine for signs +1 / -1 by subgradient steps on the hinge loss."""
    w, g = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    bias, bias_g = 0.0, 1e-6
    # the rarer side weighs as much as the commoner
    weight = np.where(sign > 0, len(sign) / max(1, 2 * (sign > 0).sum()), len(sign) / max(1, 2 * (sign < 0).sum()))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            at, x = data[i]
            y = sign[i]
            if y * (x @ w[at] + bias) < 1:
                step = -y * weight[i] * x + DECAY * w[at]
                g[at] += step * step
                w[at] -= RATE * step / np.sqrt(g[at])
                bias_g += (weight[i]) ** 2
                bias += 0.1 * RATE * y * weight[i] / np.sqrt(bias_g)
    return w, bias


def plan(langs: list[str]) -> tuple[dict[str, list[str]], list[tuple[str, str, str]]]:
    """The families of some languages, and the machines: ("family", f, "") or ("pair", a, b)."""
    families: dict[str, list[str]] = {}
    for x in sorted(set(langs)):
        families.setdefault(family(x), []).append(x)
    heads = [("family", f, "") for f in families] if len(families) > 1 else []
    return families, heads + [("pair", a, b) for own in families.values() for a, b in combinations(own, 2)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for doc_id, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            words = words_of(text.as_py() or "")
            if words:
                at, times = document_features(words, LO, HI, BUCKETS)
                for c, v in zip(rows, (doc_id, lang, at.astype(np.int32).tobytes(), (times / times.sum()).astype(np.float32).tobytes())):
                    c.append(v)
        types = (pa.int64(), pa.string(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=["doc_id", "lang", "at", "x"])


def _train(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One machine, its examples in a fixed order."""
    rows = rows.sort_values(["doc_id", "lang", "at", "x"], kind="stable")
    data = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32).astype(np.float64)) for a, x in zip(rows["at"], rows["x"])]
    w, bias = machine(data, rows["sign"].to_numpy(np.float64), np.random.default_rng([1, int(key[0])]))
    return pd.DataFrame({"head": [key[0]], "w": [w.astype(np.float32).tobytes()], "bias": [bias]})


def decide(model: dict, margins: np.ndarray) -> tuple[str, float]:
    """Language and confidence from the margins of all machines."""
    families, by = model["families"], {tuple(h): m for h, m in zip(model["heads"], margins)}
    if not families:
        return "und", 0.0
    sure = lambda m: 1 / (1 + np.exp(-np.clip(2 * m, -50, 50)))
    score = 1.0
    best = next(iter(families))
    if len(families) > 1:
        best = max(families, key=lambda f: (by["family", f, ""], f))
        score = sure(by["family", best, ""])
    own = families[best]
    votes = dict.fromkeys(own, 0.0)
    for a, b in combinations(own, 2):
        m = by["pair", a, b]
        votes[a] += np.tanh(m)
        votes[b] -= np.tanh(m)
    lang = max(votes, key=lambda x: (votes[x], x))
    for a, b in combinations(own, 2):
        if lang in (a, b):
            score = min(score, sure(by["pair", a, b] if lang == a else -by["pair", a, b]))
    return lang, float(score)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, others: int = OTHERS) -> dict:
    """Machines for every language that has usable rows: table (BUCKETS, m), biases and what
    each separates.  The driver holds a number for each language and the machines."""
    spark = docs.sparkSession
    usable = docs.where("lang is not null and text is not null and doc_id is not null")
    usable = usable.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    usable = usable.where(F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    families, heads = plan(list(sizes))
    model = {"heads": heads, "families": families, "table": np.zeros((BUCKETS, len(heads)), np.float32), "bias": np.zeros(len(heads))}
    if not heads:
        return model
    taken = {x: min(n, per_language) for x, n in sizes.items()}
    deals = []
    for i, (kind, a, b) in enumerate(heads):
        if kind == "pair":
            deals += [(a, i, 1.0, 1.0), (b, i, -1.0, 1.0)]
            continue
        own = set(families[a])
        share_of = others / max(1, sum(n for x, n in taken.items() if x not in own))
        deals += [(x, i, 1.0, 1.0) if x in own else (x, i, -1.0, share_of) for x in sizes]
    each = spark.createDataFrame([(x, per_language / n) for x, n in sizes.items()], "lang string, part double")
    chosen = usable.join(F.broadcast(each), "lang").where(share(F.col("doc_id"), F.col("part")))
    features = cut(chosen.select("doc_id", "lang", "text").mapInArrow(_features, "doc_id long, lang string, at binary, x binary"), "language-sample")
    # a row for each language and machine, whatever the number of documents
    dealt = features.join(F.broadcast(spark.createDataFrame(deals, "lang string, head int, sign double, part double")), "lang")
    dealt = dealt.where(share(F.struct("doc_id", "head"), F.col("part"))).select("head", "doc_id", "lang", "at", "x", "sign")
    for r in dealt.groupBy("head").applyInPandas(_train, "head int, w binary, bias double").collect():
        model["table"][:, r["head"]] = np.frombuffer(r["w"], np.float32)
        model["bias"][r["head"]] = r["bias"]
    drop(features)
    return model


def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    scores = WordScores(model["table"], LO, HI)
    for batch in batches:
        out = []
        for texts in groups(batch.column(1)):
            words = [words_of(t or "") for t in texts]
            margins = scores.means(words) + model["bias"]
            out += [decide(model, m) if w else ("und", 0.0) for w, m in zip(words, margins)]
        langs, sure = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "lang_pred", "score"]
        )


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(lambda it: tidy(_predict(it, shared)), "doc_id long, lang_pred string, score double")


def op9_query(docs: DataFrame) -> DataFrame:
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return identify(docs, fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
