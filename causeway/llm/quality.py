"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words and their character n-grams
(hashed to ``BUCKETS`` rows of ``DIM`` numbers); a softmax layer over that average gives
the probability of label 1.  Vectors and layer are trained together by stochastic
gradient descent in numpy on a sample of about ``TRAIN_ROWS`` labelled rows (expected
size; chosen by a hash of ``doc_id``), inside one task.  As the document vector is an
average, trained vectors and layer fold into one number a bucket for scoring, which
every task applies to its whole texts.

Labels, lang, source and doc_id are no inputs of a score.

Defined results: null, empty or blank texts get the score of the end token alone; a null
``doc_id`` is not held out and scored like others, but never trained on; labels that
are null or other than 0 and 1, and labels of absent documents, are ignored; a document
with several labels is an example for each; without usable labels every score is 0.5.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .subword import WordScores, document_features, fit_in_one_task, groups, remainder, share

BUCKETS, DIM, LO, HI = 1 << 17, 8, 2, 4
TRAIN_ROWS, EPOCHS, RATE = 4_000, 16, 1.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0


#: Stand for a word that repeats the word one or two places before it.
REPEATS = ("\x00same", "\x00again")
#: Closes every document, so that a few words alone decide little and empty texts have features.
END = ["\x00end"] * 4


def tokens(text: str | None) -> list[str]:
    """White-space words, repetitions replaced by a token of their own (a word n-gram)."""
    words = (text or "").split()
    return [
        w if w != p and w != q else REPEATS[w != p] for w, p, q in zip(words, ["", *words], ["", "", *words])
    ] + END


def train(rows: list[tuple[str, int]], seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors (BUCKETS, DIM), layer (2, DIM) and bias (2,) from (text, label) rows."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    data = []
    for text, label in rows:
        at, times = document_features(tokens(text), LO, HI, BUCKETS)
        data.append((at.astype(np.int32), times / max(1.0, float(times.sum())), label))
    steps, done = EPOCHS * len(data), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            at, weight, label = data[i]
            rate = RATE * (1 - done / steps)
            done += 1
            x = vectors[at]
            mean = weight @ x
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            pull = p @ layer
            pull /= max(1.0, float(np.abs(pull).max()) / 4)  # keeps steps finite
            layer -= rate * np.outer(p, mean)
            bias -= rate * 0.1 * p
            # a feature that fills a share w of a document moves by w of the step,
            # over the document's mean share, so that long texts teach as much as short
            vectors[at] = x - rate * np.outer(weight / weight.max(), pull) if len(at) else x
    return vectors, layer, bias


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Folded model: a number for each bucket and a bias."""
    usable = labels.where("quality in (0, 1) and doc_id is not null").where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    usable = usable.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    n = usable.count()
    if not n:
        return np.zeros(BUCKETS, np.float32), 0.0
    chosen = usable.where(share(F.col("label_id"), F.lit(train_rows / n)))
    rows = docs.join(chosen, docs["doc_id"].cast("long") == F.col("label_id")).select(docs["text"], "quality", "label_id")

    def run(held: list[tuple]) -> bytes:
        held = sorted(held, key=lambda r: (r[2], r[1], r[0] or ""))
        vectors, layer, bias = train([r[:2] for r in held])
        out = io.BytesIO()
        np.savez(out, table=vectors @ (layer[1] - layer[0]), bias=bias[1] - bias[0])
        return out.getvalue()

    got = np.load(io.BytesIO(fit_in_one_task(rows, run)))
    return got["table"], float(got["bias"])


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    table, bias = model.value
    words = WordScores(table[:, None], LO, HI)
    for batch in batches:
        found = [words.means(map(tokens, texts))[:, 0] for texts in groups(batch.column("text"))]
        z = np.concatenate([np.zeros(0), *found]) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "score"]
        )


def score(docs: DataFrame, model: tuple[np.ndarray, float], column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") if c != "text" else F.col("text") for i, c in enumerate(docs.columns)])
    schema = ", ".join(f"{c} {named.schema[c].dataType.simpleString()}" for c in named.columns) + ", score double"
    out = named.mapInArrow(lambda it: tidy(_score(it, shared)), schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(named.columns, docs.columns)], F.col("score").alias(column))


def op8_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those scored below ``threshold``."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return score(docs, fit(docs, labels), name).where(F.col(name) >= threshold).drop(name)
