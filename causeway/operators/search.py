"""Full-text relevance: an inverted index and BM25 scores.

The index is a table of postings ``term, id, tf, length`` in ranges of terms, sorted, so a
search reads the row groups of its terms only, and a table of the terms with the number of
their documents.  A term that very many documents have is split over ranges by document.  A
search joins the terms of its queries to both.  For the best few of each query, the postings
that are met are dealt to blocks of documents, which the queries go to as well: pairs of query
and document exist inside a task only, a query at a time, and k of each leave it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


#: Documents of a block, about.
BLOCK = 16_384


@dataclass(frozen=True)
class TextIndex:
    """``postings(term, id, tf, length)``, ``terms(term, df)``, the number of documents and their mean length."""

    postings: DataFrame
    terms: DataFrame
    documents: int
    mean_length: float


def terms_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def index(documents: DataFrame) -> TextIndex:
    """The index of ``documents(id, text)``; null is an empty text, which counts as a document."""
    spark = documents.sparkSession
    said = documents.select("id", F.coalesce(terms_of(F.col("text")), F.array().cast("array<string>")).alias("terms"))
    total, words = said.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).head()
    each = said.select("id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    counted = each.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = cut(counted.select("term", "id", "tf", "length").repartitionByRange(parts, "term", "id").sortWithinPartitions("term", "id"), "postings")
    return TextIndex(postings, cut(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms"), total, words / total if total else 0.0)


def bm25(held: TextIndex, queries: DataFrame, k: int | None = None, k1: float = 1.2, b: float = 0.75, own: bool = True, digits: int = 6) -> DataFrame:
    """``query_id, id, score`` of the documents that share a term with ``queries(query_id, text)``.

    With ``k`` the best of each query, with their ``rank``; ties go to the smaller id.  A term
    counts as often as the query says it.  ``own=False`` leaves out the document that has the
    query's identifier.  Scores are rounded to ``digits``, so that sums in any order agree.
    """
    asked = queries.select("query_id", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    rarity = F.log(1 + (F.lit(float(held.documents)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(held.terms, "term").select("query_id", "term", (F.col("times") * rarity).alias("weight"))
    damped = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(held.mean_length or 1.0)))
    if k is not None:
        scored = _best(held, weighed, damped, k, own, digits)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    met = weighed.join(held.postings, "term")
    if not own:
        met = met.where("id <> query_id")
    return met.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * damped), digits).alias("score"))


def _best(held: TextIndex, weighed: DataFrame, damped: Column, k: int, own: bool, digits: int) -> DataFrame:
    """``query_id, id, score`` of the ``k`` best documents of each query in every block."""
    blocks = max(1, -(-held.documents // BLOCK))
    weighed = cut(weighed, "weighed")
    asked = weighed.select("term").distinct()
    met = held.postings.join(asked, "term", "left_semi").select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "term", "id", damped.alias("part"))
    sent = weighed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def task(documents: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        # postings by term; documents by place, ascending
        code, terms = pd.factorize(documents["term"])
        order = np.argsort(code, kind="stable")
        ids, place = np.unique(documents["id"].to_numpy(), return_inverse=True)
        place, part = place[order], documents["part"].to_numpy()[order]
        starts = np.searchsorted(code[order], np.arange(len(terms) + 1))
        queries = queries.assign(code=pd.Index(terms).get_indexer(queries["term"])) if len(terms) else queries.iloc[:0].assign(code=0)
        out = []
        for name, q in queries[queries["code"] >= 0].groupby("query_id"):
            spans = [(starts[c], starts[c + 1], w) for c, w in zip(q["code"], q["weight"])]
            raw = np.bincount(np.concatenate([place[a:b] for a, b, _ in spans]), np.concatenate([part[a:b] * w for a, b, w in spans]), len(ids))
            if not own:
                raw[ids == name] = 0
            hit = np.flatnonzero(raw)
            score = np.floor(raw[hit] * 10.0**digits + 0.5) / 10.0**digits
            if len(hit) > k:
                least = np.partition(score, len(hit) - k)[len(hit) - k]
                above = np.flatnonzero(score > least)
                kept = np.concatenate([above, np.flatnonzero(score == least)[: k - len(above)]])
                hit, score = hit[kept], score[kept]
            out.append(pd.DataFrame({"query_id": name, "id": ids[hit], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    types = dict(held.postings.dtypes) | dict(weighed.dtypes)
    sides = met.groupBy("block").cogroup(sent.select("block", "query_id", "term", "weight").groupBy("block"))
    return sides.applyInPandas(task, f"query_id {types['query_id']}, id {types['id']}, score double")
