"""Similarity, hybrid scores, centroids and annotations (the documented tier)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def cosine_topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` rows most like ``query`` (a top-k sort: each task keeps k rows)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(F.col(vec_col).isNotNull()).select(id_col, cosine(F.col(vec_col), q).alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def centroids(vectors: DataFrame, group: str = "label", vec_col: str = "embedding") -> DataFrame:
    """``group, dim, mean``: the mean of every component for each group."""
    parts = vectors.select(group, F.posexplode(vec_col).alias("dim", "x"))
    return parts.groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def hybrid(
    rows: DataFrame, age_s: Column, relevance: Column, importance: Column, half_life_s: float, weights=(1.0, 1.0, 1.0, 1.0), likeness: Column | None = None
) -> DataFrame:
    """``score``: weighted sum of recency (decaying by half), relevance, importance (0 to 10) and,
    if given, likeness to the sona."""
    recency = F.exp(-F.log(F.lit(2.0)) * age_s / half_life_s)
    w = weights
    score = w[0] * recency + w[1] * relevance + w[2] * importance / 10
    return rows.withColumn("score", score if likeness is None else score + w[3] * likeness)


def sona_likeness(vectors: DataFrame, group: str = "label", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id_col, likeness``: cosine of every vector to the centroid of its group (0 where there is none).

    The centroids, a row for each group, are joined as they are: Spark broadcasts them if they are few.
    """
    means = centroids(vectors, group, vec_col).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("dim", "mean"))).alias("c"))
    both = vectors.join(means.select(group, F.transform("c", lambda p: p["mean"]).alias("centre")), group, "left")
    return both.select(id_col, F.coalesce(cosine(F.col(vec_col), F.col("centre")), F.lit(0.0)).alias("likeness"))


def annotations(rows: DataFrame, data: str = "data") -> DataFrame:
    """Parsed notes: importance on named scales (mean), and one row for each relevance index."""
    parsed = rows.withColumn("a", F.from_json(data, "importance map<string,int>, relevance map<string,int>"))
    scales = F.map_values("a.importance")
    mean = F.aggregate(scales, F.lit(0.0), lambda s, x: s + x) / F.when(F.size(scales) > 0, F.size(scales))
    return parsed.withColumn("importance", mean).withColumn("relevance", F.col("a.relevance")).drop("a")


def ewma(values: DataFrame, key: str, order: str, value: str, alpha: float) -> DataFrame:
    """``key, ewma``: exponentially weighted mean of the ordered values of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    n = Window.partitionBy(key)
    ranked = values.withColumn("back", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(n))
    # the first value keeps the weight that the later ones leave over
    weight = F.when(F.col("back") == F.col("n") - 1, F.pow(F.lit(1 - alpha), F.col("back"))).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("back")))
    return ranked.groupBy(key).agg(F.sum(weight * F.col(value)).alias("ewma"))


def propagate(importance: DataFrame, edges: DataFrame, share: float, rounds: int = 1) -> DataFrame:
    """``id, importance`` after passing a share of it, each round, to what a memory depends on.

    ``edges`` may have a ``weight``; each round sums inside tasks before it shuffles.
    """
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    links = edges.select("src_id", "dst_id", weight.alias("w"))
    now = importance.select("id", F.col("importance").cast("double").alias("importance"))
    for _ in range(rounds):
        sent = now.select(F.col("id").alias("src_id"), "importance").join(links, "src_id")
        got = sent.groupBy(F.col("dst_id").alias("id")).agg(F.sum(F.col("importance") * F.col("w") * share).alias("got"))
        now = now.join(got, "id", "left").select("id", (F.col("importance") + F.coalesce("got", F.lit(0.0))).alias("importance"))
    return now


def weighted_recall(scores: DataFrame, edges: DataFrame, k: int, hops: int, decay: float, budget: int) -> DataFrame:
    """``id, score`` of at most ``budget`` memories: the ``k`` best of ``scores(id, score)``, and
    what ``edges(src_id, dst_id, weight)`` lead to from them in ``hops`` steps.

    A step passes score * weight * decay on; a memory keeps the best it got.  Ties go to the
    smaller id.  Each step is one join and an aggregate that starts inside tasks.
    """
    best = scores.orderBy(F.desc("score"), "id").limit(k).select("id", "score")
    for _ in range(hops):
        passed = best.select(F.col("id").alias("src_id"), "score").join(edges, "src_id")
        passed = passed.select(F.col("dst_id").alias("id"), (F.col("score") * F.col("weight") * decay).alias("score"))
        best = best.unionByName(passed).groupBy("id").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "id").limit(budget)
