"""A corpus pipeline: stages over ``documents``, each calling one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causeway.llm import exact_dedup, mixing, near_dedup, quality, sentencepiece_codec
from causeway.llm.common import cut


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents scored below 0.3 go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup, five-word shingles: one document of each group stays."""
    return near_dedup.drop_near(docs, k=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pfair mixture: all documents, in files that follow the order which mixes the sources."""
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text, with the check that they decode to it.

    ``mix_part`` and ``mix_row`` keep the order of the mixture.  The comparison with the
    sentencepiece library, which op7 makes, is left out here.
    """
    return sentencepiece_codec.encode(docs, carry=mixing.places(docs))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", remove_copies),
    ("MinHash near-dedup", remove_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", tokenise),
]

#: The classifier is trained by gradient descent and the tokenizer is a merge loop: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
