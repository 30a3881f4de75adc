"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, html_extract, langid, mixing, near_dedup, packing, pii, quality, sentencepiece_codec, substring_dedup, topk, vector_codes, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on_documents(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": _on_documents(substring_dedup.op1_query),
        "op2_mix_sources": _on_documents(mixing.op2_query),
        "op3_exact_dedup": _on_documents(exact_dedup.op3_query),
        "op10_minhash_near_dedup": _on_documents(near_dedup.near_dedup),
        "op4_html_text": lambda spark, sf_dir: html_extract.extract(_table(spark, sf_dir, "pages")),
        "op5_topk": lambda spark, sf_dir: topk.top_k(_table(spark, sf_dir, "embeddings")),
        "op6_personal_data": _on_documents(pii.personal_data),
        "op7_sentencepiece": _on_documents(sentencepiece_codec.op7_query),
        "op8_quality": lambda spark, sf_dir: quality.op8_query(
            _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
        ),
        "op9_language": _on_documents(langid.op9_query),
        "op11_packing": _on_documents(packing.op11_query),
        "op12_vector_codes": lambda spark, sf_dir: vector_codes.op12_query(_table(spark, sf_dir, "embeddings")),
        "op13_whitening": lambda spark, sf_dir: whitening.whiten(_table(spark, sf_dir, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.ORACLE_SQL, "op3_exact_dedup": exact_dedup.ORACLE_SQL, "op5_topk": topk.ORACLE_SQL,
        "op12_vector_codes": vector_codes.ORACLE_SQL,
    }
