"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, exact_topk, mixing
from ._common import table
from .quality_classifier import quality_scores
from .secret_scan import scan_report
from .sentencepiece_codec import encode_documents
from .simhash_dedup import dedup_report
from .substring_dedup import dedup_report as passage_report
from .toxicity import toxicity_scores
from .url_filter import judge_urls


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_report(table(spark, sf_dir, "documents"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_report(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_mixing": op2_mixing,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_simhash_dedup": op4_simhash_dedup,
        "op5_exact_topk": op5_exact_topk,
        "op6_secret_scan": op6_secret_scan,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_toxicity": op8_toxicity,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_embedding_dedup": op10_embedding_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.ORACLE, "op5_exact_topk": exact_topk.ORACLE, "op10_embedding_dedup": embedding_dedup.ORACLE}
