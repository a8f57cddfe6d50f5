"""From raw documents to token ids: five stages, each written and read again.

Every stage works on all rows that the one before kept; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from titleforge.llm._common import materialize, release_since, table, written
from titleforge.llm.mixing import mixed
from titleforge.llm.quality_classifier import keep_good
from titleforge.llm.secret_scan import redacted
from titleforge.llm.sentencepiece_codec import encode_documents
from titleforge.llm.simhash_dedup import deduplicated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the ranking rejects."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask credentials; every document stays."""
    return redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents until sources have their target weights."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, exact of every document."""
    return encode_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mix", mix), ("encode", encode)]

#: The first stage is a learned model, which SQL can't express; tests compare every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release_since(before, docs)  # the stage before, and what this one needed
    return STAGES[-1][1](spark, docs, sf_dir)
