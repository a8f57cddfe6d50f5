"""Plumbing shared by the operators: shared tables, hashing, held-out splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialize, release, release_since, shared_dir, written  # noqa: F401

#: White space that separates words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Keys that are broadcast for their many rows, at most.
FREQUENT = 1_000


def meet(rows: DataFrame, keys: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with distinct ``keys`` that doesn't gather frequent keys.

    ``weight``: how many rows a key has; ``total``: a bound on their sum. A key with a
    share of 1/``FREQUENT`` or more is broadcast; there are at most that many.
    """
    often = F.col(weight) >= max(FREQUENT, total // FREQUENT)
    few = F.broadcast(keys.where(often))
    return rows.join(few, on).unionByName(rows.join(few.select(on), on, "left_anti").join(keys.where(~often), on))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, mod: int, rest: int) -> Column:
    """True where crc32 of the id as text leaves ``rest``; false for null ids."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(mod)) == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, limit: int | None) -> DataFrame:
    """Up to ``limit`` documents with a label, by smallest hash of the id; all of them without a limit.

    Held-out ids never appear. Ids with several labels use the smallest, ids with
    several texts the first in order: the sample has one row per id, ``limit`` at most.
    """
    picked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", mod, rest))
        .groupBy("doc_id")
        .agg(F.min(label).alias("_label"))
    )
    if limit is not None:
        picked = F.broadcast(picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    met = docs.select("doc_id", "text").join(picked, "doc_id")
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_label").alias("_label"))


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names that ``taken`` doesn't have, whatever the case of letters."""
    have = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema)
