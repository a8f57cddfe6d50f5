"""Mixing sources to target weights, with DataFrame functions only.

The words of each source give its target: sources, in code-point order (null
last), weigh 5, 2, 1 over and over, and share ``SHARE`` times all words; no
target passes ``REPEAT`` times its source's words, and what is cut off is shared
anew by weight among the rest until nothing is above. A document is taken
floor(rate) times, and once more where its hash-seeded draw in [0, 1) is below
the rate's fraction. Of ``SEEDS`` fixed seeds each source uses the one whose
draws come nearest to its target, so that a few long documents don't decide.

Cases:

* null texts and texts without words have size 0 and are taken as often as the
  rate and the draw say; they add no words;
* null is a source of its own; a source without words has target 0;
* null ids draw like the empty id; repeated rows draw alike;
* other columns are kept by :func:`mixed`, and don't matter; columns that
  start with ``_mix_`` are taken for this module's own;
* an empty table gives an empty result; reruns agree.

The table of sources has a row per distinct source, not per document. It is
ordered in one streaming window that spills; it is broadcast only after a count
shows it small, and joined by shuffle with skew handling otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEAT = 2
SEEDS = 32
#: Sources up to which their table is broadcast (a row is under 200 bytes).
BROADCAST_SOURCES = 50_000
#: Hexadecimal digits of a draw: 52 bits, exact in a double.
_DIGITS = 13


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _draw(doc_id: str, seed: Column) -> Column:
    """A number in [0, 1) from the id and the seed; a digest holds two."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("#"), F.floor(seed / 2).cast("string")).cast("binary"))
    digits = F.substr(digest, F.lit(1) + F.lit(_DIGITS) * (seed % 2), F.lit(_DIGITS))
    return F.conv(digits, 16, 10).cast("long") / F.lit(2**52)


def targets(by_source: DataFrame) -> DataFrame:
    """source, source_size -> also target and rate."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        by_source.withColumn("_w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * REPEAT)
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_left", F.sum("source_size").over(every) * F.lit(SHARE) - F.coalesce(F.sum("_cap").over(fill), F.lit(0)))
        .withColumn("_level", F.col("_left") / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(fill), F.lit(0))))
        # in order of the ratio, sources are full up to the first whose share fits
        .withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(every))
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap").cast("double"))))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .select("source", "source_size", "target", "rate")
    )


def _with_sources(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    right = sources.select(*(F.col(c).alias(f"_mix_{c}") for c in sources.columns))
    if n_sources <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    return rows.join(right, rows["_mix_key"].eqNullSafe(right["_mix_source"]), "left")


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Sizes per document, and per source its target, rate and seed."""
    slim = materialize(docs.select(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_key"), size_of("text").alias("_mix_size")), "mix-sizes")
    by_source = slim.groupBy(F.col("_mix_key").alias("source")).agg(F.sum("_mix_size").alias("source_size"))
    sources = materialize(targets(by_source), "mix-targets")
    n = sources.count()
    joined = _with_sources(slim, sources, n)
    extra = [F.sum(F.when(_draw("_mix_id", F.lit(k)) < F.col("_mix_rate") - F.floor("_mix_rate"), F.col("_mix_size")).otherwise(0)) for k in range(SEEDS)]
    drawn = joined.groupBy(F.col("_mix_key").alias("_source")).agg(F.array(*extra).alias("_extra"))
    seeded = sources.join(drawn, F.col("source").eqNullSafe(F.col("_source")), "left")
    miss = F.transform("_extra", lambda x, i: F.struct(F.abs(F.floor("rate") * F.col("source_size") + x - F.col("target")).alias("miss"), i.alias("seed")))
    seeded = seeded.withColumn("seed", F.array_min(miss)["seed"].cast("int")).drop("_source", "_extra")
    return slim, materialize(seeded, "mix-seeds"), n


def _copies(doc_id: str) -> Column:
    rate = F.col("_mix_rate")
    return (F.floor(rate) + (_draw(doc_id, F.col("_mix_seed")) < rate - F.floor(rate)).cast("int")).cast("int")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, and the words taken from it."""
    slim, sources, n = plan(docs)
    return _with_sources(slim, sources, n).select(
        F.col("_mix_id").alias("doc_id"),
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_size") * _copies("_mix_id")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    _, sources, n = plan(docs)
    joined = _with_sources(docs.withColumn("_mix_key", F.col("source")), sources, n)
    return joined.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), _copies("doc_id")))).select(*docs.columns)


#: What :func:`mix_report` returns for ``documents``, as DuckDB SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s
), f AS (
  SELECT *, 2 * source_size AS cap, 2 * source_size / w AS ratio FROM w
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM f WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(max(CASE WHEN level <= ratio THEN level END) OVER () * w, CAST(cap AS DOUBLE))) AS target FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM t
), k AS (
  SELECT CAST(range AS INTEGER) AS seed FROM range(32)
), e AS (
  SELECT r.source, k.seed, any_value(floor(r.rate) * r.source_size - r.target) AS base,
    sum(CASE WHEN CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '#' || CAST(k.seed // 2 AS VARCHAR)), 1 + 13 * (k.seed % 2), 13) AS BIGINT) / 4503599627370496.0::DOUBLE < r.rate - floor(r.rate) THEN d.size ELSE 0 END) AS extra
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source CROSS JOIN k GROUP BY r.source, k.seed
), b AS (
  SELECT source, seed FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(base + extra), seed) = 1
)
SELECT d.doc_id, d.size, r.source_size, r.target,
  CAST(d.size * (floor(r.rate) + CASE WHEN CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '#' || CAST(b.seed // 2 AS VARCHAR)), 1 + 13 * (b.seed % 2), 13) AS BIGINT) / 4503599627370496.0::DOUBLE < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
