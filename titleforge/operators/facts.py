"""Facts as rows (category, key, value, source): unpivot, cross references, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("property", "party", "financial", "timeline", "encumbrance", "chain", "reference", "risk")


def unpivot(rows: DataFrame, source: Column, kind: str, fields: list[tuple[str, str, Column]], keep: list[str]) -> DataFrame:
    """One fact for each field with a value: (category, key, value)."""
    each = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(k).alias("key"), v.cast("string").alias("value")) for c, k, v in fields))
    out = rows.select(*keep, source.cast("string").alias("source_file"), F.lit(kind).alias("source_type"), F.explode(each).alias("_f"))
    return out.select(*keep, "source_file", "source_type", "_f.*").where(F.col("value").isNotNull() & (F.trim("value") != ""))


def summary(facts: DataFrame, by: list[str]) -> DataFrame:
    """Facts per category, with a total (category null)."""
    return facts.rollup(*by).agg(F.count("*").alias("n_facts"))


def cross_references(facts: DataFrame, scope: list[str]) -> DataFrame:
    """Keys that several sources state, and whether they agree."""
    v = F.lower(F.trim("value"))
    return (
        facts.groupBy(*scope, "category", "key")
        .agg(F.countDistinct("source_file").alias("n_sources"), F.countDistinct(v).alias("n_values"))
        .where("n_sources > 1")
        .withColumn("consistent", F.col("n_values") == 1)
    )


def conflicts(facts: DataFrame, scope: list[str]) -> DataFrame:
    """Keys with different values in different sources; each value with its sources' number."""
    values = facts.groupBy(*scope, "category", "key", F.lower(F.trim("value")).alias("v")).agg(F.countDistinct("source_file").alias("n"))
    return (
        values.groupBy(*scope, "category", "key")
        .agg(F.count("*").alias("n_values"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v", "n"))), lambda s: F.concat(s["v"], F.lit("="), s["n"])), ";").alias("conflicting_values"))
        .where("n_values > 1")
    )


def money_conflict(a: Column, b: Column) -> Column:
    """Whether two sets of amounts share nothing."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def extent_conflict(first: Column, other: Column) -> Column:
    """More than a tenth apart; without numbers, different texts."""
    from ..functions.scalars import parse_area

    x, y = parse_area(first), parse_area(other)
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) / F.greatest(x, y) > 0.10).otherwise(F.lower(F.trim(first)) != F.lower(F.trim(other)))


def lookup(facts: DataFrame, category: str | None = None, key: str | None = None, source_file: str | None = None) -> DataFrame:
    """Facts of a source, else of a category, else of a key; without any, all."""
    if source_file:
        return facts.where(F.col("source_file") == source_file)
    if category:
        facts = facts.where(F.col("category") == category)
    return facts.where(F.lower(F.trim("key")) == key.strip().lower()) if key else facts


def context_text(facts: DataFrame, scope: list[str]) -> DataFrame:
    """All facts of a scope as lines, sorted."""
    line = F.format_string("[%s] %s = %s (%s)", "category", "key", "value", "source_file")
    return facts.groupBy(*scope).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("context"))
