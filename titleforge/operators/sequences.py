"""Events in order: gaps, jumps, disorder, first matches, range violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(rows: DataFrame, by: list[str], date: str, order: list[str]) -> DataFrame:
    """Days since the row before of the same key, and its date."""
    w = Window.partitionBy(*by).orderBy(date, *order)
    prior = F.lag(date).over(w)
    return rows.withColumn("prior_date", prior).withColumn("gap_days", F.datediff(F.col(date), prior))


def gap_tier(days: Column) -> Column:
    """FAIL under 180 days, WARNING under 365: how suspicious a quick resale is."""
    return F.when(days < 180, "FAIL").when(days < 365, "WARNING")


def out_of_order(rows: DataFrame, by: list[str], date: str, order: list[str]) -> DataFrame:
    """Rows dated before the last dated row ahead of them."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("last_date", F.last(date, ignorenulls=True).over(w)).where(F.col(date) < F.col("last_date"))


def scale_jumps(rows: DataFrame, by: list[str], amount: str, order: list[str], factor: float = 10.0) -> DataFrame:
    """Valued rows whose amount is ``factor`` times that of the valued row before, or the reverse."""
    w = Window.partitionBy(*by).orderBy(*order)
    valued = rows.where(F.col(amount) > 0).withColumn("prior_amount", F.lag(amount).over(w))
    ratio = F.greatest(F.col(amount) / F.col("prior_amount"), F.col("prior_amount") / F.col(amount))
    return valued.withColumn("ratio", ratio).where(F.col("ratio") >= factor)


def outside(rows: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Rows that lie outside a range of the same key, once per range."""
    return rows.join(ranges, key).where((F.col(at) < F.col(start)) | (F.col(at) > F.col(end)))


def first_match(rows: DataFrame, other: DataFrame, on: list[str], key: list[str], order: list[Column]) -> DataFrame:
    """Each row with the first row of ``other`` that matches it."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.join(other, on).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(a, b)


def pairwise(rows: DataFrame, by: list[str], pos: str, value: str, tolerance: float) -> DataFrame:
    """Pairs of the same key whose values differ by more than the tolerance of the greater."""
    a = rows.select(*by, F.col(pos).alias("pos_a"), F.col(value).alias("value_a"))
    b = rows.select(*by, F.col(pos).alias("pos_b"), F.col(value).alias("value_b"))
    return a.join(b, by).where(F.col("pos_a") < F.col("pos_b")).where(relative_difference(F.col("value_a"), F.col("value_b")) > tolerance)


def disjoint_pairs(rows: DataFrame, by: list[str], owner: str, member: str) -> DataFrame:
    """Pairs of owners of the same key whose sets of members share nothing."""
    sets = rows.groupBy(*by, owner).agg(F.collect_set(member).alias("members"))
    a = sets.select(*by, F.col(owner).alias("owner_a"), F.col("members").alias("members_a"))
    b = sets.select(*by, F.col(owner).alias("owner_b"), F.col("members").alias("members_b"))
    return a.join(b, by).where(F.col("owner_a") < F.col("owner_b")).where(~F.arrays_overlap("members_a", "members_b")).select(*by, "owner_a", "owner_b")


def richest(rows: DataFrame, key: list[str], richness: Column, pos: str) -> DataFrame:
    """The richest row of each key (the first of equals), with the first position of its key."""
    best = Window.partitionBy(*key).orderBy(richness.desc(), pos)
    first = Window.partitionBy(*key)
    return rows.withColumn("_r", F.row_number().over(best)).withColumn("first_pos", F.min(pos).over(first)).where("_r = 1").drop("_r")


def numbered_ids(rows: DataFrame, base: str, pos: str, out: str = "transaction_id") -> DataFrame:
    """Ids made unique: the second of the same base gets -2, and so on."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(pos))
    return rows.withColumn(out, F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n)))


def tail(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def within_budget(rows: DataFrame, by: list[str], order: str, size: Column, budget: int) -> DataFrame:
    """Rows in order as long as their sizes together stay within the budget."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)
