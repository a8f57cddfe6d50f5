"""Checks: deduplication, superseding, deductions, score and band, amendments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points that a failed check costs, by severity; a warning costs one.
DEDUCTIONS = {"CRITICAL": 25, "HIGH": 8, "MEDIUM": 3, "LOW": 1, "INFO": 1}
#: Least deduction with one and with several critical failures.
ONE_CRITICAL, MORE_CRITICAL = 51, 81
#: Least scores of the bands.
BANDS = (("LOW", 80), ("MEDIUM", 50), ("HIGH", 20), ("CRITICAL", 0))
#: Which deterministic codes test the same as a model's code.
EQUIVALENT = {
    "SURVEY_NUMBER_MISMATCH": ("DET_SURVEY_MISMATCH", "DET_SURVEY_OCR_FUZZY", "DET_SURVEY_SUBDIVISION"),
    "STAMP_DUTY_SHORTFALL": ("DET_STAMP_DUTY_SHORT",),
    "OWNER_NAME_MISMATCH": ("DET_PARTY_NAME_MISMATCH",),
    "EXTENT_MISMATCH": ("DET_AREA_CONSISTENCY",),
    "RAPID_FLIPPING": ("DET_RAPID_FLIPPING",),
    "MULTIPLE_SALES": ("DET_MULTIPLE_SALES",),
    "BROKEN_CHAIN_OF_TITLE": ("DET_CHAIN_BREAK", "DET_CHAIN_CONTINUITY"),
    "BOUNDARY_CONSISTENCY": ("DET_BOUNDARY_MISMATCH", "DET_UNDISCLOSED_ENCUMBRANCE"),
    "SRO_JURISDICTION": ("DET_SRO_JURISDICTION",),
}


def deduction(status: Column, severity: Column) -> Column:
    points = F.coalesce(*(F.when(F.upper(severity) == s, F.lit(n)) for s, n in DEDUCTIONS.items()), F.lit(3))
    return F.when(F.upper(status) == "FAIL", points).when(F.upper(status) == "WARNING", F.lit(1)).otherwise(F.lit(0))


def band(score: Column) -> Column:
    return F.coalesce(*(F.when(score >= least, F.lit(name)) for name, least in BANDS))


def score(checks: DataFrame, by: list[str]) -> DataFrame:
    """Deduction, score and band of each case; critical failures set a floor."""
    critical = F.count_if((F.upper("status") == "FAIL") & (F.upper("severity") == "CRITICAL"))
    total = F.sum(deduction(F.col("status"), F.col("severity")))
    floor = F.when(critical >= 2, MORE_CRITICAL).when(critical == 1, ONE_CRITICAL).otherwise(0)
    out = checks.groupBy(*by).agg(F.least(F.greatest(total, floor), F.lit(100)).cast("long").alias("deduction"))
    return out.withColumn("score", 100 - F.col("deduction")).withColumn("band", band(F.col("score")))


def dedup(checks: DataFrame, scope: list[str]) -> DataFrame:
    """One row per rule code of a scope: the one with most warnings, truth and evidence."""
    richness = (
        F.coalesce(F.size("guardrail_warnings"), F.lit(0)) + F.coalesce(F.col("verified").cast("int"), F.lit(0)) + F.coalesce(F.length("evidence"), F.lit(0))
    )
    w = Window.partitionBy(*scope, F.when(F.col("rule_code") != "", F.col("rule_code")).otherwise(F.concat(F.lit("#"), F.col("pos")))).orderBy(richness.desc(), "pos")
    return checks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def supersede(checks: DataFrame, scope: list[str]) -> DataFrame:
    """A model's FAIL is SUPERSEDED where a deterministic check failed or passed on the same."""
    det = checks.where(F.col("source") == "deterministic").where(F.col("status").isin("FAIL", "PASS"))
    codes = det.groupBy(*scope).agg(
        F.collect_set(F.when(F.col("status") == "FAIL", F.col("rule_code"))).alias("_fail"), F.collect_set(F.when(F.col("status") == "PASS", F.col("rule_code"))).alias("_pass")
    )
    equal = F.create_map(*(x for k, v in EQUIVALENT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    joined = checks.join(codes, scope, "left").withColumn("_eq", F.try_element_at(equal, F.col("rule_code")))
    by_fail, by_pass = F.array_intersect("_eq", "_fail"), F.array_intersect("_eq", "_pass")
    model = (F.col("source") != "deterministic") & (F.col("status") == "FAIL")
    by = F.when(model & (F.size(by_fail) > 0), by_fail).when(model & (F.size(by_pass) > 0), by_pass)
    return joined.withColumn("superseded_by", by).withColumn("status", F.when(by.isNotNull(), "SUPERSEDED").otherwise(F.col("status"))).drop("_fail", "_pass", "_eq")


def group_summary(checks: DataFrame, by: list[str]) -> DataFrame:
    """Counts and deductions by group, with a total (group null)."""
    points = deduction(F.col("status"), F.col("severity"))
    return checks.rollup(*by).agg(
        F.count("*").alias("n_checks"), F.count_if(F.col("status") == "FAIL").alias("n_fail"), F.count_if(F.col("status") == "WARNING").alias("n_warning"), F.count_if(F.col("status") == "PASS").alias("n_pass"), F.sum(points).alias("deduction")
    )


def amend(checks: DataFrame, amendments: DataFrame, scope: list[str]) -> DataFrame:
    """Apply a review: the last amendment per rule counts; deterministic rows and FAIL to PASS don't change."""
    w = Window.partitionBy(*scope, "rule_code").orderBy(F.desc("pos"))
    last = amendments.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*scope, "rule_code", "amended_status", F.col("reason").alias("amend_reason"))
    joined = checks.join(last, [*scope, "rule_code"], "left")
    allowed = F.col("amended_status").isin("PASS", "WARNING", "FAIL", "INFO") & (F.col("source") != "deterministic") & ~((F.col("status") == "FAIL") & (F.col("amended_status") == "PASS"))
    return joined.withColumn("status", F.when(F.coalesce(allowed, F.lit(False)), F.col("amended_status")).otherwise(F.col("status"))).withColumn("amended", F.coalesce(allowed, F.lit(False))).drop("amended_status")


def pad_expected(checks: DataFrame, expected: DataFrame, scope: list[str]) -> DataFrame:
    """Rows for expected rules that no check answered."""
    absent = expected.join(checks.select(*scope, "rule_code").distinct(), [*scope, "rule_code"], "left_anti")
    stub = absent.select(*scope, "rule_code", F.lit("INFO").alias("severity"), F.lit("NOT_APPLICABLE").alias("status"), F.lit("no answer for an expected check").alias("explanation"))
    return checks.unionByName(stub, allowMissingColumns=True)
