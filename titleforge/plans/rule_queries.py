"""The rules over cases made of the driver's tables, each with the SQL that states its checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from .cases import AS_OF, BASE, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_DAY = f"DATE '{AS_OF}'"
_SPAN = "p AS (SELECT case_id, min(day) AS s, max(day) AS e, count(*) AS n FROM t GROUP BY case_id)"


def _row(code: str, severity: str, status: str, source: str) -> str:
    lit = lambda x: x if x.startswith("CASE") else f"'{x}'"
    return f"SELECT case_id, {lit(code)} AS rule_code, {lit(severity)} AS severity, {lit(status)} AS status FROM {source}"


#: Per rule: CTEs besides the base, and the checks as (code, severity, status, rows).
STATED: dict[str, tuple[str, tuple[tuple[str, str, str, str], ...]]] = {
    "ec_period": (
        _SPAN + ", y AS (SELECT case_id, date_diff('day', s, e) / 365.25 AS y FROM p), late AS (SELECT DISTINCT case_id FROM (SELECT case_id, day, lag(day) OVER (PARTITION BY case_id ORDER BY pos) AS b FROM t) WHERE day < b)",
        (
            ("DET_EC_SHORT_PERIOD", "CASE WHEN y < 1 THEN 'CRITICAL' WHEN y < 10 THEN 'HIGH' ELSE 'MEDIUM' END", "CASE WHEN y < 10 THEN 'FAIL' ELSE 'WARNING' END", "y WHERE y < 13"),
            ("DET_EC_STALE", "HIGH", "WARNING", f"p WHERE date_diff('day', e, {_DAY}) > 30"),
            ("DET_EC_CHRONO_ORDER", "MEDIUM", "WARNING", "late"),
        ),
    ),
    "registration_within_ec": (_SPAN, (("DET_REG_OUTSIDE_EC", "HIGH", "FAIL", "(SELECT d.case_id FROM d JOIN p USING (case_id) WHERE registered < s OR registered > e)"),)),
    "limitation": ("x AS (SELECT 1)", (("DET_LIMITATION_PERIOD", "MEDIUM", "INFO", f"(SELECT DISTINCT case_id FROM t WHERE kind <> 'Mortgage' AND date_diff('day', day, {_DAY}) > 4380)"),)),
    "stamp_duty": (
        "x AS (SELECT 1)",
        (
            ("DET_STAMP_DUTY_SHORT", "HIGH", "FAIL", "d WHERE duty < 0.95 * (0.07 * CAST(greatest(paid, guide) AS DOUBLE))"),
            ("DET_UNDERVALUATION", "HIGH", "WARNING", "d WHERE guide > 0 AND paid < 0.8 * guide"),
        ),
    ),
    "plausibility": (
        "x AS (SELECT 1)",
        (
            ("DET_IMPLAUSIBLE_LOW", "MEDIUM", "WARNING", "d WHERE paid > 0 AND paid < 10000"),
            ("DET_IMPLAUSIBLE_LOW", "MEDIUM", "WARNING", "d WHERE guide > 0 AND guide < 10000"),
            ("DET_IMPLAUSIBLE_LOW", "MEDIUM", "WARNING", "d WHERE duty > 0 AND duty < 100"),
            ("DET_IMPLAUSIBLE_LOW", "MEDIUM", "WARNING", "d"),
            ("DET_IMPLAUSIBLE_HIGH", "MEDIUM", "WARNING", "d WHERE paid > 5e9 OR guide > 5e9 OR duty > 3.5e8"),
        ),
    ),
    "area_consistency": (
        "x AS (SELECT 1)",
        (
            ("DET_AREA_MISMATCH", "HIGH", "FAIL", "d WHERE CAST(nk * 10 AS DOUBLE) / (sqft + nk * 10) > 0.10"),
            ("DET_PATTA_PORTFOLIO", "LOW", "INFO", "d WHERE sqft * 2 > CAST(sqft + nk * 10 AS DOUBLE) * 1.1"),
        ),
    ),
    "party_names": (
        "c AS (SELECT d.*, CASE sub WHEN 1 THEN seller WHEN 2 THEN buyer ELSE 'Ponni' END AS owner, seller IN (SELECT buyer FROM t b WHERE b.case_id = d.case_id) AS claimed FROM d)",
        (
            ("CASE WHEN buyer = owner OR seller = owner THEN 'DET_BUYER_PATTA_MATCH' ELSE 'DET_BUYER_PATTA_MISMATCH' END", "CASE WHEN buyer <> owner AND seller = owner THEN 'MEDIUM' ELSE 'HIGH' END", "CASE WHEN buyer = owner THEN 'PASS' WHEN seller = owner THEN 'INFO' ELSE 'WARNING' END", "c"),
            ("DET_CHAIN_NAME_GAP", "HIGH", "WARNING", "c WHERE NOT claimed"),
        ),
    ),
    "survey_numbers": (
        "s AS (SELECT case_id, sub FROM t UNION SELECT case_id, 1 FROM d), n AS (SELECT case_id, count(*) AS n FROM s GROUP BY case_id)",
        (
            ("DET_EC_INTERNAL_SURVEY_INCONSISTENCY", "HIGH", "WARNING", "(SELECT DISTINCT case_id FROM t WHERE sub <> 1)"),
            ("DET_SURVEY_MISMATCH", "CRITICAL", "FAIL", "n WHERE n > 1"),
        ),
    ),
    "rapid_flipping": (
        "g AS (SELECT case_id, date_diff('day', lag(day) OVER (PARTITION BY case_id ORDER BY day, pos), day) AS gap FROM t WHERE kind = 'Sale'), f AS (SELECT DISTINCT case_id, CASE WHEN gap < 180 THEN 'FAIL' ELSE 'WARNING' END AS how FROM g WHERE gap < 365)",
        (("DET_RAPID_FLIPPING", "HIGH", "CASE WHEN how = 'FAIL' THEN 'FAIL' ELSE 'WARNING' END", "f"),),
    ),
    "multiple_sales": (
        "g AS (SELECT case_id, seller, count(DISTINCT buyer) AS b, count(*) AS n FROM t WHERE kind = 'Sale' GROUP BY ALL)",
        (("DET_MULTIPLE_SALES", "CASE WHEN b >= 2 THEN 'CRITICAL' ELSE 'HIGH' END", "CASE WHEN b >= 2 THEN 'FAIL' ELSE 'WARNING' END", "g WHERE b >= 2 OR n >= 3"),),
    ),
    "plot_identity": ("x AS (SELECT 1)", (("DET_PLOT_IDENTITY_MISMATCH", "CRITICAL", "FAIL", "d WHERE case_id % 50 <> case_id % 40"),)),
    "financial_scale": (
        "v AS (SELECT *, lag(amount) OVER (PARTITION BY case_id ORDER BY pos) AS b FROM t WHERE amount > 0), s AS (SELECT case_id, arg_max(amount, pos) AS sale FROM t WHERE kind = 'Sale' GROUP BY case_id), m AS (SELECT * FROM t WHERE kind = 'Mortgage' AND amount > 0)",
        (
            ("DET_FINANCIAL_SCALE_JUMP", "HIGH", "WARNING", "(SELECT DISTINCT case_id FROM v WHERE greatest(amount / b, b / amount) >= 10)"),
            ("DET_MORTGAGE_EXCEEDS_SALE", "HIGH", "WARNING", "(SELECT DISTINCT m.case_id FROM m JOIN s USING (case_id) WHERE sale > 0 AND amount > 2 * sale)"),
            ("DET_ACTIVE_MORTGAGE_BURDEN", "HIGH", "WARNING", "(SELECT m.case_id FROM m JOIN s USING (case_id) WHERE sale > 0 GROUP BY m.case_id, sale HAVING sum(amount) > 1.5 * sale)"),
        ),
    ),
    "sro_jurisdiction": ("x AS (SELECT 1)", (("DET_SRO_JURISDICTION", "CRITICAL", "CASE WHEN sub = 1 THEN 'PASS' ELSE 'FAIL' END", "d"),)),
    "multi_village": ("x AS (SELECT 1)", (("DET_MULTI_TALUK", "CRITICAL", "FAIL", "d WHERE sub = 2"),)),
    "age_fraud": (
        "x AS (SELECT 1)",
        (("DET_AGE_IMPOSSIBLE", "CRITICAL", "FAIL", "d WHERE nk * 6 > 120"), ("DET_MINOR_PARTY", "CRITICAL", "FAIL", "d WHERE nk * 6 < 18")),
    ),
    "field_formats": ("x AS (SELECT 1)", (("DET_UNPARSEABLE_DATE", "MEDIUM", "WARNING", "d WHERE false"),)),
    "garbled_tamil": ("x AS (SELECT 1)", (("DET_GARBLED_TAMIL", "HIGH", "WARNING", "d WHERE false"),)),
    "fabrication": (
        "n AS (SELECT case_id, count(*) AS n, count(*) FILTER (amount > 0) AS v, count(DISTINCT amount) FILTER (amount > 0) AS u FROM t GROUP BY case_id), "
        "w AS (SELECT case_id, who, count(*) FILTER (side = 1) AS b, count(*) FILTER (side = 0) AS s FROM (SELECT case_id, buyer AS who, 1 AS side FROM t UNION ALL SELECT case_id, seller, 0 FROM t) GROUP BY ALL)",
        (
            ("DET_EC_IDENTICAL_AMOUNTS", "MEDIUM", "WARNING", "n WHERE v >= 5 AND u = 1"),
            ("DET_REPEATED_PARTY", "LOW", "WARNING", "(SELECT w.case_id FROM w JOIN n USING (case_id) WHERE n >= 5 AND CASE WHEN b > 0 THEN b ELSE s END >= 5 AND CASE WHEN b > 0 THEN b ELSE s END >= 0.8 * n)"),
            ("DET_ZERO_UNCERTAINTY", "LOW", "INFO", "n WHERE n >= 15"),
        ),
    ),
    "boundaries": (
        "x AS (SELECT 1)",
        (("DET_BOUNDARY_MISMATCH", "HIGH", "WARNING", "d"), ("DET_UNDISCLOSED_ENCUMBRANCE", "MEDIUM", "WARNING", "d")),
    ),
    "consideration": (
        "m AS (SELECT d.case_id, d.paid, t.amount, row_number() OVER (PARTITION BY d.case_id ORDER BY t.pos) AS k FROM d JOIN t ON d.case_id = t.case_id AND t.amount > 0 AND (contains(CAST(d.o_orderkey AS VARCHAR), CAST(t.o_orderkey AS VARCHAR)) OR contains(CAST(t.o_orderkey AS VARCHAR), CAST(d.o_orderkey AS VARCHAR))) WHERE d.paid > 0)",
        (("DET_CONSIDERATION_MISMATCH", "HIGH", "FAIL", "m WHERE k = 1 AND abs(paid - amount) / CAST(greatest(paid, amount) AS DOUBLE) > 0.05"),),
    ),
    "pan_numbers": ("x AS (SELECT 1)", (("DET_PAN_FORMAT_INVALID", "MEDIUM", "WARNING", "d WHERE sub = 3"),)),
    "pre_ec_gap": (_SPAN, (("DET_PRE_EC_GAP", "MEDIUM", "WARNING", "p WHERE date_diff('day', DATE '1990-01-01', s) > 365"),)),
    "continuity": (
        "l AS (SELECT case_id, buyer, lead(seller) OVER (PARTITION BY case_id ORDER BY pos) AS nx FROM t), k AS (SELECT case_id, count(*) AS n, count(*) FILTER (nx IS NOT NULL AND buyer <> nx) AS gaps FROM l GROUP BY case_id)",
        (("DET_CHAIN_BREAK", "HIGH", "WARNING", "l WHERE nx IS NOT NULL AND buyer <> nx"), ("DET_CHAIN_CONTINUITY", "INFO", "PASS", "k WHERE n >= 2 AND gaps = 0")),
    ),
}


def _query(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rules.run(tables(spark, sf), AS_OF, [name]).select(F.col("case_id"), "rule_code", "severity", "status")

    run.__name__ = run.__qualname__ = f"rule_{name}"
    run.__doc__ = rules.RULES[name].__doc__
    return run


for _name, (_ctes, _checks) in STATED.items():
    QUERIES[f"rule_{_name}"] = _query(_name)
    SQL[f"rule_{_name}"] = f"WITH {BASE}, {_ctes}\n" + "\nUNION ALL ".join(_row(*c) for c in _checks)
