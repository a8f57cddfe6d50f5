"""Rules on small cases: what must fire, and what must not."""

import json

import pytest
from pyspark.sql import functions as F

from titleforge.operators import chain, identity, retrieval, rules, scoring
from titleforge.sources.cases import CaseTables

DAY = "2024-01-01"


def txn(**k):
    return {"transaction_type": "Sale", "survey_number": "311/1", **k}


def party(name, **k):
    return {"name": name, **k}


def tables(spark, *docs, case="c1"):
    rows = [(case, i, f"{kind.lower()}{i}.pdf", kind, json.dumps(data) if data is not None else None) for i, (kind, data) in enumerate(docs)]
    return CaseTables(spark.createDataFrame(rows, "case_id string, doc_ord int, filename string, document_type string, data string"))


def codes(t, *only):
    return {(r.rule_code, r.severity, r.status) for r in rules.run(t, DAY, list(only) or None).collect()}


EC = {
    "period_from": "01-01-2005",
    "period_to": "15-12-2023",
    "survey_number": "311/1",
    "transactions": [
        txn(date="10-02-2008", document_number="100/2008", seller_or_executant="Raman", buyer_or_claimant="Murugan", consideration_amount="5,00,000"),
        txn(date="11-03-2015", document_number="200/2015", seller_or_executant="Murugan", buyer_or_claimant="Lakshmi", consideration_amount="9,50,000"),
    ],
}
DEED = {
    "document_number": "200/2015",
    "registration_date": "11-03-2015",
    "seller": [party("Murugan", age="50", pan="ABCDE1234F")],
    "buyer": [party("Lakshmi", age="40", pan="PQRSX6789K")],
    "property": {"survey_number": "311/1", "village": "Chromepet", "taluk": "Tambaram", "district": "Chennai", "extent": "2400 sqft"},
    "financials": {"consideration_amount": "9,50,000", "guideline_value": "9,00,000", "stamp_duty": "66,512", "registration_fee": "38,000"},
}
PATTA = {"village": "Chromepettai", "taluk": "Tambaram", "owner_names": [{"name": "Lakshmi"}], "survey_numbers": [{"survey_no": "311/1", "extent": "2400 sqft"}], "total_extent": "2400 sqft"}


def test_clean_case(spark):
    got = codes(tables(spark, ("EC", EC), ("SALE_DEED", DEED), ("PATTA", PATTA)))
    assert {c for c in got if c[2] in ("FAIL", "WARNING")} == set()
    assert ("DET_BUYER_PATTA_MATCH", "HIGH", "PASS") in got and ("DET_CHAIN_CONTINUITY", "INFO", "PASS") in got


def test_empty_and_null_records(spark):
    assert codes(tables(spark, ("EC", None), ("SALE_DEED", None), ("PATTA", None), ("FMB", None))) == set()


def ec(**k):
    return "EC", {**EC, **k}


def deed(**k):
    return "SALE_DEED", {**DEED, **k}


CASES = [
    ([ec(period_from="01-01-2023")], "ec_period", ("DET_EC_SHORT_PERIOD", "CRITICAL", "FAIL")),
    ([ec(period_from="01-01-2012")], "ec_period", ("DET_EC_SHORT_PERIOD", "MEDIUM", "WARNING")),
    ([ec(period_to="01-06-2023")], "ec_period", ("DET_EC_STALE", "HIGH", "WARNING")),
    ([ec(period_from="01-01-2024")], "ec_period", ("DET_EC_PERIOD_INVALID", "CRITICAL", "FAIL")),
    ([ec(transactions=EC["transactions"][::-1])], "ec_period", ("DET_EC_CHRONO_ORDER", "MEDIUM", "WARNING")),
    ([ec(), deed(registration_date="11-03-2003")], "registration_within_ec", ("DET_REG_OUTSIDE_EC", "HIGH", "FAIL")),
    ([ec()], "limitation", ("DET_LIMITATION_PERIOD", "MEDIUM", "INFO")),
    ([deed(financials={**DEED["financials"], "stamp_duty": "20,000"})], "stamp_duty", ("DET_STAMP_DUTY_SHORT", "HIGH", "FAIL")),
    ([deed(financials={**DEED["financials"], "guideline_value": "20,00,000"})], "stamp_duty", ("DET_UNDERVALUATION", "HIGH", "WARNING")),
    ([deed(financials={"consideration_amount": "500"})], "plausibility", ("DET_IMPLAUSIBLE_LOW", "MEDIUM", "WARNING")),
    ([deed(property={"extent": "20000000 sqft"})], "plausibility", ("DET_IMPLAUSIBLE_EXTENT", "MEDIUM", "WARNING")),
    ([deed(property={"survey_number": "311/1", "extent": "3000 sqft"}), ("PATTA", PATTA)], "area_consistency", ("DET_AREA_MISMATCH", "HIGH", "FAIL")),
    ([deed(buyer=[party("Zubeida")], seller=[party("Quentin")]), ("PATTA", PATTA)], "party_names", ("DET_BUYER_PATTA_MISMATCH", "HIGH", "WARNING")),
    ([ec(), deed(seller=[party("Xavier")])], "party_names", ("DET_CHAIN_NAME_GAP", "HIGH", "WARNING")),
    ([deed(property={"survey_number": "400/2"}), ec()], "survey_numbers", ("DET_SURVEY_MISMATCH", "CRITICAL", "FAIL")),
    ([ec(transactions=[txn(date="01-01-2020"), txn(date="01-03-2020")])], "rapid_flipping", ("DET_RAPID_FLIPPING", "HIGH", "FAIL")),
    ([ec(transactions=[txn(seller_or_executant="A B", buyer_or_claimant="C D"), txn(seller_or_executant="A B", buyer_or_claimant="E F")])], "multiple_sales", ("DET_MULTIPLE_SALES", "CRITICAL", "FAIL")),
    ([ec(transactions=[txn(plot_number="Plot 12")]), deed(property={"plot_number": "15"})], "plot_identity", ("DET_PLOT_IDENTITY_MISMATCH", "CRITICAL", "FAIL")),
    ([ec(transactions=[txn(consideration_amount="10000"), txn(consideration_amount="500000")])], "financial_scale", ("DET_FINANCIAL_SCALE_JUMP", "HIGH", "WARNING")),
    ([ec(transactions=[txn(consideration_amount="100000"), txn(transaction_type="Mortgage", document_number="5/2019", consideration_amount="300000")])], "financial_scale", ("DET_ACTIVE_MORTGAGE_BURDEN", "HIGH", "WARNING")),
    ([deed(sro="Pollachi")], "sro_jurisdiction", ("DET_SRO_JURISDICTION", "CRITICAL", "FAIL")),
    ([deed(sro="Adyar")], "sro_jurisdiction", ("DET_SRO_JURISDICTION", "CRITICAL", "PASS")),
    ([deed(), ("PATTA", {**PATTA, "village": "Madurai"})], "multi_village", ("DET_MULTI_VILLAGE", "HIGH", "WARNING")),
    ([deed(buyer=[party("Kid", age="12")])], "age_fraud", ("DET_MINOR_PARTY", "CRITICAL", "FAIL")),
    ([deed(buyer=[party("Old", age="150")])], "age_fraud", ("DET_AGE_IMPOSSIBLE", "CRITICAL", "FAIL")),
    ([deed(registration_date="soon")], "field_formats", ("DET_UNPARSEABLE_DATE", "MEDIUM", "WARNING")),
    ([deed(remarks="ாிீுூ")], "garbled_tamil", ("DET_GARBLED_TAMIL", "HIGH", "WARNING")),
    ([deed(financials={"consideration_amount": "900000", "guideline_value": "900000", "stamp_duty": "900000"})], "fabrication", ("DET_DUPLICATE_VALUES", "LOW", "WARNING")),
    ([ec(transactions=[txn(consideration_amount="100000")] * 5)], "fabrication", ("DET_EC_IDENTICAL_AMOUNTS", "MEDIUM", "WARNING")),
    ([deed(property={"boundaries": json.dumps({"north": "house of Ravi"})}), ("FMB", {"boundaries": {"north": "canal"}})], "boundaries", ("DET_UNDISCLOSED_ENCUMBRANCE", "MEDIUM", "WARNING")),
    ([ec(), deed(financials={"consideration_amount": "20,00,000"})], "consideration", ("DET_CONSIDERATION_MISMATCH", "HIGH", "FAIL")),
    ([deed(buyer=[party("L", pan="123")])], "pan_numbers", ("DET_PAN_FORMAT_INVALID", "MEDIUM", "WARNING")),
    ([deed(buyer=[party("Lakshmi", pan="ABCDE1234F")])], "pan_numbers", ("DET_PAN_DUPLICATE_CROSS", "HIGH", "FAIL")),
    ([ec(), deed(previous_ownership={"document_date": "01-01-1990"})], "pre_ec_gap", ("DET_PRE_EC_GAP", "MEDIUM", "WARNING")),
    ([ec(transactions=[txn(seller_or_executant="Ram", buyer_or_claimant="Zubeida"), txn(seller_or_executant="Quentin", buyer_or_claimant="Bob")])], "continuity", ("DET_CHAIN_BREAK", "HIGH", "WARNING")),
]


@pytest.mark.parametrize("name", sorted({only for _, only, _ in CASES}))
def test_rule_fires(spark, name):
    """All cases of a rule are tables of one run, as in production."""
    own = [(docs, want) for docs, only, want in CASES if only == name]
    rows = [(f"case{k}", i, f"{kind.lower()}{i}.pdf", kind, json.dumps(data)) for k, (docs, _) in enumerate(own) for i, (kind, data) in enumerate(docs)]
    t = CaseTables(spark.createDataFrame(rows, "case_id string, doc_ord int, filename string, document_type string, data string"))
    got = {(r.case_id, r.rule_code, r.severity, r.status) for r in rules.run(t, DAY, [name]).collect()}
    for k, (_, want) in enumerate(own):
        assert (f"case{k}", *want) in got, (want, got)


def test_rules_ignore_row_order(spark):
    t = tables(spark, ("EC", EC), deed(property={"survey_number": "400/2"}), ("PATTA", PATTA))
    turned = CaseTables(t.documents.orderBy(F.desc("doc_ord")))
    assert codes(t, "survey_numbers", "multi_village", "consideration") == codes(turned, "survey_numbers", "multi_village", "consideration")


def test_score(spark):
    rows = [("a", "FAIL", "CRITICAL"), ("b", "FAIL", "CRITICAL"), ("b", "FAIL", "CRITICAL"), ("c", "WARNING", "HIGH"), ("c", "PASS", "LOW"), ("c", "SUPERSEDED", "CRITICAL"), ("d", "FAIL", "HIGH"), *[("e", "FAIL", "CRITICAL")] * 9]
    got = {r.case_id: (r.score, r.band) for r in scoring.score(spark.createDataFrame(rows, "case_id string, status string, severity string"), ["case_id"]).collect()}
    assert got == {"a": (49, "HIGH"), "b": (19, "CRITICAL"), "c": (99, "LOW"), "d": (92, "LOW"), "e": (0, "CRITICAL")}


def test_amendments(spark):
    checks = spark.createDataFrame([("c", "R1", "FAIL", "llm"), ("c", "R2", "WARNING", "llm"), ("c", "R3", "FAIL", "deterministic")], "case_id string, rule_code string, status string, source string")
    amends = spark.createDataFrame([("c", "R1", 0, "PASS", "x"), ("c", "R2", 1, "PASS", "x"), ("c", "R2", 2, "FAIL", "y"), ("c", "R3", 3, "WARNING", "z")], "case_id string, rule_code string, pos int, amended_status string, reason string")
    got = {r.rule_code: r.status for r in scoring.amend(checks, amends, ["case_id"]).collect()}
    assert got == {"R1": "FAIL", "R2": "FAIL", "R3": "FAIL"}


def test_clusters_complete_linkage(spark):
    assert identity.link(3, {(0, 1): 0.9, (1, 2): 0.8}) == [0, 0, 2]
    assert identity.link(3, {(0, 1): 0.9, (1, 2): 0.8, (0, 2): 0.6}) == [0, 0, 0]
    m = spark.createDataFrame([("c", 0, "Murugan"), ("c", 1, "Murugan S/o Raman"), ("c", 2, "Lakshmi"), ("d", 3, "Murugan")], "case_id string, pos int, name string")
    got = {(r.case_id, r.pos): r.cluster_id for r in identity.clusters(m, "case_id", "pos", "name").collect()}
    assert got == {("c", 0): 0, ("c", 1): 0, ("c", 2): 2, ("d", 3): 3}


def test_chain(spark):
    rows = spark.createDataFrame([("c", "2015-01-01", "A", "B", "sale", "1/2015", ""), ("c", None, "A", "B", "sale", "1/2015", "long note"), ("c", "2010-01-01", "Z", "A", "sale", "9/2010", ""), ("c", "2011-01-01", "N/A", "A", "sale", "x", "")], "case string, day string, s string, b string, k string, doc string, note string")
    c = F.col
    edges = chain.links(rows, c("case"), c("day").cast("date"), c("s"), c("b"), c("k"), c("doc"), c("note"), F.lit("ec"))
    got = chain.number(chain.dedup(edges)).orderBy("sequence").collect()
    assert [(r.seller, r.buyer, str(r.date)) for r in got] == [("Z", "A", "2010-01-01"), ("A", "B", "2015-01-01")]


def test_mmr(spark):
    rows = [(1, 1, [1.0, 0.0], 0.9), (1, 2, [1.0, 0.0], 0.89), (1, 3, [0.0, 1.0], 0.5)]
    got = retrieval.mmr(spark.createDataFrame(rows, "query_id long, chunk_id long, vec array<double>, relevance double"), 2, 0.5).orderBy("pick").collect()
    assert [r.chunk_id for r in got] == [1, 3]
