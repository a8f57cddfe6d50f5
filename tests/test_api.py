"""The functions that a user calls, over one case."""

import json

import pytest
from pyspark.sql import functions as F

from titleforge import api
from titleforge.sources import tables

EC = {"period_from": "01-01-2005", "period_to": "15-12-2023", "transactions": [{"row_number": 1, "date": "10-02-2008", "document_number": "1/2008", "transaction_type": "Sale", "seller_or_executant": "Raman", "buyer_or_claimant": "Murugan"}]}
DEED = {"document_number": "9/2015", "registration_date": "11-03-2015", "seller": [{"name": "Murugan"}], "buyer": [{"name": "Kid", "age": "12"}], "property": {"village": "Adyar"}}


def test_analysis(spark, tmp_path):
    rows = [("c", i, f"{i}.pdf", k, json.dumps(d)) for i, (k, d) in enumerate((("EC", EC), ("SALE_DEED", DEED)))]
    docs = spark.createDataFrame(rows, "case_id string, doc_ord int, filename string, document_type string, data string")
    a = api.Analysis(docs, "2024-01-01", only=["age_fraud", "party_names"], kinds=("EC", "SALE_DEED"))
    codes = {r.rule_code for r in a.checks.collect()}
    assert "DET_MINOR_PARTY" in codes and "DET_CHAIN_NAME_GAP" not in codes
    (score,) = a.scores.collect()
    assert score.score <= 49 and a.chain.count() == 2 and "Kid" in a.memory_bank().first().context
    assert "Question: why?" in a.chat(F.lit("why?")).first().prompt and "DET_MINOR_PARTY" not in a.report().first().report.split("## Chain")[1]
    assert api.query_knowledge_base(a.facts, category="party", key="buyer").first().value == "Kid" and api.tool(a.facts, "query_knowledge_base").count() > 3
    with pytest.raises(ValueError, match="no tool"):
        api.tool(a.facts, "other")
    saved = a.sessions(F.current_timestamp())
    tables.save_sessions(saved, str(tmp_path / "s"))
    assert api.status(saved, "c").first().status == "completed" and api.clear(saved, "c").count() == 0
    a.release()


def test_uploads(spark):
    rows = spark.createDataFrame([("/x/a.pdf", 9, bytearray(b"%PDF-1.4 x")), ("/x/b.txt", 9, bytearray(b"text")), ("/x/c.pdf", 3, bytearray(b"abc"))], "path string, length long, content binary")
    assert [r.refused for r in api.uploads(rows).collect()] == [None, "not a PDF", "empty or damaged"]
