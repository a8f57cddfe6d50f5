"""Merges, repairs, texts, gates and streams on small records."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from titleforge.operators import chunking, confidence, fact_store, guardrails, identity, merging, reports
from titleforge.sources.cases import CaseTables
from titleforge.streaming import progress

DOCS = "case_id string, doc_ord int, filename string, document_type string, data string"


def documents(spark, *docs):
    return spark.createDataFrame([("c", i, f"{i}.pdf", kind, json.dumps(d)) for i, (kind, d) in enumerate(docs)], DOCS)


def test_deed_parts_unite():
    a = {"seller": [{"name": "Murugan"}], "property": {"village": "", "boundaries": {"north": "road"}}, "ownership_history": [{"owner": "Old", "document_date": "2"}], "sro": "Adyar"}
    b = {"seller": [{"name": "Murugan S/o Raman", "age": "5"}, {"name": "Zubeida"}], "property": {"village": "V", "boundaries": {"south": "canal"}}, "ownership_history": [{"owner": "Elder", "document_date": "1"}], "sro": "x"}
    got = merging.deed([a, b])
    assert [p["name"] for p in got["seller"]] == ["Murugan S/o Raman", "Zubeida"] and got["sro"] == "Adyar"
    assert got["property"] == {"village": "V", "boundaries": {"north": "road", "south": "canal"}}
    assert [h["owner"] for h in got["ownership_history"]] == ["Elder", "Old"]


def test_other_parts_unite(spark):
    parts = [("d", "PATTA", 1, json.dumps({"survey_numbers": [{"survey_no": "1-2"}], "owner_names": [{"name": "A"}], "village": ""})), ("d", "PATTA", 2, json.dumps({"survey_numbers": [{"survey_no": "1/2", "extent": "3"}], "owner_names": [{"name": "a "}], "village": "V"})), ("d", "PATTA", 3, "oops")]
    rows = merging.merge_parts(spark.createDataFrame(parts, "doc string, document_type string, part int, data string"), ["doc"]).collect()
    got = json.loads(rows[0].data)
    assert got["survey_numbers"] == [{"survey_no": "1/2", "extent": "3"}] and len(got["owner_names"]) == 1 and got["village"] == "V" and got["extraction_notes"] == "Chunk 3 failed"
    assert merging.generic([{"key_dates": [1], "property_details": {"a": 1}}, {"key_dates": [1, 2], "property_details": {"a": 2}}])["key_dates"] == [1, 2]


def test_patta_repairs(spark):
    shape = "total_extent string, survey_numbers array<struct<survey_no:string,extent:string,classification:string>>, owner_names array<struct<name:string,father_name:string,share:string>>"
    row = ("7.92.50 hectares", [("317", "317.925 hectares", None), ("317", "317.925 hectares", "Wet"), ("9", "250 ha", None)], [("Raman", None, None), ("Sita", "Raman", None), ("Mani", None, None)])
    got = merging.repair_pattas(spark.createDataFrame([row], shape), F.lit(None).cast("string")).first()
    assert [(s.survey_no, s.extent, s.classification) for s in got.survey_numbers] == [("317", "0.9250 hectares", "Wet"), ("9", "250 ha", None)]
    assert got.total_extent == "251.8500 hectares" and got.extent_notes == ["survey 9: 250.00 ha", "total: 251.85 ha"]
    assert [(o.name, o.father_name) for o in got.owner_names] == [("Sita", "Raman"), ("Mani", None)]
    written = merging.repair_pattas(spark.createDataFrame([("1 ha", [], [("Raman", None, None), ("Sita", None, None)])], shape), F.lit("Raman W/o Sita, x")).first()
    assert [(o.name, o.father_name) for o in written.owner_names] == [("Sita", "Raman")]


def test_swapped_parties_and_past_transfers(spark):
    parties = spark.createDataFrame([(1, "seller", "Murugan"), (1, "buyer", "Zubeida"), (2, "seller", "Murugan"), (2, "buyer", "Zubeida")], "doc int, role string, name string")
    hints = spark.createDataFrame([(1, "seller", "Zubeida", False), (1, "buyer", "Murugan", False), (2, "seller", "Murugan", False), (2, "buyer", "Zubeida", False)], "doc int, role string, name string, garbage boolean")
    got = {(r.doc, r.name): r.role for r in merging.unswap(parties, hints).collect()}
    assert got == {(1, "Murugan"): "buyer", (1, "Zubeida"): "seller", (2, "Murugan"): "seller", (2, "Zubeida"): "buyer"}
    history = spark.createDataFrame([(1, 0, "Zubeida"), (1, 1, "Ponni"), (2, 0, "")], "doc int, pos int, owner string")
    assert {(r.doc, r.pos) for r in merging.past_transfers(history, parties.where("role = 'buyer'")).collect()} == {(1, 1), (2, 0)}


def test_header_override(spark):
    df = spark.createDataFrame([(("5", "", "T", "D"), ("6/1", "V", "X", None))], "r struct<survey_number:string,village:string,taluk:string,district:string>, h struct<survey_number:string,village:string,taluk:string,district:string>")
    got = df.select(merging.override_header(F.col("r"), F.col("h")).alias("x")).first().x
    assert (got.survey_number, got.village, got.taluk, got.district) == ("6/1", "V", "T", "D") and "corrected" in got.red_flag


def test_garbled_rows_are_flagged(spark):
    rows = spark.createDataFrame([("ாிீுூ", "Mani"), ("ab", None)], "seller_or_executant string, buyer_or_claimant string")
    assert [(r.seller_or_executant_confidence, r.buyer_or_claimant_confidence) for r in merging.flag_garbled(rows).collect()] == [("low", None), (None, None)]


def test_confidence_signals():
    assert confidence.assess(None, "FMB")["score"] == 0.0
    good = {"survey_number": "31/1", "village": "Velachery", "taluk": "Guindy", "boundaries": dict.fromkeys(("north", "south", "east", "west"), "x"), "remarks": "fine"}
    assert confidence.assess(good, "FMB") == {"score": 1.0, "trusted": True, "weak_fields": [], "fields": dict.fromkeys(("survey_number", "village", "taluk", "boundaries", "remarks"), 1.0)}
    poor = confidence.assess({**good, "village": "n/a", "remarks": "illegible scan"}, "FMB", "LOW")
    assert poor["score"] == pytest.approx(1 - 0.35 - 0.1 - 0.15) and poor["weak_fields"] == ["village"] and poor["fields"]["village"] == 0.75


def test_identity_of_roles(spark):
    deed = {"seller": [{"name": "Murugan S/o Raman"}], "buyer": ["Zubeida"]}
    t = CaseTables(documents(spark, ("SALE_DEED", {**deed, "buyer": [{"name": "Zubeida"}]}), ("CHITTA", {"owner_names": ["Murugan"]}), ("OTHER", {"key_parties": [{"name": "Ponni"}]})))
    roles = identity.shared_roles(t.resolved).first()
    assert sorted(map(list, roles.clusters)) == [["buyer"], ["party"], ["patta_owner", "seller"]]
    s = identity.summaries(t.resolved)
    names = {r.consensus_name: (r.confidence_band, r.mention_count) for r in s.collect()}
    assert names["Murugan S/o Raman"] == ("MODERATE", 2) and identity.with_role(s, "seller").count() == 1
    asked = spark.createDataFrame([("c", "Murugan R"), ("c", "Xavier")], "case_id string, name string")
    assert [r.name for r in identity.best_cluster(asked, t.resolved).collect()] == ["Murugan R"]
    assert identity.prompt_text(s).count() == 1


def test_compaction_tiers(spark):
    txn = {"transaction_id": "t", "seller_or_executant": "S" * 200, "remarks": "r" * 900, "schedule_remarks": "q" * 900, "suspicious_flags": ["f" * 900]}
    docs = documents(spark, ("EC", {"transactions": [txn]}))
    tier = lambda threshold, hard: reports.compact_certificates(docs, threshold, hard).first()
    assert [tier(10**6, 10).tier, tier(10, 10**6).tier, tier(10, 1200).tier, tier(10, 1100).tier, tier(10, 10).tier] == [0, 1, 2, 3, 4]
    last = json.loads(tier(10, 10).transactions)[0]
    assert "suspicious_flags" not in last and len(last["remarks"]) == 201 and len(last["seller_or_executant"]) == 81
    deed = reports.compact_deeds(documents(spark, ("SALE_DEED", {"special_conditions": [f"c{i}" for i in range(12)], "witnesses": ["a"] * 12, "property_description": "d" * 900}))).first()
    assert deed.special_conditions[-1] == "... and 2 more" and (len(deed.witnesses), deed.witness_count, len(deed.property_description)) == (10, 12, 801)


def test_flattened_texts_stay_whole(spark):
    record = {"patta_number": "5", "survey_numbers": [{"survey_no": f"{i}/1", "extent": "x" * 200} for i in range(9)], "conditions": ["c" * 1500, "short"], "boundaries": {"north": "road"}, "owner_names": [{"name": "A", "father_name": "B"}]}
    got = [r.text for r in reports.flatten(documents(spark, ("PATTA", record))).orderBy("page_number").collect()]
    assert sum("Survey Numbers" in t for t in got) == 3 and all(f"Survey {i}/1 | " in "".join(got) for i in range(9))
    assert any("A S/o B" in t for t in got) and any("c" * 1500 in t for t in got) and "North: road" in "".join(got)
    assert reports.consolidated(documents(spark, ("PATTA", record), ("FMB", {}))).first().text.startswith("=== PATTA: 0.pdf ===")


def test_chunks_overlap(spark):
    rows = spark.createDataFrame([("d", i, "x" * n) for i, n in enumerate([50, 50, 50, 50])], "doc string, at int, text string")
    got = [(r.chunk_index, r.first, r.last) for r in chunking.packed_with_overlap(rows, "doc", "at", "text", 120, 20).orderBy("chunk_index").collect()]
    assert got == [(0, 0, 1), (1, 1, 2), (2, 2, 3)]
    pages = spark.createDataFrame([("d", i, t) for i, t in enumerate(["Schedule", "x", "Boundaries", "Witness", "z"], 1)], "doc string, page int, text string")
    merged = chunking.section_chunks(pages, "doc", "page", "text").orderBy("chunk_index").collect()
    assert [(r.first, r.last) for r in merged] == [(1, 3), (4, 5)]


def test_roster_and_meta(spark):
    gated = spark.createDataFrame([("c", 2, "B", "HIGH", "look", ["FMB"], ["EC"]), ("c", 1, "A", "LOW", "see", ["EC"], ["EC"])], "case_id string, pos int, rule_code string, severity string, prompt string, enriched_by array<string>, available array<string>")
    assert guardrails.check_roster(gated, ["case_id"]).first().roster == "1. A (LOW): see\n   also read: EC\n2. B (HIGH): look"
    checks = spark.createDataFrame([("c", "X")], "case_id string, rule_code string")
    meta = spark.createDataFrame([("c", "X"), ("c", "Y"), ("c", "MISSING_DOCUMENTS")], "case_id string, rule_code string")
    assert {r.rule_code for r in guardrails.admitted_meta(meta, checks, ["case_id"]).collect()} == {"Y", "MISSING_DOCUMENTS"}


def test_flushes_and_tail(spark):
    t0 = datetime(2024, 1, 1)
    tokens = spark.createDataFrame([("s", t0 + timedelta(seconds=i), "x" * 200) for i in range(6)], "sid string, at timestamp, text string")
    assert [len(r.text) for r in progress.flushes(tokens, ["sid"]).orderBy("n").collect()] == [600, 600]
    events = spark.createDataFrame([(i, "completed" if i == 3 else "step") for i in range(4)], "event_id int, event_type string")
    assert progress.terminal(events).count() == 1 and [r.event_id for r in progress.after(events, 2).collect()] == [2, 3]


def test_breaker_opens(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    spark.createDataFrame([("a", t0 + timedelta(seconds=i), ok) for i, ok in enumerate([False, False, True, False, False, False, False])], "service string, ts timestamp, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("service string, ts timestamp, ok boolean").parquet(str(tmp_path / "in"))
    query = progress.breaker(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema("service string, opened timestamp, until timestamp").parquet(str(tmp_path / "out")).collect()
    assert [(r.service, (r.until - r.opened).total_seconds()) for r in rows] == [("a", 300.0)] and rows[0].opened == t0 + timedelta(seconds=5)


def test_report(spark, tmp_path):
    scores = spark.createDataFrame([("c", 92, "LOW")], "case_id string, score int, band string")
    checks = spark.createDataFrame([("c", "FAIL", "HIGH", "DET_X", "see deed_12ab34cd.pdf now")], "case_id string, status string, severity string, rule_code string, evidence string")
    place = spark.createDataFrame([("c", "V", "T", "D", ["1/2"])], "case_id string, village string, taluk string, district string, survey_numbers array<string>")
    links = spark.createDataFrame([("c", 1, "A", "B", "SALE")], "case_id string, sequence int, seller string, buyer string, transaction_type string")
    made = reports.report(scores, checks, place, links)
    text = made.first().report
    assert "Score 92, risk LOW" in text and ".pdf" not in text and "1. A → B (SALE)" in text
    reports.save_reports(made, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() > 5


def test_facts_of_some_keys_are_the_facts_of_those_keys(spark):
    lines = [{"row_number": i, "seller_or_executant": "A Raman, B Mani", "buyer_or_claimant": f"C{i % 3}", "consideration_amount": 100 + i, "transaction_type": "Sale", "survey_number": "1/2", "suspicious_flags": ["x"]} for i in range(12)]
    deed = {"seller": [{"name": "A Raman", "pan": "P", "age": "5"}], "buyer": {"name": "D"}, "property": {"survey_number": "3/1", "village": "V", "taluk": "Tambaram", "extent": "1 acre"}, "financials": {"consideration_amount": "900"}, "witnesses": ["W"], "special_conditions": ["s"]}
    patta = {"taluk": "Uthiramerur", "village": "V", "survey_numbers": [{"survey_no": "3/1", "extent": "2 acres", "classification": "wet"}], "owner_names": [{"name": "E"}], "_field_confidence": {"taluk": "0.5"}}
    other = {"key_parties": [{"name": "N", "role": "owner"}], "property_details": {"taluk": "X"}, "_extraction_red_flags": ["f"]}
    docs = documents(spark, ("EC", {"taluk": "Tambaram", "transactions": lines}), ("SALE_DEED", deed), ("PATTA", patta), ("LETTER", other)).persist()
    kinds, plain = ("EC", "SALE_DEED", "PATTA", None), ("doc_ord", "category", "key", "value", "context", "confidence", "transaction_id")

    def ordered(df):
        return [tuple(r[c] for c in plain) for r in sorted(df.collect(), key=lambda r: (r.doc_ord, r.pos))]

    every = ordered(fact_store.extract(docs, kinds))
    assert [f[3] for f in every if f[2] == "ec_executant"] == ["A Raman", "B Mani"] and [f[3] for f in every if f[2] == "ec_claimant"] == ["C0", "C1", "C2"]
    for keys in (("taluk",), ("ec_claimant", "ec_consideration", "seller_pan", "survey_3/1_class"), ("low_confidence_fields", "minor_party", "extraction_red_flag"), fact_store.CONFLICT_KEYS, ("nothing",)):
        assert ordered(fact_store.extract(docs, kinds, keys)) == [f for f in every if f[2] in keys]
    found = [sorted(map(tuple, fact_store.conflicts(fact_store.extract(docs, kinds[:3], keys)).collect())) for keys in (None, fact_store.CONFLICT_KEYS)]
    assert found[0] == found[1] and {f[2] for f in found[0]} == {"extent", "taluk", "buyer_vs_owner", "consideration_mismatch"}
