"""Scalar functions and checks over texts made of the driver's tables, with SQL.

Where a text is written here from known values, the SQL states those values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning, jurisdiction, names, preparse, scalars, surveys, tamil
from ..operators import classify, confidence, fact_store, guardrails, merging, pages, reports, rules, scoring
from ..sources.shared import materialize
from ..sources.tables import load, safe_filename
from .cases import BASE, CASE_KINDS, documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _among(texts: list[str], key: str) -> Column:
    """One of the listed texts per row."""
    return F.element_at(F.array(*map(F.lit, texts)), (F.pmod(F.col(key), F.lit(len(texts))) + 1).cast("int"))


def _fixed(name: str, f: Callable[[Column], Column], pairs: list[tuple[str, str | None]], doc: str) -> None:
    """A query of a text function over every part, which takes each of the listed texts in turn."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        taken = load(spark, sf, "part").select("p_partkey", _among([a for a, _ in pairs], "p_partkey").alias("text"))
        return taken.select("p_partkey", f(F.col("text")).cast("string").alias("value"))

    run.__name__ = run.__qualname__ = name
    run.__doc__ = doc
    QUERIES[name] = run
    SQL[name] = f"SELECT p_partkey, list_extract([{', '.join(_quoted(b) for _, b in pairs)}], CAST(p_partkey % {len(pairs)} + 1 AS INTEGER)) AS value FROM part"


# --- money, areas, ages --------------------------------------------------


@query("""
SELECT p_partkey, p_size * 43560.0 + (p_partkey % 90) * 435.6 AS sqft, (p_size * 107639.0) AS hectares, p_size * 100.0 AS bare FROM part
""")
def area_values(spark: SparkSession, sf: str) -> DataFrame:
    size, k = F.col("p_size").cast("string"), (F.col("p_partkey") % 90).cast("string")
    return load(spark, sf, "part").select(
        "p_partkey", scalars.parse_area(F.concat(size, F.lit(" acres "), k, F.lit(" cents"))).alias("sqft"), scalars.parse_area(F.concat(size, F.lit(" Hectares"))).alias("hectares"), scalars.parse_area(F.concat(size, F.lit("00"))).alias("bare")
    )


@query(r"""
WITH a AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders), x AS (SELECT *, CAST(n AS VARCHAR) AS s FROM a)
SELECT o_orderkey, CASE WHEN length(s) <= 3 THEN s ELSE reverse(regexp_replace(regexp_replace(reverse(s[:-4]), '([0-9]{2})', '\1,', 'g'), ',$', '')) || ',' || s[-3:] END AS grouped,
  CASE WHEN n >= 100000 THEN format('₹{:.2f} L', n / 100000.0) ELSE NULL END AS short FROM x
""")
def rupee_texts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.floor("o_totalprice").cast("double")
    return load(spark, sf, "orders").select("o_orderkey", scalars.indian_grouping(n).alias("grouped"), F.when(n >= 100_000, cleaning.short_rupees(n)).alias("short"))


@query("SELECT o_orderkey, true AS plain, true AS grouped, n >= 100000 AS scaled FROM (SELECT o_orderkey, floor(o_totalprice) AS n FROM orders)")
def rupee_forms(spark: SparkSession, sf: str) -> DataFrame:
    """An amount is found in a text however it is written."""
    n = F.floor("o_totalprice")
    forms = cleaning.rupee_forms(F.concat(F.lit("₹ "), n.cast("string")))
    written = F.concat(scalars.fixed(n / 1e5, 2), F.lit(" lakh"))
    return load(spark, sf, "orders").select("o_orderkey", F.array_contains(forms, n.cast("string")).alias("plain"), F.array_contains(forms, F.when(n >= 1000, scalars.indian_grouping(n.cast("double"))).otherwise(n.cast("string"))).alias("grouped"), F.array_contains(forms, written).alias("scaled"))


@query("""
WITH a AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS n FROM orders)
SELECT o_orderkey, n AS age_days, n <= 30 AS valid_30_days, n / 365.25 <= 3 AS within_3_years, n / 365.25 <= 1 AS recent FROM a
""")
def age_checks(spark: SparkSession, sf: str) -> DataFrame:
    c = reports.age_checks(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("2001-08-01").cast("date"))
    return load(spark, sf, "orders").select("o_orderkey", c["age_days"].cast("long").alias("age_days"), c["valid_30_days"].alias("valid_30_days"), c["within_3_years"].alias("within_3_years"), c["recent"].alias("recent"))


_fixed("zero_values", cleaning.is_zero, [("0", "true"), ("0.00", "true"), ("₹0", "true"), ("Rs. 0", "true"), ("10", "false"), ("", "false")], "Written zeros.")
_fixed("guideline_kinds", lambda c: reports.guideline(c)["classification"], [(" Tambaram ", "urban"), ("Avadi", "urban"), ("Melur", "rural"), ("", "rural")], "Urban and rural taluks.")
_fixed("data_confidence_bands", lambda c: confidence.band(c.cast("double")), [("0.9", "HIGH"), ("0.85", "HIGH"), ("0.65", "MODERATE"), ("0.5", "LOW"), ("0.1", "VERY_LOW")], "Bands of a check's data.")

# --- survey numbers ------------------------------------------------------


@query("""
SELECT p_partkey, (p_partkey + 10) || '/' || p_size || 'b' AS normal, 'SF' AS kind, CAST(p_partkey + 10 AS VARCHAR) AS base, CAST(p_size AS VARCHAR) AS sub, 'b' AS subsub, true AS valid FROM part
""")
def survey_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Normal forms and parts of survey numbers with prefixes, Tamil letters and dashes."""
    text = F.concat(F.lit("S.F. No. "), (F.col("p_partkey") + 10).cast("string"), F.lit(" - "), F.col("p_size").cast("string"), F.lit("பி"))
    normal = surveys.normalize_survey(text)
    p = surveys.survey_parts(normal)
    return load(spark, sf, "part").select("p_partkey", normal.alias("normal"), surveys.survey_kind(text).alias("kind"), p["base"].alias("base"), p["sub"].alias("sub"), p["subsub"].alias("subsub"), normal.rlike(surveys.VALID).alias("valid"))


@query("""
SELECT p_partkey, 'exact' AS same, 'subdivision' AS parent, 'mismatch' AS other, CASE WHEN length(CAST(p_partkey + 1000 AS VARCHAR)) + 2 >= 5 THEN 'ocr_fuzzy' END AS misread, (p_partkey + 1000) || ',7/1' AS split, true AS any FROM part
""")
def survey_matches(spark: SparkSession, sf: str) -> DataFrame:
    """How survey numbers match: the same, a subdivision, another, a misread letter; lists of them."""
    k = (F.col("p_partkey") + 1000).cast("string")
    of = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    listed = of(k, ", 7/1; 4-3")
    pairs = [(of("SF No ", k, "/2"), of(k, "/2"), "same"), (k, of(k, "/2"), "parent"), (of(k, "/1"), of(k, "/2"), "other"), (of(k, "ax"), of(k, "bx"), "misread")]
    split = surveys.split_surveys(listed)
    return load(spark, sf, "part").select(
        "p_partkey", *(surveys.match_pairs(surveys.normalize_survey(a), surveys.normalize_survey(b)).alias(n) for a, b, n in pairs), F.array_join(split, ",").alias("split"), (surveys.any_survey_kind(split, F.array(F.lit("9"), F.lit("7-1"))) == "exact").alias("any")
    )


# --- names and places ----------------------------------------------------

_fixed("name_normal_forms", names.normalize_name, [("Mr. K. Ramesh  Kumar", "ramesh kumar"), ("Smt. Lakshmi", "lakshmi"), ("S/o Raman", "raman"), ("  VENKAT  ", "venkat"), ("Thiru. A. B. Mani", "mani")], "Names without titles and initials.")
_fixed("given_names", lambda c: F.concat_ws("|", names.name_parts(c)["given"], names.name_parts(c)["patronymic"]), [("Mr. Murugan S/o Raman", "murugan|raman"), ("Lakshmi wife of Mani", "lakshmi|mani"), ("ராமன் மனைவி சீதா", "சீதா|ராமன்"), ("கண்ணன் மகன் வேலன்", "கண்ணன்|வேலன்"), ("Kumar", "kumar|")], "Given name and patronymic.")
_fixed("party_splits", lambda c: F.array_join(names.split_parties(c), "|"), [("A Raman and B Mani", "A Raman|B Mani"), ("Sita, Gita", "Sita|Gita"), ("X & Y, and Z", "X|Y|Z"), ("ஒன்று மற்றும் இரண்டு", "ஒன்று|இரண்டு"), ("Anand", "Anand")], "Parties of a text.")
_fixed("village_normal_forms", names.normalize_village, [("Chromepet", "chromepettai"), ("Kancheepuram (Rural)", "kancheepuram"), ("Anna Nagaram", "anna nagar"), ("Vellaloor", "vellalur"), ("Sowripalayam.", "sowripalayam")], "Villages without tags, endings in one spelling.")
_fixed("phonetic_forms", names.phonetic, [("somaiyampaalaiyam", "somayampalayam"), ("chomaiyampalaiyam", "somayampalayam"), ("thiruvanmiyuur", "tiruvanmiyur"), ("koozhi", "koli")], "Sounds that spellings confuse.")
_fixed("district_forms", jurisdiction.normalize_district, [("Kovai", "coimbatore"), (" Madras", "chennai"), ("தஞ்சாவூர்", "thanjavur"), ("Trichy", "tiruchirappalli"), ("Somewhere", "somewhere")], "Districts in one spelling.")
_fixed("office_districts", jurisdiction.office_district, [("Adyar", "chennai"), ("Pollachi ", "coimbatore"), ("Gingee", "villupuram"), ("tuticorin", "thoothukudi"), ("Nowhere", None)], "Districts of registrars' offices.")
_fixed("boundary_features", lambda c: F.array_join(rules.features(c), ","), [("Temple Road!", "road,temple"), ("house of Ravi", ""), ("கிழக்கே வாய்க்கால்", "வாய்க்கால்"), ("Water-channel", "water channel"), ("", "")], "Features that a boundary names.")
_fixed("owner_keys", merging.owner_key, [("K. Raman", "raman"), (" A. B. Sita Devi", "sitadevi"), ("என். வேலன்", "எனவேலன்"), ("", "")], "Owners' names for comparison.")
_fixed("garbage_names", preparse.garbage_name, [("Anna Nagar West", "true"), ("மதுரை மாவட்டம்", "true"), ("Rav", "true"), ("Ravi Kumar", "false"), ("ராமசாமி", "false")], "Captures that are no names.")
_fixed("pan_formats", lambda c: c.rlike(rules.PAN), [("ABCDE1234F", "true"), ("ABCD1234F", "false"), ("abcde1234f", "false"), ("ABCDE12345", "false")], "Well-formed PANs.")
_fixed("village_matches", lambda c: names.village_pairs(F.get(F.split(c, r"\|"), 0), F.get(F.split(c, r"\|"), 1)), [("Chromepet|Chromepettai", "exact"), ("Velachery|Velacheri", "fuzzy"), ("சென்னை|Chennai", "cross_script"), ("Madurai|Chennai", "mismatch"), ("|Chennai", "mismatch")], "Villages in two spellings.")

# --- Tamil ---------------------------------------------------------------

_fixed("tamil_digits", scalars.ascii_digits, [("௩௧௭", "317"), ("Survey ௩/௧", "Survey 3/1"), ("12", "12")], "Tamil digits.")
_fixed("tamil_repairs", tamil.fix_orphans, [("ெபான்அரசி", "பொன்அரசி"), ("ா", ""), ("முருகன்", "முருகன்"), ("abc", "abc")], "Vowel signs put behind their consonants.")
_fixed("tamil_spellings", tamil.transliterate, [("சென்னை", "chennai"), ("வெள்ளலூர்", "vellaluur"), ("மதுரை", "mathurai"), ("முருகன்", "murukan"), ("ெபான்அரசி", "ponarachi"), ("Chennai", "Chennai")], "Latin letters for Tamil ones.")
_fixed("tamil_damage", lambda c: F.concat_ws("|", tamil.garbled(c)["is_garbled"].cast("string"), tamil.garbled(c)["reason"]), [("ாிீுூ", "true|orphan vowel signs"), ("முருகன்", "false|clean Tamil"), ("Raman", "false|not Tamil text"), ("முருகन्नन", "true|other Indic scripts mixed in")], "Damaged Tamil and why.")

# --- texts ---------------------------------------------------------------

_fixed("ocr_normal_forms", pages.normalize_ocr, [("S. F. No: ௩௧௭ on 15.03.2012", "S.F.No. 317 on 15-03-2012"), ("a\n\n\n\n\nb", "a\n\nb"), ("(R) (R) (R) (R) x", "(R)x"), ("ெபான்", "பொன்")], "OCR text before extraction.")
_fixed("runaway_texts", pages.repeats, [("survey no 317 scale 1:100 " * 4, "true"), ("mani, " * 12, "true"), ("a plain sentence that says nothing twice in a row at all", "false"), ("ab" * 10, "false")], "Runaway repetition.")
_fixed("thoughts_removed", cleaning.without_thoughts, [("<think>a\nb</think> {}", "{}"), ("<|start_thinking|>x<|end_thinking|>ok", "ok"), ("plain", "plain")], "Answers without thoughts.")
_fixed("file_groups_removed", cleaning.strip_file_groups, [("see (download (4)_766e8f43.pdf) now", "see now"), ("keep (this) one", "keep (this) one"), ("open (a.pdf", "open")], "References to files in parentheses.")
_fixed("clean_explanations", cleaning.sanitize_explanation, [("DET_AREA_MISMATCH shows a gap (Group 2) .", "shows a gap."), ("Fine.\n[Self-Reflection Amendment] changed", "Fine."), ("In deed_12ab34cd.pdf, the seller [garbled OCR] signs (Confidence: 80% - HIGH)", "the seller signs"), ("Plain.", "Plain.")], "Explanations without internals.")
_fixed("answers_parsed", cleaning.answer_json, [('{"a": 1}', '{"a":1}'), ('text {"a": [1, 2]} more', '{"a":[1,2]}'), ('```json\n{"b": 2}\n```', '{"b":2}'), ('{"a": [1, 2,],}', '{"a":[1,2]}'), ('{"a": {"b": 1', '{"a":{"b":1}}'), ("no json", None)], "The JSON of answers.")
_fixed("file_names", safe_filename, [("C:\\x\\deed 1.pdf", "deed 1.pdf"), ("../a/b?.pdf", "b_.pdf"), ("plain.pdf", "plain.pdf")], "Safe names of uploads.")
_fixed("concerns_told", lambda c: F.array_join(cleaning.concerns(c), "|"), [("This deed looks suspicious to any reader. All is well here though. This deed looks suspicious to any reader.", "This deed looks suspicious to any reader"), ("Nothing to report in this long enough sentence of text.", "")], "Sentences that tell of a concern.")
_fixed("failure_signals", lambda c: guardrails.first_said(c, guardrails.SIGNALS), [("an active mortgage is there", "active mortgage"), ("there is no active mortgage", None), ("no shortfall in the first of these many years, yet then a shortfall of 5", "shortfall"), ("fine", None)], "Signals that aren't negated.")


@query(r"""
SELECT p_partkey, list_extract(['EC', 'PATTA', 'SALE_DEED', 'WILL', 'GIFT_DEED', 'FMB'], CAST(p_partkey % 6 + 1 AS INTEGER)) AS kind, 0.85 AS confidence FROM part
""")
def keyword_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of documents by the words that mark them."""
    text = _among(["Encumbrance Certificate for", "பட்டா எண் 5", "This Sale Deed of", "my Last Will and", "a Gift Deed by", "Field Measurement Book"], "p_partkey")
    k = classify.keyword_kind(F.concat(text, F.lit(" no. "), F.col("p_partkey").cast("string")), F.lit("a.pdf"))
    return load(spark, sf, "part").select("p_partkey", k["kind"].alias("kind"), k["confidence"].alias("confidence"))


@query("""
SELECT doc_id, CASE WHEN length(regexp_replace(text, '^ +| +$', '', 'g')) >= 50 AND len(regexp_extract_all(text, '\\S+')) >= 10 THEN 'HIGH' ELSE 'LOW' END AS quality FROM documents
""".replace("\\\\", "\\"))
def light_quality(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", pages.light_quality(F.col("text")).alias("quality"))


@query("""
SELECT doc_id, length(trim(text)) > 50 AS by_cid, false AS same FROM documents
""")
def ocr_replacement(spark: SparkSession, sf: str) -> DataFrame:
    """Whether recognised text replaces a page's own: always for (cid:) pages, never if it is the same."""
    t = F.col("text")
    return load(spark, sf, "documents").select("doc_id", pages.take_ocr(F.lit(""), t, F.lit(True)).alias("by_cid"), pages.take_ocr(t, t, F.lit(False)).alias("same"))


# --- records and checks --------------------------------------------------


@query(f"""WITH {BASE}
SELECT case_id, 'EC' AS document_type, false AS trusted, CAST(2 AS INTEGER) AS n_weak FROM d WHERE false
UNION ALL SELECT case_id, 'FMB', true, CAST(3 AS INTEGER) FROM d
""")
def extraction_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches without village, taluk and remarks are just trusted; half of their sides is enough."""
    fmb = documents(spark, sf).where("document_type = 'FMB'").withColumn("extraction_quality", F.lit("HIGH"))
    c = confidence.with_confidence(fmb)
    return c.select("case_id", "document_type", "trusted", F.size("weak_fields").alias("n_weak"))


@query(f"""WITH {BASE}
SELECT case_id, 'survey_number' AS key, CAST(3 AS BIGINT) AS n FROM d
""")
def fact_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of one key, by source."""
    f = fact_store.extract(documents(spark, sf), CASE_KINDS)
    return f.where("category = 'property' and key = 'survey_number'").groupBy("case_id", "key").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'MEDIUM' WHEN 'O' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'PASS' ELSE 'WARNING' END AS status,
  o_orderstatus = 'P' AS unverified, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS INTEGER) AS n_warnings
FROM orders
""")
def guarded_checks(spark: SparkSession, sf: str) -> DataFrame:
    """A model's checks put in order: severities, statuses, and what speaks against them."""
    st = F.col("o_orderstatus")
    pick = lambda f, o, p: F.when(st == "F", f).when(st == "O", o).otherwise(p)
    checks = load(spark, sf, "orders").select(
        "o_orderkey", F.lit("X").alias("rule_code"), pick("info", "HIGH", "odd").alias("severity"), pick("fail", "PASS", "unheard").alias("status"),
        pick("a gap", "an active mortgage was found", "x").alias("explanation"), pick("nothing is named", "ec.pdf tells of a shortfall", "ec.pdf").alias("evidence"),
    )
    g = guardrails.guarded(checks, F.array(F.lit("ec.pdf")), F.lit(1))
    return g.select("o_orderkey", "severity", "status", "unverified", F.size("guardrail_warnings").alias("n_warnings"))


@query(f"""WITH {BASE}
SELECT case_id, CAST(1 AS BIGINT) AS n_match, CAST(2 AS BIGINT) AS n_mismatch FROM d WHERE CASE sub WHEN 2 THEN true ELSE true END AND registered IS NOT NULL AND 1 = 0
UNION ALL SELECT case_id, CAST(1 AS BIGINT), CAST(2 AS BIGINT) FROM d
""")
def ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    """An answer about a case's taluk against the facts: one source has it, the others don't."""
    facts = materialize(fact_store.extract(documents(spark, sf), CASE_KINDS, ("taluk",)).withColumn("value", F.concat(F.col("value"), F.col("doc_ord").cast("string"))), "facts")
    answer = facts.where("doc_ord = 1").select("case_id", F.lit("DET_MULTI_TALUK").alias("rule_code"), F.lit(1).alias("pos"), F.concat(F.lit("the taluk is "), F.col("value")).alias("explanation"), F.lit("").alias("evidence"), F.array().cast("array<string>").alias("guardrail_warnings"))
    return guardrails.with_ground_truth(answer, facts, ["case_id"]).select("case_id", "n_match", "n_mismatch")


@query("""
SELECT c_custkey, g AS group_id, CASE g WHEN 1 THEN true WHEN 2 THEN c_mktsegment = 'BUILDING' ELSE false END AS runs FROM customer, (VALUES (1), (2), (3)) AS x(g)
""")
def group_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of checks that a case's documents allow."""
    groups = spark.createDataFrame([(1, ["EC"], ["EC"], 1), (2, ["EC", "PATTA"], ["EC", "PATTA"], 2), (3, ["FMB"], ["FMB"], 1)], "group_id int, needs array<string>, anchors array<string>, least int")
    have = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("EC"), F.lit("PATTA"))).otherwise(F.array(F.lit("EC")))
    cases = load(spark, sf, "customer").select("c_custkey", have.alias("available"))
    return guardrails.group_gate(cases, groups).select("c_custkey", "group_id", "runs")


@query("""
SELECT o_custkey AS case_id, count(*) AS n_checks, count(*) FILTER (o_orderstatus = 'F') AS n_pass, count(*) FILTER (o_orderstatus = 'O') AS n_fail, count(*) FILTER (o_orderstatus = 'P') AS n_warning FROM orders GROUP BY o_custkey
""")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "FAIL").otherwise("WARNING")
    checks = load(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), status.alias("status"))
    return reports.status_counts(checks, ["case_id"]).select("case_id", "n_checks", "n_pass", "n_fail", "n_warning")


@query("""
WITH c AS (SELECT o_custkey AS case_id, CAST(o_orderkey AS VARCHAR) AS rule_code, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS g FROM orders WHERE o_orderstatus = 'O')
SELECT case_id, rule_code, CAST(row_number() OVER (PARTITION BY case_id ORDER BY g, rule_code) AS INTEGER) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY g, rule_code) <= 5
""")
def gravest_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The five gravest failed checks of each case."""
    p = F.col("o_orderpriority")
    severity = F.when(p == "1-URGENT", "CRITICAL").when(p == "2-HIGH", "HIGH").when(p == "3-MEDIUM", "MEDIUM").otherwise("LOW")
    checks = load(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").cast("string").alias("rule_code"), severity.alias("severity"), F.when(F.col("o_orderstatus") == "O", "FAIL").otherwise("PASS").alias("status"))
    return reports.alerts(checks, ["case_id"]).select("case_id", "rule_code", "rank")


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'WARNING' ELSE 'FAIL' END AS status, o_orderstatus = 'O' AS amended FROM orders
""")
def amended_checks(spark: SparkSession, sf: str) -> DataFrame:
    """A review's amendments: no failure becomes a pass, nothing deterministic changes."""
    o, st = load(spark, sf, "orders"), F.col("o_orderstatus")
    checks = o.select("o_orderkey", F.lit("R").alias("rule_code"), F.lit("FAIL").alias("status"), F.when(st == "P", "deterministic").otherwise("llm").alias("source"))
    said = o.select("o_orderkey", F.lit("R").alias("rule_code"), F.lit(1).alias("pos"), F.when(st == "F", "PASS").otherwise("WARNING").alias("amended_status"), F.lit("why").alias("reason"))
    return scoring.amend(checks, said, ["o_orderkey"]).select("o_orderkey", "status", "amended")


@query("""
SELECT o_orderkey, 600 AS n_explanation, CASE o_orderstatus WHEN 'F' THEN 'deterministic' ELSE 'llm' END AS source FROM orders WHERE o_orderstatus <> 'P'
""")
def reflection_input(spark: SparkSession, sf: str) -> DataFrame:
    """Checks as a reviewer reads them."""
    st = F.col("o_orderstatus")
    checks = load(spark, sf, "orders").select("o_orderkey", F.when(st == "P", "GROUP1_SKIPPED").otherwise("R").alias("rule_code"), F.repeat(F.lit("x"), 900).alias("explanation"), F.lit("e").alias("evidence"), F.when(st == "F", "deterministic").otherwise("other").alias("source"))
    return guardrails.reflection_input(checks).select("o_orderkey", F.length("explanation").alias("n_explanation"), "source")
