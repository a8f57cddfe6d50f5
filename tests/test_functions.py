"""Scalar functions against examples worked out by hand."""

import pytest
from pyspark.sql import functions as F

from titleforge.functions import cleaning, names, scalars, surveys, tamil
from titleforge.operators import pages, retrieval


def values(spark, column, rows, n=1):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{'abc'[k]} string" for k in range(n)))
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_amounts(spark):
    got = values(spark, scalars.parse_amount(F.col("a")), ["Rs. 45,00,000", "1.5 crore", "2 lakhs", "₹௧௦,௦௦௦", "rs 500", "abc", "", "1_000", "3 cr"])
    assert got == [4500000.0, 15000000.0, 200000.0, 10000.0, None, None, None, 1000.0, 30000000.0]


def test_areas(spark):
    got = values(spark, scalars.parse_area(F.col("a")), ["2 acres 50 cents", "2,400 sq.ft", "1200", "1 hectare", "none"])
    assert got[0] == pytest.approx(2 * 43560 + 50 * 435.6)
    assert got[1:] == [400.0, 1200.0, 107639.0, None]


def test_dates(spark):
    got = values(spark, scalars.parse_date(F.col("a")), ["2012-03-15", "15-03-2012", "05/03/2012", "15.3.2012", "15 Mar 2012", "March 5, 2012", "around 1998", "31-02-2012", "x"])
    assert [str(d) if d else None for d in got] == ["2012-03-15", "2012-03-15", "2012-03-05", "2012-03-15", "2012-03-15", "2012-03-05", "1998-01-01", "2012-01-01", None]


def test_grouping_and_roundness(spark):
    df = spark.createDataFrame([(1234567.0,), (999.0,), (-45000.0,), (200000.0,), (30000.0,), (30500.0,)], "v double")
    rows = df.select(scalars.indian_grouping(F.col("v")), scalars.suspiciously_round(F.col("v"))).collect()
    assert [r[0] for r in rows] == ["12,34,567", "999", "-45,000", "2,00,000", "30,000", "30,500"]
    assert [r[1] for r in rows] == [False, False, False, True, True, False]


def test_rupees_round_by_the_exact_value(spark):
    amounts = [100500.0, 101500.0, 112500.0, 137500.0, 299500.0, 10050000.0, 11250000.0, 123456789012345.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(amounts)], "i int, v double").orderBy("i")
    want = [f"₹{v / 1e7:.2f} Cr" if v >= 1e7 else f"₹{v / 1e5:.2f} L" for v in amounts]
    assert [r[0] for r in df.select(cleaning.short_rupees(F.col("v"))).collect()] == want and want[0] == "₹1.00 L"
    forms = [r[0] for r in df.select(cleaning.rupee_forms(F.col("v").cast("decimal(38,0)").cast("string"))).collect()]
    assert all((f"{v / 1e7:.2f} crore" if v >= 1e7 else f"{v / 1e5:.2f} lakh") in f for v, f in zip(amounts, forms))


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("S.F.No. 311/1", "311-1", "exact"),
        ("311", "311/1A", "subdivision"),
        ("311/1", "311/1A", "subdivision"),
        ("543/1A1", "543/1C1", "mismatch"),
        ("311/1", "311/2", "mismatch"),
        ("311/1", "311/12", "mismatch"),
        ("3111A", "3111B", "ocr_fuzzy"),
        ("", "311", "mismatch"),
        ("318/1ஏ", "318/1a", "exact"),
    ],
)
def test_survey_match(spark, a, b, want):
    assert values(spark, surveys.survey_match(F.col("a"), F.col("b")), [(a, b)], 2) == [want]
    assert values(spark, surveys.survey_match(F.col("b"), F.col("a")), [(a, b)], 2) == [want]


def test_survey_lists(spark):
    got = values(spark, surveys.split_surveys(F.col("a")), ["311/1, 311/2; 312/3A", "4-3, 760-2 50|17|1", "T.S.No. 45", "SE hag Survey :317"])
    assert got == [["311/1", "311/2", "312/3A"], ["760-2"], ["T.S.No. 45"], ["317"]]
    assert values(spark, surveys.survey_kind(F.col("a")), ["S.F.No. 3", "T.S. No 45", "311/1"]) == ["SF", "TS", ""]


def test_names(spark):
    assert values(spark, names.normalize_name(F.col("a")), ["Mr. R. Kumar", "Smt. Lakshmi  Devi"]) == ["kumar", "lakshmi devi"]
    got = values(spark, names.name_parts(F.col("a")), ["Murugan S/o Ramamoorthy", "Lakshmi", "துளசி மனைவி பாமா"])
    assert [tuple(r) for r in got] == [("murugan", "ramamoorthy"), ("lakshmi", ""), ("பாமா", "துளசி")]
    assert values(spark, names.split_parties(F.col("a")), ["A, B, and C", "Ram S/o Krishna & Sita"]) == [["A", "B", "C"], ["Ram S/o Krishna", "Sita"]]


def test_name_similarity(spark):
    pairs = [("Murugan", "Murugan"), ("Murugan S/o Raman", "Murugan S/o Sundaram"), ("Murugan", "Murugan S/o Raman"), ("R. Kumar", "Kumar"), ("Ravi Kumar", "Ravikumar"), ("Abc", "Xyz"), ("", "x")]
    got = values(spark, names.name_similarity("a", "b"), pairs, 2)
    assert got == [names.similarity(a, b) for a, b in pairs]
    assert got[0] == 1.0 and got[2] == 0.85 and got[3] == 1.0 and got[4] == 1.0 and got[5] == 0.0 and got[6] == 0.0 and 0.6 < got[1] < 1


def test_villages(spark):
    pairs = [("Chromepet", "Chromepettai"), ("Tambaram (R)", "tambaram"), ("Madurai", "Chennai"), ("", "x")]
    assert values(spark, names.village_match(F.col("a"), F.col("b")), pairs, 2) == ["exact", "exact", "mismatch", "mismatch"]


def test_tamil(spark):
    got = values(spark, tamil.garbled(F.col("a")), ["சோமையம்பாளையம்", "ாிீுூ", "plain", None])
    assert [g["is_garbled"] for g in got] == [False, True, False, False]
    assert tamil.transliterate_text("முருகன்") == "murukan"


def test_cleaning(spark):
    assert values(spark, pages.strip_cid(F.col("a")), ["a(cid:12)b  (cid:3) c\n\n\nd"]) == ["ab c\nd"]
    assert values(spark, pages.collapse_repetitions(F.col("a")), ["(R) (R) (R) (R) (R) x", "a b"]) == ["(R) (R) (R) x", "a b"]
    got = values(spark, pages.normalize_ocr(F.col("a")), ["S. F. No: ௩/௧ on 15.03.2012\n\n\n\n\nend"])
    assert got == ["S.F.No. 3/1 on 15-03-2012\n\nend"]


def test_page_quality(spark):
    got = values(spark, pages.page_quality(F.col("a")), ["short", "word " * 20, "x" * 60, "(cid:123)" * 10 + " word" * 12])
    assert [g["quality"] for g in got] == ["LOW", "HIGH", "LOW", "LOW"]
    assert [g["reason"] is None for g in got] == [False, True, False, False]


def test_keyword_score(spark):
    words = F.array(F.lit("311/1"), F.lit("survey"), F.lit("owner"))
    assert values(spark, retrieval.keyword_score(words, F.col("a")), ["owner only", "SURVEY 311/1", ""]) == [0.25, 0.75, 0.0]


def test_deed_hints(spark):
    from titleforge.functions import preparse

    text = "R/Vadavalli/Book 1/5909/2012 S.F.No. 317/1A PAN ABCDE 1234F sold for Rs. 45,00,000/- by cheque. dry land, agricultural. free from all encumbrance. deed dated 1990"
    (got, none) = values(spark, preparse.deed_hints(F.col("a")), [text, ""])
    assert (got.registration_number, got.document_number, got.sro) == ("R/Vadavalli/Book1/5909/2012", "5909/2012", "Vadavalli")
    assert got.survey_numbers == ["317/1A"] and got.pan_numbers == ["ABCDE1234F"] and got.consideration_amount == 4500000.0
    assert (got.land_classification, got.payment_mode, got.encumbrance_free, got.property_type, got.ownership_transfers) == ("Dry", "Cheque", True, "Agricultural", 1)
    assert none.registration_number is None and none.consideration_amount is None and not none.encumbrance_free
