"""Deterministic rules: each takes the case tables and a day, and returns checks.

A check: case_id, rule_code, severity, status, evidence, filename, source. The
rules are independent DataFrames; :func:`run` unions them, so that Spark plans
and prunes all of them together. No rule looks at today's date.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jurisdiction import jurisdiction
from ..functions.names import normalize_name, village_pairs
from ..functions.scalars import parse_date, suspiciously_round
from ..functions.surveys import VALID, match_pairs, normalize_survey, survey_kind
from ..functions.tamil import garbled
from ..functions.variants import text_leaves
from ..sources.cases import CaseTables
from . import identity
from .chain import CHAIN_RELEVANT
from .identity import chain_breaks
from .sequences import relative_difference

#: Rates and thresholds.
STAMP_RATE, STAMP_SHARE, UNDERVALUED, AREA_TOLERANCE, AMOUNT_TOLERANCE = 0.07, 0.95, 0.8, 0.10, 0.05
LIMITATION_DAYS, PRE_EC_DAYS, STALE_DAYS = 12 * 365, 365, 30
#: Plausible amounts (rupees) and areas (square feet).
BOUNDS = {"consideration_amount": (1e4, 5e9), "guideline_value": (1e4, 5e9), "stamp_duty": (100.0, 3.5e8), "registration_fee": (100.0, 4e5)}
EXTENT = (1.0, 1e7)
PAN = r"^[A-Z]{5}[0-9]{4}[A-Z]$"
#: Features of the ground that burden a property.
FEATURES = (
    "water channel", "canal", "nala", "nallah", "drainage", "drain", "river", "stream", "tank", "pond", "lake", "well", "road", "pathway", "cart track", "footpath", "highway",
    "railway", "rail line", "power line", "ht line", "electric", "government land", "govt land", "poramboke", "poramboku", "burial ground", "cremation", "temple", "church", "mosque",
    "sewage", "sewer", "pipeline",
)
FEATURES_TAMIL = (
    "வாய்க்கால்", "கால்வாய்", "நீர்வழி", "ஓடை",
    "சாலை", "பாதை", "தெரு", "ரோடு",
    "ரயில்", "மின்சார", "அரசு நிலம்", "புறம்போக்கு",
    "குளம்", "ஏரி", "கிணறு", "ஆறு",
)

COLUMNS = ("case_id", "rule_code", "severity", "status", "evidence", "filename")
Rule = Callable[[CaseTables, str], DataFrame]
RULES: dict[str, Rule] = {}


def rule(f: Rule) -> Rule:
    RULES[f.__name__] = f
    return f


def check(rows: DataFrame, code: str | Column, severity: str | Column, status: str | Column, evidence: Column, filename: Column | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select("case_id", lit(code).alias("rule_code"), lit(severity).alias("severity"), lit(status).alias("status"), evidence.alias("evidence"), (F.col("filename") if filename is None else filename).cast("string").alias("filename"))


def once(c: Column) -> Column:
    """A column that later filters can't take apart: they would turn its branches into one huge condition."""
    return F.explode(F.array(c))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _day(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


@rule
def ec_period(t: CaseTables, as_of: str) -> DataFrame:
    years = F.datediff("end", "start") / 365.25
    spans = t.ec.where("start is not null and end is not null").withColumn("years", years)
    text = F.format_string("%s to %s: %.1f years", F.col("start").cast("string"), F.col("end").cast("string"), F.col("years"))
    invalid = check(spans.where("years < 0"), "DET_EC_PERIOD_INVALID", "CRITICAL", "FAIL", text)
    y = F.col("years")
    severity = F.when(y < 1, "CRITICAL").when(y < 10, "HIGH").otherwise("MEDIUM")
    short = check(spans.where("years >= 0 and years < 13"), "DET_EC_SHORT_PERIOD", severity, F.when(y < 10, "FAIL").otherwise("WARNING"), text)
    stale = check(t.ec.where(F.datediff(_day(as_of), "end") > STALE_DAYS), "DET_EC_STALE", "HIGH", "WARNING", F.concat(F.lit("ends "), F.col("end").cast("string")))
    ahead = Window.partitionBy("case_id", "filename").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    late = t.transactions.withColumn("last", F.last("day", ignorenulls=True).over(ahead)).where("day < last")
    disorder = late.groupBy("case_id", "filename").agg(F.count("*").alias("n"))
    many = t.transactions.groupBy("case_id", "filename").agg(F.count("*").alias("of")).where("of >= 2")
    order = check(disorder.join(many, ["case_id", "filename"]), "DET_EC_CHRONO_ORDER", "MEDIUM", "WARNING", F.format_string("%d of %d out of order", "n", "of"))
    return union(invalid, short, stale, order)


@rule
def registration_within_ec(t: CaseTables, as_of: str) -> DataFrame:
    spans = t.ec.where("start is not null and end is not null").select("case_id", "start", "end", F.col("filename").alias("ec"))
    out = t.deeds.where("day is not null").select("case_id", "filename", "day").join(spans, "case_id").where("day < start or day > end")
    return check(out, "DET_REG_OUTSIDE_EC", "HIGH", "FAIL", F.format_string("%s is outside %s to %s (%s)", F.col("day").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), "ec"))


@rule
def limitation(t: CaseTables, as_of: str) -> DataFrame:
    old = t.transactions.where(F.col("kind").isin(*CHAIN_RELEVANT)).where(F.datediff(_day(as_of), "day") > LIMITATION_DAYS)
    return check(old.groupBy("case_id", "filename").agg(F.count("*").alias("n"), F.min("day").alias("first")), "DET_LIMITATION_PERIOD", "MEDIUM", "INFO", F.format_string("%d older than 12 years, first %s", "n", F.col("first").cast("string")))


@rule
def stamp_duty(t: CaseTables, as_of: str) -> DataFrame:
    base = F.greatest("consideration_amount", "guideline_value")
    d = t.deeds.withColumn("due", F.lit(STAMP_RATE) * base)
    short = check(d.where(F.col("stamp_duty") < STAMP_SHARE * F.col("due")), "DET_STAMP_DUTY_SHORT", "HIGH", "FAIL", F.format_string("paid %.2f of %.2f", "stamp_duty", "due"))
    low = d.where("guideline_value > 0").where(F.col("consideration_amount") < UNDERVALUED * F.col("guideline_value"))
    return union(short, check(low, "DET_UNDERVALUATION", "HIGH", "WARNING", F.format_string("%.2f against %.2f", "consideration_amount", "guideline_value")))


@rule
def plausibility(t: CaseTables, as_of: str) -> DataFrame:
    each = F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).alias("value"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, (lo, hi) in BOUNDS.items()))
    v = t.deeds.select("case_id", "filename", F.inline(each)).where("value > 0")
    text = F.format_string("%s %.2f", "field", "value")
    low = check(v.where("value < lo"), "DET_IMPLAUSIBLE_LOW", "MEDIUM", "WARNING", text)
    high = check(v.where("value > hi"), "DET_IMPLAUSIBLE_HIGH", "MEDIUM", "WARNING", text)
    areas = union(t.deeds.select("case_id", "filename", "sqft"), t.pattas.select("case_id", "filename", "sqft")).where((F.col("sqft") < EXTENT[0]) | (F.col("sqft") > EXTENT[1]))
    return union(low, high, check(areas, "DET_IMPLAUSIBLE_EXTENT", "MEDIUM", "WARNING", F.format_string("%.1f sq ft", "sqft")))


@rule
def area_consistency(t: CaseTables, as_of: str) -> DataFrame:
    """Deed areas against the extents of the matching surveys of a patta, and each other."""
    wanted = t.surveys.where("document_type = 'SALE_DEED'").select("case_id", normalize_survey(F.col("survey")).alias("deed_survey")).distinct()
    own = t.patta_surveys.withColumn("normal", once((normalize_survey(F.col("survey_no")))))
    met = own.join(wanted, "case_id").select("case_id", "filename", "doc_ord", "pos", "sqft", (match_pairs(F.col("normal"), F.col("deed_survey"))).alias("m"))
    met = met.where("m <> 'mismatch'").drop("m").distinct()
    matched = met.groupBy("case_id", "filename", "doc_ord").agg(F.sum("sqft").alias("sqft"))
    areas = union(t.deeds.select("case_id", "filename", "doc_ord", "sqft"), matched.select("case_id", "filename", "doc_ord", "sqft")).where("sqft > 0")
    a, b = areas, areas.toDF("case_id", "other", "ord_b", "sqft_b")
    pairs = a.join(b, "case_id").where("doc_ord < ord_b").where(relative_difference(F.col("sqft"), F.col("sqft_b")) > AREA_TOLERANCE)
    mismatch = check(pairs, "DET_AREA_MISMATCH", "HIGH", "FAIL", F.format_string("%.0f against %.0f sq ft in %s", "sqft", "sqft_b", "other"))
    whole = t.pattas.select("case_id", "filename", F.col("sqft").alias("total")).join(matched.select("case_id", "filename", "sqft"), ["case_id", "filename"]).where("total > sqft * 1.1")
    return union(mismatch, check(whole, "DET_PATTA_PORTFOLIO", "LOW", "INFO", F.format_string("%.0f of %.0f sq ft are of the property", "sqft", "total")))


@rule
def party_names(t: CaseTables, as_of: str) -> DataFrame:
    """Buyers, sellers, claimants and owners who are the same person, by identity clusters."""
    roles = t._kept(identity.shared_roles(t.resolved))  # a row per case
    met = lambda a, b: F.exists("clusters", lambda c: F.array_contains(c, a) & F.array_contains(c, b))
    has = lambda r: F.exists("clusters", lambda c: F.array_contains(c, r))
    with_ec = t.ec.select("case_id").distinct().withColumn("has_ec", F.lit(True))
    g = roles.join(with_ec, "case_id", "left").withColumn("filename", F.lit("")).withColumn("has_ec", F.coalesce("has_ec", F.lit(False)))
    buyer = has("buyer") & has("patta_owner")
    pending = ~met("buyer", "patta_owner") & met("seller", "patta_owner")
    found = g.where(buyer)
    owner = check(
        found,
        F.when(met("buyer", "patta_owner") | pending, "DET_BUYER_PATTA_MATCH").otherwise("DET_BUYER_PATTA_MISMATCH"),
        F.when(pending, "MEDIUM").otherwise("HIGH"),
        F.when(met("buyer", "patta_owner"), "PASS").when(pending, "INFO").otherwise("WARNING"),
        F.when(pending, "the seller is the owner: mutation is pending").otherwise("buyer against owner"),
    )
    same = met("ec_claimant", "patta_owner")
    claimed = g.where(~has("buyer") & has("patta_owner") & F.col("has_ec"))
    claimant = check(claimed, F.when(same, "DET_BUYER_PATTA_MATCH").otherwise("DET_BUYER_PATTA_MISMATCH"), "HIGH", F.when(same, "PASS").otherwise("WARNING"), F.lit("claimant against owner"))
    gap = g.where(F.col("has_ec") & has("seller") & ~met("ec_claimant", "seller"))
    return union(owner, claimant, check(gap, "DET_CHAIN_NAME_GAP", "HIGH", "WARNING", F.lit("no claimant is a seller")))


def _survey_clusters(t: CaseTables) -> DataFrame:
    """case_id, document_type, survey, cluster: greedy, in the order of documents."""
    rows = t.surveys.groupBy("case_id", normalize_survey(F.col("survey")).alias("normal")).agg(F.min(F.struct("doc_ord", "survey")).alias("first"), F.sort_array(F.collect_set("document_type")).alias("kinds"))
    rows = rows.where("normal <> ''").select("case_id", "normal", "first.doc_ord", "first.survey", "kinds")
    a, b = rows.select("case_id", F.col("normal").alias("a")), rows.select("case_id", F.col("normal").alias("b"))
    pairs = a.join(b, "case_id").where("a < b").select("case_id", "a", "b", (match_pairs(F.col("a"), F.col("b"))).alias("m")).where("m <> 'mismatch'").select("case_id", "a", "b")
    kind = rows.schema["case_id"].dataType.simpleString()

    def group(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["doc_ord", "normal"])
        same = {(x, y) for x, y in zip(right["a"], right["b"])}
        found: list[list[str]] = []
        label = []
        for n in left["normal"]:
            at = next((i for i, c in enumerate(found) if any((min(n, m), max(n, m)) in same for m in c)), len(found))
            if at == len(found):
                found.append([])
            found[at].append(n)
            label.append(at)
        return pd.DataFrame({"case_id": left["case_id"], "normal": left["normal"], "kinds": left["kinds"], "cluster": label})

    left = rows.select("case_id", "doc_ord", "normal", "kinds").toDF("case_id", "doc_ord", "normal", "kinds")
    return left.groupBy("case_id").cogroup(pairs.toDF("case_id", "a", "b").groupBy("case_id")).applyInPandas(group, f"case_id {kind}, normal string, kinds array<string>, cluster int")


@rule
def survey_numbers(t: CaseTables, as_of: str) -> DataFrame:
    none = F.lit("")
    head = t.ec.where(F.col("survey_number").isNotNull()).select("case_id", "filename", once((normalize_survey(F.col("survey_number")))).alias("head"))
    rows = t.transactions.where(F.trim(F.coalesce("survey_number", F.lit(""))) != "")
    both = rows.select("case_id", "filename", once((normalize_survey(F.col("survey_number")))).alias("own")).join(head, ["case_id", "filename"])
    inside = both.select("case_id", "filename", (match_pairs(F.col("head"), F.col("own"))).alias("m")).withColumn("ok", F.col("m") != "mismatch")
    odd = inside.groupBy("case_id", "filename").agg(F.count_if(~F.col("ok")).alias("n"), F.count("*").alias("of")).where("n > 0")
    internal = check(odd, "DET_EC_INTERNAL_SURVEY_INCONSISTENCY", "HIGH", "WARNING", F.format_string("%d of %d rows", "n", "of"))
    kinds = t.surveys.withColumn("k", survey_kind(F.col("survey"))).where("k <> ''").groupBy("case_id").agg(F.sort_array(F.collect_set("k")).alias("k"), F.lit("").alias("filename")).where(F.size("k") > 1)
    types = check(kinds, "DET_SURVEY_TYPE_DIFF", "MEDIUM", "INFO", F.array_join("k", ","))
    clusters = t._kept(_survey_clusters(t))  # five checks read it
    by_case = clusters.groupBy("case_id").agg(F.countDistinct("cluster").alias("n"), F.array_join(F.sort_array(F.collect_list("normal")), ",").alias("all"))
    several = clusters.join(by_case.where("n > 1"), "case_id")
    only = several.groupBy("case_id", "cluster").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("k"), F.array_join(F.sort_array(F.collect_list("normal")), ",").alias("s"))
    patta = check(only.where(F.array_join("k", ",") == "PATTA").groupBy("case_id").agg(F.array_join(F.sort_array(F.collect_list("s")), ";").alias("s")), "DET_PATTA_ONLY_SURVEYS", "LOW", "INFO", F.col("s"), none)
    apart = only.where(F.array_join("k", ",") != "PATTA").groupBy("case_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("s")), ";").alias("s")).where("n > 1")
    mismatch = check(apart, "DET_SURVEY_MISMATCH", "CRITICAL", "FAIL", F.col("s"), none)
    # how members of a cluster are alike is only told where there are several clusters
    a = several.select("case_id", "cluster", F.col("normal").alias("a"))
    b = several.select("case_id", "cluster", F.col("normal").alias("b"))
    alike = a.join(b, ["case_id", "cluster"]).where("a < b").select("case_id", "a", "b", (match_pairs(F.col("a"), F.col("b"))).alias("m"))
    how = alike.groupBy("case_id", "m").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws("~", "a", "b"))), ",").alias("s"))
    sub = check(how.where("m = 'subdivision'"), "DET_SURVEY_SUBDIVISION", "MEDIUM", "INFO", F.col("s"), none)
    fuzzy = check(how.where("m = 'ocr_fuzzy'"), "DET_SURVEY_OCR_FUZZY", "HIGH", "WARNING", F.col("s"), none)
    return union(internal, types, patta, mismatch, sub, fuzzy)


@rule
def rapid_flipping(t: CaseTables, as_of: str) -> DataFrame:
    w = Window.partitionBy("case_id", "filename").orderBy("day", "pos")
    g = t.transactions.where("kind like '%sale%' and day is not null").withColumn("gap", F.datediff("day", F.lag("day").over(w))).where("gap < 365")
    status = F.when(F.col("gap") < 180, "FAIL").otherwise("WARNING")
    each = g.withColumn("status", status).groupBy("case_id", "filename", "status").agg(F.array_join(F.slice(F.sort_array(F.collect_list("gap")), 1, 5), ",").alias("gaps"))
    return check(each, "DET_RAPID_FLIPPING", "HIGH", F.col("status"), F.concat(F.lit("days: "), F.col("gaps")))


@rule
def multiple_sales(t: CaseTables, as_of: str) -> DataFrame:
    """By seller within a file, whatever the survey number."""
    who = normalize_name(F.col("seller_or_executant"))
    g = t.transactions.where("kind like '%sale%'").withColumn("who", who).where("who <> ''").groupBy("case_id", "filename", "who").agg(F.countDistinct(normalize_name(F.col("buyer_or_claimant"))).alias("buyers"), F.count("*").alias("n"))
    bad = F.col("buyers") >= 2
    return check(g.where("buyers >= 2 or n >= 3"), "DET_MULTIPLE_SALES", F.when(bad, "CRITICAL").otherwise("HIGH"), F.when(bad, "FAIL").otherwise("WARNING"), F.format_string("%s: %d sales to %d buyers", "who", "n", "buyers"))


@rule
def plot_identity(t: CaseTables, as_of: str) -> DataFrame:
    plots = union(t.transactions.select("case_id", "filename", F.col("plot_number").alias("p")), t.deeds.select("case_id", "filename", F.col("property.plot_number").alias("p")))
    ids = F.regexp_extract_all(F.lower("p"), F.lit(r"([0-9]+[a-z]?)"), F.lit(1))
    sets = plots.select("case_id", "filename", F.explode(ids).alias("id")).groupBy("case_id", "filename").agg(F.collect_set("id").alias("ids"))
    b = sets.select("case_id", F.col("filename").alias("other"), F.col("ids").alias("other_ids"))
    apart = sets.join(b, "case_id").where("filename < other").where(~F.arrays_overlap("ids", "other_ids"))
    return check(apart, "DET_PLOT_IDENTITY_MISMATCH", "CRITICAL", "FAIL", F.concat_ws(" / ", F.array_join(F.sort_array("ids"), ","), F.array_join(F.sort_array("other_ids"), ",")))


@rule
def financial_scale(t: CaseTables, as_of: str) -> DataFrame:
    w = Window.partitionBy("case_id", "filename").orderBy("pos")
    v = t.transactions.where("amount > 0").withColumn("before", F.lag("amount").over(w))
    ratio = F.greatest(F.col("amount") / F.col("before"), F.col("before") / F.col("amount"))
    jumps = v.withColumn("ratio", ratio).where("ratio >= 10").groupBy("case_id", "filename").agg(F.max("ratio").alias("ratio"), F.count("*").alias("n"))
    jump = check(jumps, "DET_FINANCIAL_SCALE_JUMP", "HIGH", "WARNING", F.format_string("%d jumps, up to %.1f times", "n", "ratio"))
    sale = t.transactions.where("kind like '%sale%'").groupBy("case_id", "filename").agg(F.max_by(F.struct("amount"), "pos")["amount"].alias("sale")).where("sale > 0")
    mortgage = t.transactions.where("kind like '%mortgage%' and amount > 0")
    over = mortgage.join(sale, ["case_id", "filename"]).where("amount > 2 * sale").groupBy("case_id", "filename", "sale").agg(F.max("amount").alias("amount"))
    exceeds = check(over, "DET_MORTGAGE_EXCEEDS_SALE", "HIGH", "WARNING", F.format_string("%.0f against %.0f", "amount", "sale"))
    release = t.transactions.where("kind in ('release', 'reconveyance', 'cancellation')")
    refs = F.array_append(F.regexp_extract_all(F.coalesce("remarks", F.lit("")), F.lit(r"([0-9]+/[0-9]{4})"), F.lit(1)), F.col("document_number"))
    released = release.select("case_id", "filename", F.explode(refs).alias("document_number"))
    active = mortgage.join(released, ["case_id", "filename", "document_number"], "left_anti").groupBy("case_id", "filename").agg(F.sum("amount").alias("amount")).join(sale, ["case_id", "filename"]).where("amount > 1.5 * sale")
    return union(jump, exceeds, check(active, "DET_ACTIVE_MORTGAGE_BURDEN", "HIGH", "WARNING", F.format_string("%.0f unreleased against %.0f", "amount", "sale")))


@rule
def sro_jurisdiction(t: CaseTables, as_of: str) -> DataFrame:
    """The first stated office against the first stated district; unsure ones are silent."""
    first = lambda rows, c: rows.where(F.trim(F.coalesce(c, F.lit(""))) != "").groupBy("case_id").agg(F.min_by(F.struct(c.alias("v"), F.col("filename")), "doc_ord").alias("x"))
    office = first(t.deeds, F.col("sro")).select("case_id", F.col("x.v").alias("sro"), "x.filename")
    district = first(t.places, F.col("district")).select("case_id", F.col("x.v").alias("district"))
    village = first(t.places, F.col("village")).select("case_id", F.col("x.v").alias("village"))
    met = office.join(district, "case_id").join(village, "case_id", "left").withColumn("j", jurisdiction(F.col("sro"), F.col("district"), F.col("village"))).where("j.confidence <> 'low'")
    return check(met, "DET_SRO_JURISDICTION", "CRITICAL", F.when(F.col("j.valid"), "PASS").otherwise("FAIL"), F.concat_ws(" / ", "sro", "district", "j.mapped"))


@rule
def multi_village(t: CaseTables, as_of: str) -> DataFrame:
    """Places that don't match the first stated one, by district, taluk and village, across scripts."""
    out = []
    stated = t.places.where("document_type <> 'FMB'")
    for field, code, severity, status in (("district", "DET_MULTI_DISTRICT", "CRITICAL", "FAIL"), ("taluk", "DET_MULTI_TALUK", "CRITICAL", "FAIL"), ("village", "DET_MULTI_VILLAGE", "HIGH", "WARNING")):
        named = stated.where(F.trim(F.coalesce(field, F.lit(""))) != "").select("case_id", "doc_ord", "filename", F.trim(field).alias("name"))
        first = named.groupBy("case_id").agg(F.min_by("name", "doc_ord").alias("first"))
        apart = named.join(first, "case_id").where("name <> first").where(village_pairs("name", "first") == "mismatch")
        odd = apart.groupBy("case_id", "first").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("others"), F.min("filename").alias("filename"))
        out.append(check(odd, code, severity, status, F.concat_ws(" / ", "first", "others")))
    return union(*out)


@rule
def age_fraud(t: CaseTables, as_of: str) -> DataFrame:
    """An age of 0 as a number is a gap; as text it is a minor."""
    p = t.parties.withColumn("n", F.trim("age").try_cast("int")).where("n is not null")
    impossible = check(p.where("n < 0 or n > 120"), "DET_AGE_IMPOSSIBLE", "CRITICAL", "FAIL", F.concat_ws(" ", "name", "age"))
    return union(impossible, check(p.where("n >= 0 and n < 18"), "DET_MINOR_PARTY", "CRITICAL", "FAIL", F.concat_ws(" ", "role", "name", "age")))


@rule
def field_formats(t: CaseTables, as_of: str) -> DataFrame:
    survey = t.surveys.where(~normalize_survey(F.col("survey")).rlike(VALID)).groupBy("case_id", "filename").agg(F.array_join(F.sort_array(F.collect_set("survey")), ",").alias("s"))
    names = union(t.parties.select("case_id", "filename", "name"), t.patta_owners.select("case_id", "filename", "name")).where((F.length(F.trim("name")) < 3) | (F.length("name") > 60) | F.col("name").rlike("[0-9]"))
    dates = union(t.deeds.select("case_id", "filename", F.col("registration_date").alias("s")), t.ec.select("case_id", "filename", F.col("period_from").alias("s")), t.transactions.select("case_id", "filename", F.col("date").alias("s")))
    dates = dates.where(F.trim("s") != "").where(parse_date(F.col("s")).isNull())
    return union(
        check(survey, "DET_INVALID_SURVEY_FORMAT", "MEDIUM", "WARNING", F.col("s")),
        check(names, "DET_IMPLAUSIBLE_NAME", "MEDIUM", "WARNING", F.col("name")),
        check(dates, "DET_UNPARSEABLE_DATE", "MEDIUM", "WARNING", F.col("s")),
    )


@rule
def garbled_tamil(t: CaseTables, as_of: str) -> DataFrame:
    """Text values of any record, of four characters or more, whose Tamil is damaged."""
    tamil = t.documents.where(F.col("data").rlike(r"[஀-௿]|\\u0[bB][89a-fA-F]"))
    each = tamil.select("case_id", "filename", F.explode(text_leaves("data")).alias("v")).where(F.length("v") >= 4).where(garbled(F.col("v"))["is_garbled"])
    return check(each.groupBy("case_id", "filename").agg(F.count("*").alias("n"), F.min("v").alias("v")), "DET_GARBLED_TAMIL", "HIGH", "WARNING", F.format_string("%d values, like %s", "n", "v"))


@rule
def fabrication(t: CaseTables, as_of: str) -> DataFrame:
    amounts = F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).alias("v")) for k in BOUNDS))
    v = t.deeds.select("case_id", "filename", F.inline(amounts)).where("v > 0")
    whole = v.groupBy("case_id", "filename").agg(F.count("*").alias("n"), F.bool_and(suspiciously_round(F.col("v"))).alias("r")).where("n >= 3 and r")
    same = v.groupBy("case_id", "filename", "v").agg(F.count("*").alias("n")).where("n >= 3")
    ec = t.transactions.where("amount > 0").groupBy("case_id", "filename").agg(F.count("*").alias("n"), F.countDistinct("amount").alias("d")).where("n >= 5 and d = 1")
    total = t.transactions.groupBy("case_id", "filename").agg(F.count("*").alias("of"))
    named = [t.transactions.select("case_id", "filename", F.lit(i).alias("side"), normalize_name(F.col(c)).alias("who")) for i, c in enumerate(("seller_or_executant", "buyer_or_claimant"))]
    counts = union(*named).where("who <> ''").groupBy("case_id", "filename", "who").agg(F.count_if(F.col("side") == 1).alias("b"), F.count_if(F.col("side") == 0).alias("s"))
    # a name's purchases count before its sales
    often = counts.withColumn("n", F.when(F.col("b") > 0, F.col("b")).otherwise(F.col("s"))).join(total, ["case_id", "filename"]).where("of >= 5 and n >= 5 and n >= 0.8 * of")
    sure = t.ec.select("case_id", "filename", "extraction_notes").join(total, ["case_id", "filename"]).where("of >= 15").where(F.trim(F.coalesce("extraction_notes", F.lit(""))) == "")
    return union(
        check(whole, "DET_ALL_AMOUNTS_ROUND", "MEDIUM", "WARNING", F.format_string("%d amounts", "n")),
        check(ec, "DET_EC_IDENTICAL_AMOUNTS", "MEDIUM", "WARNING", F.format_string("%d amounts", "n")),
        check(same, "DET_DUPLICATE_VALUES", "LOW", "WARNING", F.format_string("%.2f in %d fields", "v", "n")),
        check(often, "DET_REPEATED_PARTY", "LOW", "WARNING", F.format_string("%s in %d of %d", "who", "n", "of")),
        check(sure, "DET_ZERO_UNCERTAINTY", "LOW", "INFO", F.format_string("%d rows without a note", "of")),
    )


def boundary_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def features(c: Column) -> Column:
    """The features that a boundary names; Tamil ones as they are written."""
    own = F.filter(F.array(*map(F.lit, FEATURES)), lambda f: F.contains(boundary_text(c), f))
    return F.coalesce(F.concat(own, F.filter(F.array(*map(F.lit, FEATURES_TAMIL)), lambda f: F.contains(c, f))), F.array().cast("array<string>"))


@rule
def boundaries(t: CaseTables, as_of: str) -> DataFrame:
    """Each deed against each sketch of its case: features that only the sketch names."""
    sides = ("north", "south", "east", "west")

    def by_document(rows: DataFrame, out: str, side: Column) -> DataFrame:
        each = rows.where(F.col("direction").isin(*sides)).where(F.trim(side) != "")
        return each.groupBy("case_id", F.col("filename").alias(f"{out}_file")).agg(F.collect_list(F.struct("direction", side.alias("text"), features(side).alias("f"))).alias(out))

    sketch = t.fmb.select("case_id", "filename", F.explode("boundaries").alias("direction", "drawn")).withColumn("direction", F.lower("direction"))
    met = by_document(t.boundaries, "told", F.col("boundary")).join(by_document(sketch, "drawn", F.col("drawn")), "case_id").withColumn("filename", F.col("told_file"))
    silent = lambda d: (F.size(d["f"]) > 0) & F.exists("told", lambda s: (s["direction"] == d["direction"]) & (F.size(s["f"]) == 0))
    apart = met.withColumn("odd", F.array_sort(F.transform(F.filter("drawn", silent), lambda d: F.concat_ws(": ", d["direction"], d["text"])))).where(F.size("odd") > 0)
    mismatch = check(apart, "DET_BOUNDARY_MISMATCH", "HIGH", "WARNING", F.array_join("odd", "; "))
    named = lambda c: F.flatten(F.transform(c, lambda d: d["f"]))
    hidden = met.withColumn("h", F.array_sort(F.array_except(named("drawn"), named("told")))).where(F.size("h") > 0)
    return union(mismatch, check(hidden, "DET_UNDISCLOSED_ENCUMBRANCE", "MEDIUM", "WARNING", F.array_join("h", ",")))


@rule
def consideration(t: CaseTables, as_of: str) -> DataFrame:
    """A deed's price against the first EC row of its document number."""
    d = t.deeds.where("consideration_amount > 0 and document_number is not null").select("case_id", "filename", F.col("document_number").alias("n"), "consideration_amount")
    e = t.transactions.where("amount > 0 and document_number is not null").select("case_id", "doc_ord", "pos", F.col("document_number").alias("m"), "amount")
    w = Window.partitionBy("case_id", "filename").orderBy("doc_ord", "pos")
    first = d.join(e, "case_id").where(F.contains(F.col("n"), F.col("m")) | F.contains(F.col("m"), F.col("n"))).withColumn("k", F.row_number().over(w)).where("k = 1")
    off = first.where(relative_difference(F.col("consideration_amount"), F.col("amount")) > AMOUNT_TOLERANCE)
    return check(off, "DET_CONSIDERATION_MISMATCH", "HIGH", "FAIL", F.format_string("%.0f against %.0f", "consideration_amount", "amount"))


@rule
def pan_numbers(t: CaseTables, as_of: str) -> DataFrame:
    p = t.parties.withColumn("pan", F.upper(F.regexp_replace(F.coalesce("pan", F.lit("")), r"\s", "")))
    given = p.where("pan <> ''")
    invalid = check(given.where(~F.col("pan").rlike(PAN)), "DET_PAN_FORMAT_INVALID", "MEDIUM", "WARNING", F.concat_ws(" ", "name", "pan"))
    g = given.where(F.col("pan").rlike(PAN)).groupBy("case_id", "pan").agg(F.countDistinct(normalize_name(F.col("name"))).alias("n"), F.countDistinct("role").alias("roles"), F.min("filename").alias("filename"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("who")).where("n > 1")
    cross = check(g.where("roles > 1"), "DET_PAN_DUPLICATE_CROSS", "HIGH", "FAIL", F.concat_ws(": ", "pan", "who"))
    same = check(g.where("roles = 1"), "DET_PAN_DUPLICATE", "MEDIUM", "WARNING", F.concat_ws(": ", "pan", "who"))
    some = given.select("case_id").distinct()
    absent = p.where("pan = ''").join(some, "case_id", "left_semi").groupBy("case_id", "filename").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("who"))
    return union(invalid, cross, same, check(absent, "DET_PAN_MISSING", "LOW", "INFO", F.col("who")))


@rule
def pre_ec_gap(t: CaseTables, as_of: str) -> DataFrame:
    start = t.ec.groupBy("case_id").agg(F.min("start").alias("start")).where("start is not null")
    history = t.deeds.select("case_id", "filename", F.explode("ownership_history").alias("h")).select("case_id", "filename", parse_date(F.col("h.document_date")).alias("day"))
    before = t.deeds.select("case_id", "filename", parse_date(F.col("previous_ownership.document_date")).alias("day"))
    gap = union(history, before).join(start, "case_id").withColumn("gap", F.datediff("start", "day")).where(F.col("gap") > PRE_EC_DAYS)
    return check(gap.groupBy("case_id", "filename").agg(F.max("gap").alias("gap")), "DET_PRE_EC_GAP", "MEDIUM", "WARNING", F.format_string("%d days before the certificate", "gap"))


@rule
def continuity(t: CaseTables, as_of: str) -> DataFrame:
    """Each row's claimants against the next row's executants, across all certificates of a case."""
    moves = t.transactions.select("case_id", "doc_ord", "pos", "filename", F.coalesce("seller_or_executant", F.lit("")).alias("seller"), F.coalesce("buyer_or_claimant", F.lit("")).alias("buyer"))
    known = t.resolved.select("case_id", "name", "cluster_id").distinct()
    broken = chain_breaks(moves, "case_id", ["doc_ord", "pos"], "seller", "buyer", cluster_of=known)
    breaks = check(broken, "DET_CHAIN_BREAK", "HIGH", "WARNING", F.format_string("%s, then %s", "buyer", "next_seller"))
    whole = moves.groupBy("case_id").agg(F.count("*").alias("n"), F.min("filename").alias("filename")).where("n >= 2").join(broken.select("case_id").distinct(), "case_id", "left_anti")
    return union(breaks, check(whole, "DET_CHAIN_CONTINUITY", "INFO", "PASS", F.format_string("%d transfers", "n")))


def run(t: CaseTables, as_of: str, only: list[str] | None = None) -> DataFrame:
    """All checks of all cases."""
    parts = [f(t, as_of) for name, f in RULES.items() if only is None or name in only]
    return union(*parts).withColumn("source", F.lit("deterministic"))


