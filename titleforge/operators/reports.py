"""What a case comes to: property summary, completeness, tools, texts for retrieval, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import sanitize_explanation
from ..functions.jurisdiction import jurisdiction
from ..functions.scalars import indian_grouping, number, parse_amount, parse_date
from ..functions.variants import each, filled, first_of, get, is_object, text_of
from .chain import risk_tier

#: Taluks with urban guideline values; least, most and typical value per square foot and per cent.
URBAN = ("ambattur", "tambaram", "sriperumbudur", "alandur", "sholinganallur", "madhavaram", "perungudi", "guindy", "chennai", "avadi", "pallavaram", "chromepet")
GUIDELINE = {"urban": ((3000, 25000, 8000), (500000, 5000000, 1500000)), "rural": ((200, 5000, 1200), (50000, 1000000, 300000))}
#: Where a compact certificate or deed has to stay under, and what a compact deed keeps.
COMPACT_AT_MOST = 100_000
DEED_CAPS = {"ownership_history": 15, "special_conditions": 10, "witnesses": 10}
NOTHING = "Not available"
SIDES = ("north", "south", "east", "west")
PAGE_AT_MOST = 900


def _read(documents: DataFrame) -> DataFrame:
    return documents.select("case_id", "doc_ord", "filename", "document_type", F.explode(F.array(F.try_parse_json("data"))).alias("_v")).where("_v IS NOT NULL")


# lookups that prompts are given


def guideline(taluk: Column) -> Column:
    """Urban or rural, with the range and the typical guideline value per square foot and per cent."""
    urban = F.lower(F.trim(taluk)).isin(*URBAN)
    pick = lambda unit, k: F.when(urban, F.lit(GUIDELINE["urban"][unit][k])).otherwise(F.lit(GUIDELINE["rural"][unit][k]))
    span = lambda unit: F.struct(*(pick(unit, k).alias(n) for k, n in enumerate(("least", "most", "typical"))))
    return F.struct(F.when(urban, "urban").otherwise("rural").alias("classification"), span(0).alias("per_sqft"), span(1).alias("per_cent"))


def age_checks(date: Column, as_of: Column) -> Column:
    """Age in days and years of a plainly written date, what holds at that age, and notes; null if it is none."""
    t = F.trim(date)
    day = F.coalesce(*(F.try_to_date(t, p) for p in ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "yyyy/M/d", "d.M.yyyy")))
    days = F.datediff(as_of, day)
    years = days / 365.25
    notes = F.concat_ws(" ", F.when(days <= 30, "within 30 days"), F.when(years > 12, "older than 12 years"), F.when(years > 15, "older than 15 years"), F.when(years <= 1, "under a year old"))
    return F.when(
        day.isNotNull(),
        F.struct(
            days.alias("age_days"), F.round(years, 1).alias("age_years"), (days <= 30).alias("valid_30_days"), (years <= 12).alias("within_12_years"), (years <= 3).alias("within_3_years"),
            (years <= 1).alias("recent"), (years > 15).alias("old"), F.when(notes == "", F.format_string("%.1f years old", years)).otherwise(notes).alias("notes"),
        ),
    )


def first_facts(facts: DataFrame, keys: dict[str, tuple[str, str]]) -> DataFrame:
    """case_id and, per name, the first value of a (category, key)."""
    order = F.struct("doc_ord", "pos")
    pick = lambda c, k: F.min_by(F.when((F.col("category") == c) & (F.col("key") == k), F.trim("value")), F.when((F.col("category") == c) & (F.col("key") == k), order))
    return facts.groupBy("case_id").agg(*(pick(c, k).alias(n) for n, (c, k) in keys.items()))


def tools_block(facts: DataFrame, as_of: str) -> DataFrame:
    """Guideline value, jurisdiction and ages of a case's documents, from its first facts."""
    dates = ("registration_date", "ec_period_from", "ec_period_to")
    keys = {k: ("property", k) for k in ("district", "taluk", "village", "survey_number")} | {"sro": ("reference", "sro")} | {k: ("timeline", k) for k in dates}
    one = first_facts(facts, keys)
    place = F.col("district").isNotNull() & F.col("taluk").isNotNull() & F.col("village").isNotNull()
    office = F.col("sro").isNotNull() & F.col("district").isNotNull() & F.col("village").isNotNull()
    ages = {f"{k}_age": age_checks(F.col(k), F.lit(as_of).cast("date")) for k in dates}
    return one.withColumns({"guideline": F.when(place, guideline(F.col("taluk"))), "jurisdiction": F.when(office, jurisdiction(F.col("sro"), F.col("district"), F.col("village"))), **ages})


# completeness


def completeness(documents: DataFrame) -> DataFrame:
    """case_id, filename and what the extraction of certificates and deeds left out."""
    rows = _read(documents)
    v = F.col("_v")
    declared, actual = number(get(v, "total_entries_found")), F.size(each(v, "transactions")).cast("double")
    ec = rows.where("document_type = 'EC'").select("case_id", "filename", F.array(F.when((declared > 0) & (actual > 0) & (actual < declared * 0.9), F.format_string("%.0f of %.0f entries", actual, declared))).alias("issues"))

    def parties(role: str) -> Column:
        people = each(v, role)
        gap = lambda k: F.transform(people, lambda p, i: F.when(is_object(p) & filled(get(p, k)).isNull(), F.format_string(f"{role}[%d] without {k}", i)))
        return F.when(F.size(people) == 0, F.array(F.lit(f"no {role}"))).otherwise(F.concat(gap("name"), gap("father_name")))

    paid, guide, duty = (F.coalesce(number(get(v, f"financials.{k}")), F.lit(0.0)) for k in ("consideration_amount", "guideline_value", "stamp_duty"))
    lacking = lambda k: F.when(filled(get(v, f"property.{k}")).isNull(), F.lit(f"no {k}"))
    sides = F.filter(F.array(*(F.when(filled(get(v, f"property.boundaries.{s}")).isNull(), F.lit(s)) for s in SIDES)), lambda s: s.isNotNull())
    stated = F.coalesce(is_object(get(v, "property.boundaries", "variant")), F.lit(False)) | get(v, "property.boundaries").isNull()
    other = F.array(
        F.when(paid == 0, "no consideration"), F.when((guide > 0) & (paid > 0) & (paid < guide * 0.7), "consideration under 70% of the guideline"), F.when(duty == 0, "no stamp duty"),
        lacking("survey_number"), lacking("village"), lacking("extent"), F.when(stated & (F.size(sides) > 0), F.concat(F.lit("no boundary: "), F.array_join(sides, ", "))),
        F.when(F.size(each(v, "ownership_history")) == 0, "no ownership history"), F.when(F.size(each(v, "witnesses")) == 0, "no witnesses"),
    )
    deed = rows.where("document_type = 'SALE_DEED'").select("case_id", "filename", F.concat(parties("seller"), parties("buyer"), other).alias("issues"))
    return ec.unionByName(deed).withColumn("issues", F.filter("issues", lambda x: x.isNotNull()))


# property summary


def property_summary(documents: DataFrame) -> DataFrame:
    """A row per case: the first stated place, office, kind of land, price; surveys, extent and owners.

    Surveys of land registers count only where they match one of a certificate, deed or
    sketch; without any of those, all count.
    """
    v, kind = F.col("_v"), F.col("document_type")
    land = kind.isin("PATTA", "CHITTA", "A_REGISTER")
    sketch = kind.isin("FMB", "ADANGAL")
    deed, ec = kind == "SALE_DEED", kind == "EC"
    other = ~(land | sketch | deed | ec)
    at = lambda k: F.when(deed, filled(get(v, f"property.{k}"))).when(other, filled(get(v, f"property_details.{k}"))).otherwise(filled(get(v, k)))
    row = lambda t, k: F.coalesce(filled(get(t, k)), F.lit(""))
    surveys = (
        F.when(ec, F.transform(each(v, "transactions"), lambda t: row(t, "survey_number"))).when(sketch, F.array(F.coalesce(filled(get(v, "survey_number")), F.lit("")))).when(deed, F.array(F.coalesce(filled(get(v, "property.survey_number")), F.lit("")))).otherwise(F.array().cast("array<string>"))
    )
    registered = F.when(land, F.transform(F.filter(each(v, "survey_numbers"), lambda s: row(s, "survey_no") != ""), lambda s: F.struct(row(s, "survey_no").alias("no"), filled(get(s, "extent")).alias("extent"))))
    owners = F.when(land & (F.size(each(v, "owner_names")) > 0), F.transform(each(v, "owner_names"), text_of)).when(land | sketch, F.array(filled(get(v, "owner_name")))).otherwise(F.array().cast("array<string>"))
    period = F.when(ec & (filled(get(v, "period_from")).isNotNull() | filled(get(v, "period_to")).isNotNull()), F.concat(F.coalesce(get(v, "period_from"), F.lit("")), F.lit(" to "), F.coalesce(get(v, "period_to"), F.lit(""))))
    office = F.when(ec, filled(get(F.get(each(v, "transactions"), F.lit(0)), "sro"))).when(deed, filled(get(v, "sro")))
    price = F.when(deed, parse_amount(filled(get(v, "financials.consideration_amount"))))
    one = _read(documents).select(
        "case_id", "doc_ord", at("village").alias("village"), at("taluk").alias("taluk"), F.when(~ec, at("district")).alias("district"),
        F.when(land | sketch, filled(get(v, "land_classification"))).alias("land_classification"), F.when(land, first_of(v, "patta_number|chitta_number")).alias("patta_number"),
        period.alias("ec_period"), office.alias("sro"), F.when(deed, filled(get(v, "property.property_type"))).alias("property_type"), F.when(price.isNotNull(), F.concat(F.lit("₹"), indian_grouping(F.floor(price).cast("double")))).alias("consideration_amount"),
        F.when(sketch, first_of(v, "extent|area_acres")).when(deed, filled(get(v, "property.extent"))).alias("extent"), F.when(land, filled(get(v, "total_extent"))).alias("total"),
        surveys.alias("surveys"), registered.alias("registered"), F.filter(F.transform(owners, F.trim), lambda o: o != "").alias("owners"),
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("doc_ord"))).alias(c)
    in_order = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("doc_ord", F.coalesce(c, F.array().cast(one.schema[c].dataType)).alias("x")))), lambda s: s["x"])).alias(c)
    singles = ("village", "taluk", "district", "land_classification", "patta_number", "sro", "property_type", "consideration_amount", "extent", "total")
    g = one.groupBy("case_id").agg(*map(first, singles), F.max_by("ec_period", F.when(F.col("ec_period").isNotNull(), F.col("doc_ord"))).alias("ec_period"), *map(in_order, ("surveys", "registered", "owners")))
    anchors = F.array_distinct(F.filter("surveys", lambda s: s != ""))
    parts = lambda s: F.split(F.trim(F.regexp_replace(s, ",", " ")), r"\s+")
    met = F.filter("registered", lambda r: (F.size("anchors") == 0) | F.exists("anchors", lambda a: F.array_contains(parts(r["no"]), a) | F.contains(a, r["no"])))
    shown = lambda c: F.coalesce(F.col(c), F.lit(NOTHING)).alias(c)
    g = g.withColumn("anchors", anchors).withColumn("met", met)
    own = F.get(F.filter(F.transform("met", lambda r: r["extent"]), lambda e: e.isNotNull()), F.lit(0))
    extent = F.when((F.size("anchors") > 0) & own.isNotNull() & F.col("total").isNotNull(), own).otherwise(F.coalesce("extent", "total"))
    return g.select(
        "case_id", *(shown(c) for c in (*singles[:-2], "ec_period")), F.coalesce(extent, F.lit(NOTHING)).alias("extent"),
        F.array_distinct(F.concat("anchors", F.transform("met", lambda r: r["no"]))).alias("survey_numbers"), F.array_distinct("owners").alias("owners"),
    )


def deed_details(documents: DataFrame) -> DataFrame:
    """A row per case with a deed: what its report section shows; what is empty is left out."""
    first = Window.partitionBy("case_id").orderBy("doc_ord")
    rows = _read(documents.where("document_type = 'SALE_DEED'")).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    v = F.col("_v")
    kept = lambda pairs: F.map_filter(F.create_map(*(x for k, c in pairs for x in (F.lit(k), c))), lambda k, c: c.isNotNull())
    rupees = lambda c: F.concat(F.lit("₹"), indian_grouping(F.floor(parse_amount(c)).cast("double")))
    names = lambda role: F.transform(each(v, role), text_of).alias(f"{role}s")
    return rows.select(
        "case_id", "filename", kept([(k, filled(get(v, k))) for k in ("document_number", "registration_date", "execution_date", "sro")]).alias("registration"), names("seller"), names("buyer"),
        kept([(k, rupees(filled(get(v, f"financials.{k}")))) for k in ("consideration_amount", "guideline_value", "stamp_duty", "registration_fee", "market_value")]).alias("financials"),
        kept([(s, filled(get(v, f"property.boundaries.{s}"))) for s in SIDES]).alias("boundaries"), F.size(each(v, "ownership_history")).alias("n_history"), F.size(each(v, "witnesses")).alias("n_witnesses"),
        *(filled(get(v, k)).alias(k) for k in ("payment_mode", "possession_date", "encumbrance_declaration", "property_description")),
    )


# texts for retrieval


def _lines(title: str, *lines: Column) -> Column:
    """A heading with the lines that are there; null if none is."""
    there = F.filter(F.array(*lines), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(there) > 0, F.concat(F.col("_head"), F.lit(f"\n--- {title} ---\n"), F.array_join(there, "\n")))


def _said(v: Column, path: str, label: str | None = None) -> Column:
    return F.concat(F.lit((label or path.split(".")[-1].replace("_", " ").title()) + ": "), filled(get(v, path)))


def deed_sections(documents: DataFrame) -> DataFrame:
    """Deeds as up to seven texts, one per section: case_id, filename, page_number, text."""
    v = F.col("_v")

    def people(role: str, fields: tuple[str, ...]) -> Column:
        one = lambda p, i: F.concat_ws("\n", F.concat(F.format_string(f"{role.title()} %d: ", i + 1), F.coalesce(text_of(p), F.lit("?"))), *(F.when(is_object(p), F.concat(F.lit(f"  {k.replace('_', ' ').title()}: "), filled(get(p, k)))) for k in fields))
        return F.array_join(F.transform(each(v, "witnesses" if role == "witness" else role), one), "\n")

    party = ("father_name", "age", "address", "pan", "aadhaar", "share_percentage")
    parts = ("survey_number", "village", "taluk", "district", "extent", "property_type", "land_classification", "plot_number", "door_number", "assessment_number")
    entry = lambda h, i: F.concat(F.format_string("%d. ", i + 1), F.coalesce(get(h, "acquired_from"), F.lit("?")), F.lit(" → "), F.coalesce(get(h, "owner"), F.lit("?")), F.concat(F.lit(" ("), F.coalesce(get(h, "acquisition_mode"), F.lit("?")), F.lit(")")), F.coalesce(F.concat(F.lit(" [Doc "), filled(get(h, "document_number")), F.coalesce(F.concat(F.lit(", "), filled(get(h, "document_date"))), F.lit("")), F.lit("]")), F.lit("")))
    sections = F.array(
        _lines("Sale Deed Identity", *(_said(v, k) for k in ("document_number", "registration_date", "execution_date", "sro")), *(_said(v, f"registration_details.{k}") for k in ("book_number", "volume_number", "page_number", "certified_copy_number"))),
        _lines("Parties", people("seller", party), people("buyer", party)),
        _lines("Property Schedule", *(_said(v, f"property.{k}") for k in parts), *(_said(v, f"property.boundaries.{s}", f"Boundary {s.title()}") for s in SIDES), F.concat(F.lit("Property Description: "), F.substr(filled(get(v, "property_description")), F.lit(1), F.lit(500)))),
        _lines("Financials", *(_said(v, f"financials.{k}") for k in ("consideration_amount", "guideline_value", "stamp_duty", "registration_fee")), *(_said(v, f"stamp_paper.{k}") for k in ("sheet_count", "denomination_per_sheet", "total_stamp_value", "vendor_name")), _said(v, "payment_mode")),
        _lines("Ownership History", F.array_join(F.transform(F.filter(each(v, "ownership_history"), is_object), entry), "\n")),
        _lines("Conditions & Encumbrances", _said(v, "encumbrance_declaration"), F.array_join(F.slice(F.coalesce(get(v, "special_conditions", "array<string>"), F.array().cast("array<string>")), 1, 10), "\n"), _said(v, "power_of_attorney")),
        _lines("Witnesses", people("witness", ("father_name", "age", "address"))),
    )
    rows = _read(documents.where("document_type = 'SALE_DEED'")).withColumn("_head", F.concat(F.lit("[SALE_DEED] "), F.col("filename")))
    kept = F.filter(sections, lambda s: F.length(s) >= 20)
    return rows.select("case_id", "filename", F.posexplode(kept).alias("n", "text")).select("case_id", "filename", (F.col("n") + 1).alias("page_number"), "text")


def _packed(head: Column, title: str, entries: Column) -> Column:
    """Entries under a heading, a new text wherever one would grow beyond the limit: a fold."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(s: Column, e: Column) -> Column:
        full = (s["open"] != "") & (F.length(head) + F.length(s["open"]) + F.length(e) > PAGE_AT_MOST)
        return F.struct(F.when(full, F.array_append(s["done"], s["open"])).otherwise(s["done"]).alias("done"), F.when(full | (s["open"] == ""), e).otherwise(F.concat(s["open"], F.lit("\n"), e)).alias("open"))

    folded = F.aggregate(entries, empty, add, lambda s: F.when(s["open"] != "", F.array_append(s["done"], s["open"])).otherwise(s["done"]))
    return F.transform(folded, lambda b: F.concat(head, F.lit(f"\n--- {title} ---\n"), b))


def flatten(documents: DataFrame) -> DataFrame:
    """Records as small texts, one per section and never cut inside an entry: case_id, filename, page_number, text."""
    v, head = F.col("_v"), F.col("_head")
    identity = ("document_summary", "document_number", "patta_number", "ec_number", "registration_number", "registration_date", "sro", "sub_registrar_office", "village", "taluk", "district", "total_extent", "classification", "property_description")
    person = lambda p: F.when(is_object(p), F.concat(F.coalesce(get(p, "name"), F.lit("")), F.coalesce(F.concat(F.lit(" "), F.coalesce(filled(get(p, "relationship")), F.lit("S/o")), F.lit(" "), first_of(p, "father_name|father_husband_name")), F.lit("")), F.coalesce(F.concat(F.lit(" ("), filled(get(p, "role")), F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(", "), filled(get(p, "address"))), F.lit("")))).otherwise(F.try_variant_get(p, "$", "string"))
    roles = (("Seller", "seller"), ("Seller", "seller_name"), ("Buyer", "buyer"), ("Buyer", "buyer_name"), ("Executant", "executant"), ("Claimant", "claimant"))
    named = lambda label, k: F.when(F.size(each(v, k)) > 0, F.array_join(F.transform(each(v, k), lambda p: F.concat(F.lit(f"{label}: "), F.coalesce(text_of(p), F.lit("")), F.coalesce(F.when(is_object(p), F.concat(F.lit(" S/o "), filled(get(p, "father_name")))), F.lit("")))), "\n")).otherwise(F.concat(F.lit(f"{label}: "), filled(get(v, k))))
    listed = lambda k: F.filter(F.transform(each(v, k), person), lambda x: x != "")
    survey = lambda s: F.when(is_object(s), F.concat_ws(" | ", F.concat(F.lit("Survey "), F.coalesce(first_of(s, "survey_no|survey_number|number"), F.lit(""))), F.concat(F.lit("Extent: "), first_of(s, "extent|area")), F.concat(F.lit("Classification: "), first_of(s, "classification|land_type")), F.concat(F.lit("Sub-division: "), first_of(s, "sub_division|subdivision")))).otherwise(F.concat(F.lit("Survey: "), F.try_variant_get(s, "$", "string")))
    amount = lambda a: F.when(is_object(a), F.concat(F.coalesce(first_of(a, "description|label"), F.lit("Amount")), F.lit(": "), F.coalesce(first_of(a, "value|amount"), F.lit("")))).otherwise(F.concat(F.lit("Amount: "), F.try_variant_get(a, "$", "string")))
    texts = lambda k: F.coalesce(get(v, k, "array<string>"), F.array(filled(get(v, k))))
    clauses = F.filter(F.concat(*(texts(k) for k in ("notable_clauses", "conditions", "restrictions", "special_conditions", "schedule"))), lambda c: c.isNotNull() & (c != ""))
    fields = ("transaction_id", "row_number", "document_number", "transaction_type", "date", "seller_or_executant", "buyer_or_claimant", "extent", "consideration_amount", "survey_number", "registration_date", "remarks")
    row = lambda t: F.concat_ws(" | ", *(F.concat(F.lit(k.replace("_", " ").title() + ": "), filled(get(t, k))) for k in fields))
    dates = F.concat(*(F.transform(each(v, k), lambda d: F.when(is_object(d), F.concat(F.coalesce(get(d, "date"), F.lit("")), F.lit(" — "), F.coalesce(first_of(d, "description|label"), F.lit("")))).otherwise(F.try_variant_get(d, "$", "string"))) for k in ("key_dates", "dates")))
    details = F.transform(F.map_entries(F.coalesce(get(v, "property_details", "map<string,string>"), F.create_map().cast("map<string,string>"))), lambda e: F.concat(F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" "))), F.lit(": "), filled(e["value"])))
    bounds = F.coalesce(get(v, "boundaries", "map<string,string>"), F.create_map().cast("map<string,string>"))
    there = lambda a: F.filter(a, lambda x: x.isNotNull() & (x != ""))
    pages = F.concat(
        F.array(F.concat_ws("\n", head, *(_said(v, k) for k in identity))),
        F.array(_lines("Parties", F.array_join(F.concat(listed("owner_names"), listed("key_parties")), "\n"), *(named(*r) for r in roles))),
        _packed(head, "Survey Numbers & Extents", there(F.transform(each(v, "survey_numbers"), survey))),
        F.array(_lines("Boundaries", F.array_join(there(F.transform(F.map_entries(bounds), lambda e: F.concat(F.initcap(e["key"]), F.lit(": "), filled(e["value"])))), "\n"))),
        F.array(_lines("Financial Details", *(_said(v, k) for k in ("consideration_amount", "guideline_value", "stamp_duty", "market_value", "registration_fee")), F.array_join(there(F.transform(each(v, "amounts"), amount)), "\n"))),
        _packed(head, "Legal Clauses & Conditions", clauses),
        _packed(head, "EC Transactions", there(F.transform(F.filter(each(v, "transactions"), is_object), row))),
        F.array(_lines("Dates & Property Details", F.array_join(there(F.concat(dates, details)), "\n"))),
    )
    rows = _read(documents).withColumn("_head", F.concat(F.lit("["), F.col("document_type"), F.lit("] "), F.col("filename")))
    out = rows.select("case_id", "filename", F.posexplode(F.filter(pages, lambda p: p.isNotNull() & (F.trim(p) != ""))).alias("n", "text"))
    return out.select("case_id", "filename", (F.col("n") + 1).alias("page_number"), "text")


def transaction_chunks(documents: DataFrame) -> DataFrame:
    """Certificates' rows as one text each, with what retrieval filters by."""
    v, t = F.col("_v"), F.col("t")
    head = F.concat_ws(" | ", F.concat(F.lit("[EC] "), F.col("filename")), *(_said(v, k) for k in ("ec_number", "village", "taluk", "period_from", "period_to")))
    rows = _read(documents.where("document_type = 'EC'")).select("case_id", "filename", head.alias("_head"), F.posexplode(each(v, "transactions")).alias("chunk_index", "t"))
    at = F.coalesce(get(t, "row_number"), (F.col("chunk_index") + 1).cast("string"))
    tid = F.coalesce(get(t, "transaction_id"), F.concat(F.lit("txn_"), F.col("chunk_index").cast("string")))
    labels = (("Document No", "document_number"), ("Date", "date"), ("Seller/Executant", "seller_or_executant"), ("Buyer/Claimant", "buyer_or_claimant"), ("Survey No", "survey_number"), ("Amount", "consideration_amount"), ("Remarks", "remarks"))
    kind = F.coalesce(get(t, "transaction_type"), F.lit("Unknown"))
    text = F.concat_ws("\n", F.col("_head"), F.concat(F.lit("Transaction #"), at, F.lit(": "), kind), *(_said(t, k, label) for label, k in labels))
    return rows.select("case_id", F.concat(F.col("filename"), F.lit("__txn_"), tid).alias("chunk_id"), "filename", at.cast("int").alias("page_number"), "chunk_index", tid.alias("transaction_id"), F.lower(F.trim(kind)).alias("transaction_type"), filled(get(t, "survey_number")).isNotNull().alias("has_survey"), text.alias("text"))


def index_stats(chunks: DataFrame, by: list[str]) -> DataFrame:
    """How many chunks, files and characters an index holds."""
    return chunks.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.countDistinct("filename").alias("n_files"), F.sum(F.length("text")).alias("n_chars"))


# compaction


def compact_certificates(documents: DataFrame, threshold: int, hard: int = COMPACT_AT_MOST) -> DataFrame:
    """Certificates' rows with less of them the larger they are: case_id, filename, tier, transactions.

    Tier 0: as they are; 1: without flags; 2: without remarks on schedules; 3: party names cut
    to 80 characters; 4: remarks cut to 200. No tier drops a row, number, date or amount.
    """
    shape = "array<struct<transaction_id:string,row_number:string,document_number:string,document_year:string,date:string,transaction_type:string,sro:string,seller_or_executant:string,buyer_or_claimant:string,survey_number:string,extent:string,consideration_amount:string,market_value:string,remarks:string,schedule_remarks:string,additional_details:string,suspicious_flags:array<string>>>"
    rows = _read(documents.where("document_type = 'EC'")).select("case_id", "filename", F.coalesce(get(F.col("_v"), "transactions", shape), F.array().cast(shape)).alias("t0"))
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substr(c, F.lit(1), F.lit(n)), F.lit("…"))).otherwise(c)
    null = F.lit(None).cast("string")
    steps = (
        lambda t: t.withField("suspicious_flags", F.lit(None).cast("array<string>")),
        lambda t: t.withField("schedule_remarks", null).withField("additional_details", null),
        lambda t: t.withField("seller_or_executant", cut(t["seller_or_executant"], 80)).withField("buyer_or_claimant", cut(t["buyer_or_claimant"], 80)),
        lambda t: t.withField("remarks", cut(t["remarks"], 200)),
    )
    for k, step in enumerate(steps):
        rows = rows.withColumn(f"t{k + 1}", F.transform(f"t{k}", step))
    size = lambda k: F.length(F.to_json(F.col(f"t{k}")))
    tier = F.when(size(0) < threshold, 0).when(size(1) <= hard, 1).when(size(2) <= hard, 2).when(size(3) <= hard, 3).otherwise(4)
    rows = rows.withColumn("tier", tier)
    return rows.select("case_id", "filename", "tier", F.to_json(F.element_at(F.array(*(F.col(f"t{k}") for k in range(5))), F.col("tier") + 1)).alias("transactions"))


def capped(texts: Column, most: int) -> Column:
    """The first entries of a list, and how many more there are."""
    return F.when(F.size(texts) > most, F.array_append(F.slice(texts, 1, most), F.format_string("... and %d more", F.size(texts) - most))).otherwise(texts)


def compact_deeds(documents: DataFrame) -> DataFrame:
    """Deeds' long parts capped: histories, conditions and witnesses, and the description."""
    v = F.col("_v")
    rows = _read(documents.where("document_type = 'SALE_DEED'"))
    strings = lambda k: F.coalesce(get(v, k, "array<string>"), F.array().cast("array<string>"))
    described = get(v, "property_description")
    return rows.select(
        "case_id", "filename", F.slice(strings("ownership_history"), 1, DEED_CAPS["ownership_history"]).alias("ownership_history"), capped(strings("special_conditions"), DEED_CAPS["special_conditions"]).alias("special_conditions"),
        F.slice(strings("witnesses"), 1, DEED_CAPS["witnesses"]).alias("witnesses"), F.size(strings("witnesses")).alias("witness_count"),
        F.when(F.length(described) > 800, F.concat(F.substr(described, F.lit(1), F.lit(800)), F.lit("…"))).otherwise(described).alias("property_description"),
    )


def consolidated(documents: DataFrame) -> DataFrame:
    """All records of a case as one text, in order of documents."""
    block = F.concat(F.lit("=== "), F.col("document_type"), F.lit(": "), F.col("filename"), F.lit(" ===\n"), F.coalesce("data", F.lit("{}")))
    return documents.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_ord", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))


def risk_listing(transactions: DataFrame, by: list[str]) -> DataFrame:
    """Rows of certificates by tier: counts, and the first of each (all critical, 10 important, 5 routine)."""
    label = F.concat(F.lit("#"), F.coalesce("transaction_id", F.col("row_number").cast("string"), F.lit("?")), F.lit(" ("), F.lower(F.trim(F.coalesce("transaction_type", F.lit("other")))), F.lit(", Doc "), F.coalesce("document_number", F.lit("N/A")), F.lit(")"))
    rows = transactions.withColumn("_tier", risk_tier(F.col("transaction_type"))).withColumn("_l", label)
    of = lambda t, most: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("_tier") == t, F.struct("pos", "_l")))), lambda x: x["_l"]), 1, most)
    n = lambda t: F.count_if(F.col("_tier") == t)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), n("CRITICAL").alias("n_critical"), n("IMPORTANT").alias("n_important"), n("ROUTINE").alias("n_routine"), of("CRITICAL", 1_000_000).alias("critical"), of("IMPORTANT", 10).alias("important"), of("ROUTINE", 5).alias("routine"))


# the report


def status_counts(checks: DataFrame, by: list[str]) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return checks.groupBy(*by).agg(F.count("*").alias("n_checks"), n("PASS").alias("n_pass"), n("FAIL").alias("n_fail"), n("WARNING").alias("n_warning"), n("INFO").alias("n_info"), n("NOT_APPLICABLE").alias("n_na"))


def alerts(checks: DataFrame, by: list[str], most: int = 5) -> DataFrame:
    """The ``most`` gravest failed checks of each case."""
    rank = F.coalesce(*(F.when(F.col("severity") == s, i) for i, s in enumerate(("CRITICAL", "HIGH", "MEDIUM", "LOW"))), F.lit(9))
    w = Window.partitionBy(*by).orderBy(rank, "rule_code")
    return checks.where("status = 'FAIL'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def critical_checks(checks: DataFrame) -> DataFrame:
    """Critical checks, and whether they failed."""
    return checks.where("severity = 'CRITICAL'").withColumn("failed", F.col("status") == "FAIL")


def first_certificate(documents: DataFrame) -> DataFrame:
    """The first certificate of each case."""
    return documents.where("document_type = 'EC'").groupBy("case_id").agg(F.min_by(F.struct("filename", "data"), "doc_ord").alias("d"), F.min("doc_ord").alias("doc_ord")).select("case_id", "doc_ord", "d.*")


def report(scores: DataFrame, checks: DataFrame, summary: DataFrame, links: DataFrame) -> DataFrame:
    """A text per case: score, property, checks with clean explanations, chain. A writer puts them in files."""
    shown = F.concat(F.lit("- ["), F.col("status"), F.lit("/"), F.col("severity"), F.lit("] "), F.col("rule_code"), F.lit(": "), sanitize_explanation(F.coalesce("evidence", F.lit(""))))
    told = checks.withColumn("l", shown).groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list("l")), "\n").alias("checks"))
    step = F.concat(F.col("sequence").cast("string"), F.lit(". "), F.col("seller"), F.lit(" → "), F.col("buyer"), F.lit(" ("), F.col("transaction_type"), F.lit(")"))
    chain = links.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", step.alias("l")))), lambda x: x["l"]), "\n").alias("chain"))
    place = summary.select("case_id", F.concat_ws(", ", "village", "taluk", "district").alias("place"), F.array_join("survey_numbers", ", ").alias("surveys"))
    all_ = scores.join(place, "case_id", "left").join(told, "case_id", "left").join(chain, "case_id", "left")
    return all_.select("case_id", F.concat_ws("\n", F.concat(F.lit("# Case "), F.col("case_id").cast("string")), F.concat(F.lit("Score "), F.col("score").cast("string"), F.lit(", risk "), F.col("band")), F.concat(F.lit("Place: "), F.col("place")), F.concat(F.lit("Surveys: "), F.col("surveys")), F.lit("## Checks"), "checks", F.lit("## Chain"), "chain").alias("report"))


def save_reports(reports: DataFrame, path: str) -> None:
    """One folder per case with its report as text."""
    reports.select(F.col("report").alias("value"), "case_id").write.mode("overwrite").partitionBy("case_id").text(path)


def transactions_by_day(documents: DataFrame) -> DataFrame:
    """Rows of certificates with their parsed day."""
    t = F.col("t")
    rows = _read(documents.where("document_type = 'EC'")).select("case_id", "filename", F.posexplode(each(F.col("_v"), "transactions")).alias("pos", "t"))
    return rows.select("case_id", "filename", "pos", parse_date(get(t, "date")).alias("day"), get(t, "transaction_type").alias("transaction_type"))
