"""Facts of every kind of record: (category, key, value, source), and typed conflicts.

A record is read once as a variant. Plain fields are listed in ``FIELDS``; lists and
risks are expressions over the variant, so that a document's facts are one array
that is exploded: one projection per kind, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import name_similarity, split_parties, village_pairs
from ..functions.scalars import number, parse_amount, parse_area
from ..functions.surveys import any_survey_kind, split_surveys, survey_match
from ..functions.tamil import has_tamil
from ..functions.variants import each, filled, first_of, get, is_object, text_of
from .chain import CHAIN_RELEVANT, ENCUMBRANCE, JUDICIAL

#: Plain fields by kind of document: category, key, and the paths of which the first with a value counts.
FIELDS: dict[str, tuple[tuple[str, str, str], ...]] = {
    "EC": (
        ("reference", "ec_number", "ec_number"),
        ("property", "property_description", "property_description"),
        ("timeline", "ec_period_from", "period_from"),
        ("timeline", "ec_period_to", "period_to"),
        ("property", "village", "village"),
        ("property", "taluk", "taluk"),
    ),
    "SALE_DEED": (
        ("reference", "sale_deed_number", "document_number"),
        ("reference", "sro", "sro"),
        ("timeline", "registration_date", "registration_date"),
        ("property", "survey_number", "property.survey_number"),
        ("property", "extent", "property.extent"),
        ("property", "boundaries", "property.boundaries"),
        ("property", "boundary_north", "property.boundaries.north"),
        ("property", "boundary_south", "property.boundaries.south"),
        ("property", "boundary_east", "property.boundaries.east"),
        ("property", "boundary_west", "property.boundaries.west"),
        ("property", "village", "property.village"),
        ("property", "taluk", "property.taluk"),
        ("property", "district", "property.district"),
        ("property", "property_type", "property.property_type"),
        ("property", "land_classification", "property.land_classification"),
        ("property", "plot_number", "property.plot_number"),
        ("property", "door_number", "property.door_number"),
        ("property", "measurement_reference", "property.measurement_reference"),
        ("property", "assessment_number", "property.assessment_number"),
        ("financial", "consideration_amount", "financials.consideration_amount"),
        ("financial", "guideline_value", "financials.guideline_value"),
        ("financial", "stamp_duty", "financials.stamp_duty"),
        ("financial", "registration_fee", "financials.registration_fee"),
        ("reference", "stamp_vendor", "stamp_paper.vendor_name"),
        ("financial", "total_stamp_value", "stamp_paper.total_stamp_value"),
        ("reference", "book_number", "registration_details.book_number"),
        ("reference", "volume_number", "registration_details.volume_number"),
        ("reference", "page_number", "registration_details.page_number"),
        ("reference", "certified_copy_number", "registration_details.certified_copy_number"),
        ("timeline", "certified_copy_date", "registration_details.certified_copy_date"),
        ("chain", "previous_ownership", "previous_ownership"),
        ("financial", "payment_mode", "payment_mode"),
    ),
    "PATTA": (
        ("reference", "patta_number", "patta_number"),
        ("property", "total_patta_extent", "total_extent|extent|area"),
        ("property", "village", "village"),
        ("property", "taluk", "taluk"),
        ("property", "district", "district"),
        ("property", "classification", "land_classification|classification"),
    ),
    "CHITTA": (
        ("reference", "chitta_number", "chitta_number"),
        ("property", "village", "village"),
        ("property", "taluk", "taluk"),
        ("property", "district", "district"),
        ("party", "chitta_owner", "owner_name"),
        ("reference", "patta_number", "patta_number"),
        ("financial", "tax_assessment", "tax_assessment"),
        ("property", "irrigation_source", "irrigation_source"),
    ),
    "A_REGISTER": (
        ("reference", "a_register_serial", "register_serial_number"),
        ("reference", "paguthi_number", "paguthi_number"),
        ("property", "village", "village"),
        ("property", "taluk", "taluk"),
        ("property", "district", "district"),
        ("party", "a_register_owner", "owner_name"),
        ("reference", "patta_number", "patta_number"),
    ),
    "FMB": (
        ("property", "survey_number", "survey_number"),
        ("property", "village", "village"),
        ("property", "taluk", "taluk"),
        ("property", "fmb_area_acres", "area_acres"),
        ("property", "fmb_area_hectares", "area_hectares"),
        ("property", "land_classification", "land_classification"),
        ("property", "boundary_north", "boundaries.north"),
        ("property", "boundary_south", "boundaries.south"),
        ("property", "boundary_east", "boundaries.east"),
        ("property", "boundary_west", "boundaries.west"),
        ("property", "fmb_dimensions", "dimensions"),
        ("property", "adjacent_surveys", "adjacent_surveys"),
    ),
    "ADANGAL": (
        ("property", "survey_number", "survey_number"),
        ("property", "village", "village"),
        ("property", "taluk", "taluk"),
        ("property", "district", "district"),
        ("party", "adangal_owner", "owner_name"),
        ("party", "adangal_tenant", "tenant_name"),
        ("property", "extent", "extent"),
        ("property", "wet_extent", "wet_extent"),
        ("property", "dry_extent", "dry_extent"),
        ("property", "soil_type", "soil_type"),
        ("property", "irrigation_source", "irrigation_source"),
        ("property", "cultivation_status", "cultivation_status"),
        ("financial", "assessment_amount", "assessment_amount"),
        ("property", "crop_details", "crop_details"),
    ),
    "LAYOUT_APPROVAL": (
        ("reference", "layout_approval_number", "approval_number"),
        ("reference", "layout_authority", "authority"),
        ("timeline", "layout_approval_date", "approval_date"),
        ("timeline", "layout_validity_period", "validity_period"),
        ("property", "layout_status", "status"),
        ("property", "layout_total_plots", "total_plots"),
        ("property", "survey_number", "survey_number|parent_survey_numbers"),
        ("encumbrance", "layout_conditions", "conditions"),
    ),
    "LEGAL_HEIR": (
        ("reference", "legal_heir_cert_number", "certificate_number"),
        ("reference", "legal_heir_authority", "issuing_authority"),
        ("party", "deceased_person", "deceased_name"),
        ("timeline", "date_of_death", "date_of_death"),
    ),
    "POA": (
        ("reference", "poa_document_number", "registration_number|document_number"),
        ("reference", "sro", "sro"),
        ("timeline", "poa_registration_date", "registration_date"),
        ("property", "poa_type", "is_general_or_specific|poa_type"),
        ("property", "poa_revocation_status", "revocation_status"),
        ("encumbrance", "poa_powers", "powers_granted"),
    ),
    "COURT_ORDER": (
        ("reference", "court_case_number", "case_number"),
        ("reference", "court_name", "court_name"),
        ("timeline", "court_order_date", "order_date"),
        ("party", "court_petitioner", "petitioner"),
        ("party", "court_respondent", "respondent"),
        ("encumbrance", "court_order_type", "order_type"),
        ("encumbrance", "court_order_status", "status"),
        ("property", "court_property_affected", "property_affected"),
        ("encumbrance", "court_restriction", "restriction_type"),
    ),
    "WILL": (
        ("reference", "will_registration", "registration_number"),
        ("timeline", "will_date", "execution_date|will_date"),
        ("encumbrance", "probate_status", "probate_status"),
    ),
    "PARTITION_DEED": (
        ("reference", "partition_deed_number", "registration_number|document_number"),
        ("reference", "sro", "sro"),
        ("timeline", "partition_date", "registration_date"),
        ("property", "original_property", "original_property"),
        ("property", "survey_number", "original_property.survey_number|original_survey_numbers"),
        ("property", "village", "original_property.village|village"),
    ),
    "GIFT_DEED": (
        ("reference", "gift_deed_number", "registration_number|document_number"),
        ("reference", "sro", "sro"),
        ("timeline", "gift_deed_date", "registration_date"),
        ("property", "gift_property", "property"),
        ("property", "survey_number", "property.survey_number|survey_number"),
    ),
    "RELEASE_DEED": (
        ("reference", "release_deed_number", "registration_number|document_number"),
        ("reference", "sro", "sro"),
        ("timeline", "release_deed_date", "registration_date"),
        ("encumbrance", "claim_released", "claim_released"),
        ("reference", "release_original_doc_number", "original_document.number"),
        ("reference", "release_original_sro", "original_document.sro"),
    ),
}
#: Parties that are a name or a structure with one, by kind of document: key and paths.
PARTIES: dict[str, tuple[tuple[str, str], ...]] = {
    "POA": (("poa_principal", "principal"), ("poa_agent", "agent")),
    "WILL": (("testator", "testator"), ("executor", "executor")),
    "GIFT_DEED": (("donor", "donor"), ("donee", "donee")),
    "RELEASE_DEED": (("releasing_party", "releasing_party"), ("release_beneficiary", "beneficiary|beneficiary_party")),
}
#: Confidence of a field under which it is told as a risk.
SURE = 0.7
#: Likeness of names from which a buyer is an owner.
OWNER_LIKENESS = 0.55
EXTENT_TOLERANCE = 0.10


def fact(category: str, key: str | Column, value: Column, context: Column | str = "", transaction: Column | str = "", confidence: float = 1.0) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        F.lit(category).alias("category"),
        lit(key).cast("string").alias("key"),
        value.cast("string").alias("value"),
        F.lit(confidence).alias("confidence"),
        F.coalesce(lit(context).cast("string"), F.lit("")).alias("context"),
        F.coalesce(lit(transaction).cast("string"), F.lit("")).alias("transaction_id"),
    )


def risk(when: Column, key: str, text: Column | str) -> Column:
    """A fact with a value only where the risk holds."""
    return F.array(fact("risk", key, F.when(when, text if isinstance(text, Column) else F.lit(text))))


def _or(c: Column, otherwise: str = "?") -> Column:
    return F.coalesce(c, F.lit(otherwise))


# kinds with lists and risks


def _ec(v: Column, keys: tuple[str, ...] | None = None) -> list[Column]:
    rows = each(v, "transactions")
    kind = lambda t: F.coalesce(get(t, "transaction_type"), F.lit(""))
    row = lambda t: _or(get(t, "row_number"))
    doc = lambda t: _or(get(t, "document_number"))
    where = lambda t: F.concat(F.lit("Transaction #"), row(t), F.lit(": "), kind(t))
    by_doc = lambda t: F.concat(F.lit("Doc #"), doc(t), F.lit(": "), kind(t))
    tid = lambda t: get(t, "transaction_id")

    def names(t: Column) -> Column:
        one = lambda path, key: F.transform(F.coalesce(split_parties(get(t, path)), F.array().cast("array<string>")), lambda n: fact("party", key, n, where(t), tid(t)))
        return F.concat(one("seller_or_executant", "ec_executant"), one("buyer_or_claimant", "ec_claimant"))

    # lambdas share nothing: the list and its values are bound first, lest each name reads the whole record anew
    people = F.transform(F.array(F.flatten(F.transform(rows, names))), lambda p: F.struct(p.alias("p"), F.transform(p, lambda x: x["value"]).alias("values")))
    once = F.flatten(F.transform(people, lambda b: F.filter(b["p"], lambda f, i: F.array_position(b["values"], f["value"]) == i + 1)))
    fields = {
        "ec_doc_number": lambda t: fact("reference", "ec_doc_number", filled(get(t, "document_number")), F.concat(kind(t), F.lit(" dated "), _or(get(t, "date"))), tid(t)),
        "ec_consideration": lambda t: fact("financial", "ec_consideration", filled(get(t, "consideration_amount")), by_doc(t), tid(t)),
        "ec_transaction_type": lambda t: fact("encumbrance", "ec_transaction_type", F.trim(get(t, "transaction_type")), F.concat(F.lit("#"), row(t), F.lit(" dated "), _or(get(t, "date"))), tid(t)),
        "ec_survey_number": lambda t: fact("property", "ec_survey_number", F.trim(get(t, "survey_number")), F.concat(where(t), F.lit(" - Doc "), doc(t)), tid(t)),
        "ec_transaction_date": lambda t: fact("timeline", "ec_transaction_date", F.trim(get(t, "date")), F.concat(F.lit("#"), row(t), F.lit(": "), kind(t), F.lit(" Doc "), doc(t)), tid(t)),
        "ec_market_value": lambda t: fact("financial", "ec_market_value", filled(get(t, "market_value")), by_doc(t), tid(t)),
        "ec_pr_number": lambda t: fact("reference", "ec_pr_number", filled(get(t, "pr_number")), by_doc(t), tid(t)),
        "ec_schedule_remarks": lambda t: fact("property", "ec_schedule_remarks", F.substr(F.trim(get(t, "schedule_remarks")), F.lit(1), F.lit(500)), F.concat(F.lit("Transaction #"), row(t)), tid(t)),
    }
    own = [f for k, f in fields.items() if keys is None or k in keys] or [*fields.values()]
    plain = F.flatten(F.transform(rows, lambda t: F.array(*(f(t) for f in own))))
    flags = F.flatten(
        F.transform(rows, lambda t: F.transform(F.coalesce(get(t, "suspicious_flags", "array<string>"), F.array(get(t, "suspicious_flags"))), lambda x: fact("risk", "ec_suspicious_flag", F.trim(x), F.concat(where(t), F.lit(" Doc "), doc(t)), tid(t))))
    )
    moves = F.filter(rows, lambda t: F.lower(kind(t)).isin(*CHAIN_RELEVANT))
    chain = F.transform(
        moves,
        lambda t: F.struct(
            _or(get(t, "seller_or_executant")).alias("from"), _or(get(t, "buyer_or_claimant")).alias("to"), get(t, "transaction_type").alias("type"),
            get(t, "date").alias("date"), get(t, "document_number").alias("doc_no"), _or(tid(t), "").alias("transaction_id"),
        ),
    )
    total = fact("encumbrance", "total_ec_entries", F.size(rows))
    transfers = fact("chain", "ownership_transfers", F.when(F.size(moves) > 0, F.to_json(chain)))
    risky = F.transform(
        F.filter(rows, lambda t: F.lower(F.trim(kind(t))).isin(*ENCUMBRANCE, *JUDICIAL)),
        lambda t: fact(
            "risk", "high_risk_transaction", F.concat(F.lower(F.trim(kind(t))), F.lit(" (Doc "), doc(t), F.lit(", "), _or(get(t, "date")), F.lit(")")),
            F.concat(F.lit("Row #"), row(t), F.lit(": "), _or(get(t, "seller_or_executant")), F.lit(" → "), _or(get(t, "buyer_or_claimant"))), tid(t),
        ),
    )
    return [F.array(total), once, plain, flags, F.array(transfers), risky]


def _people(v: Column, path: str) -> Column:
    """A list of parties, or a single one, as a list."""
    one = get(v, path, "variant")
    return F.coalesce(get(v, path, "array<variant>"), F.when(filled(get(v, path)).isNotNull(), F.array(one)), F.array().cast("array<variant>"))


def _party_facts(v: Column, role: str) -> list[Column]:
    """Names, numbers and shares of a deed's sellers or buyers, and the minors among them."""

    def of(p: Column) -> Column:
        name = F.coalesce(text_of(p), F.lit(""))
        about = lambda what: F.concat(F.lit(f"{what} of {role} "), name)
        return F.array(
            fact("party", role, name),
            fact("party", f"{role}_aadhaar", filled(get(p, "aadhaar")), about("Aadhaar")),
            fact("party", f"{role}_share", filled(get(p, "share_percentage")), about("Share")),
            fact("party", f"{role}_pan", filled(get(p, "pan")), about("PAN")),
        )

    age = lambda p: F.regexp_extract(F.trim(get(p, "age")), r"^(\S+)", 1).try_cast("int")
    told = lambda p: fact("risk", "minor_party", F.concat(F.lit(f"{role.title()} '"), _or(get(p, "name")), F.lit("' appears to be a minor (age "), age(p).cast("string"), F.lit(")")))
    minors = F.filter(_people(v, role), lambda p: (age(p) > 0) & (age(p) < 18))
    return [F.flatten(F.transform(_people(v, role), of)), F.transform(minors, told)]


def _deed(v: Column) -> list[Column]:
    out = [*_party_facts(v, "seller"), *_party_facts(v, "buyer")]
    father = lambda w: F.when(is_object(w) & filled(get(w, "father_name")).isNotNull(), F.concat(F.lit(" s/o "), get(w, "father_name"))).otherwise("")
    out.append(F.transform(F.filter(each(v, "witnesses"), lambda w: F.trim(text_of(w)) != ""), lambda w: fact("party", "witness", F.concat(F.trim(text_of(w)), father(w)))))
    out.append(F.transform(F.coalesce(get(v, "stamp_paper.serial_numbers", "array<string>"), F.array().cast("array<string>")), lambda s: fact("reference", "stamp_serial", F.trim(s))))
    history = each(v, "ownership_history")
    n = F.size(history)

    def link(h: Column) -> Column:
        x = lambda k: filled(get(h, k))
        document = F.concat(F.lit(" [Doc "), x("document_number"), F.coalesce(F.concat(F.lit(", "), x("document_date")), F.lit("")), F.lit("]"))
        parts = [F.concat(x("acquired_from"), F.lit(" → ")), x("owner"), F.concat(F.lit(" ("), x("acquisition_mode"), F.lit(")")), document, F.concat(F.lit(" — "), x("remarks"))]
        return F.concat(*(F.coalesce(p, F.lit("")) for p in parts))

    out.append(F.array(fact("chain", "ownership_history", F.when(n > 0, get(v, "ownership_history")))))
    out.append(
        F.flatten(
            F.transform(
                F.filter(history, is_object),
                lambda h, i: F.array(
                    fact("chain", "recital_transfer", link(h), F.concat(F.lit("Ownership history entry "), (i + 1).cast("string"), F.lit("/"), n.cast("string"))),
                    fact("party", "prior_owner", F.trim(get(h, "owner")), F.concat(F.lit("Recital chain link "), (i + 1).cast("string"), F.lit(": "), F.coalesce(filled(get(h, "acquisition_mode")), F.lit("transfer")))),
                ),
            )
        )
    )
    terms = F.coalesce(get(v, "special_conditions", "array<string>"), F.array().cast("array<string>"))
    out.append(F.transform(F.slice(terms, 1, 15), lambda c, i: fact("encumbrance", "special_condition", F.substr(F.trim(c), F.lit(1), F.lit(300)), F.concat(F.lit("Condition "), (i + 1).cast("string"), F.lit("/"), F.size(terms).cast("string")))))
    declared = F.trim(F.coalesce(get(v, "encumbrance_declaration"), F.lit("")))
    out.append(F.array(fact("encumbrance", "encumbrance_declaration", F.substr(declared, F.lit(1), F.lit(500)))))
    paid, guide, duty = (F.coalesce(number(get(v, f"financials.{k}")), F.lit(0.0)) for k in ("consideration_amount", "guideline_value", "stamp_duty"))
    due = F.greatest(paid, guide) * 0.07
    money = lambda c: F.format_string("%.0f", c)
    power = F.trim(F.coalesce(get(v, "power_of_attorney"), F.lit("")))
    witnesses = F.coalesce(F.size(get(v, "witnesses", "array<variant>")), F.when(get(v, "witnesses").isNull(), F.lit(0)))
    out += [
        risk((guide > 0) & (paid > 0) & (paid < guide * 0.7), "undervaluation", F.concat(F.lit("paid "), money(paid), F.lit(", guideline "), money(guide))),
        risk((paid > 0) & (duty > 0) & (duty < due * 0.5), "inadequate_stamp_duty", F.concat(F.lit("paid "), money(duty), F.lit(", due "), money(F.floor(due).cast("double")))),
        risk(F.length(power) > 5, "gpa_sale", F.concat(F.lit("by power of attorney: "), F.substr(power, F.lit(1), F.lit(200)))),
        risk(F.length(declared) < 10, "missing_encumbrance_declaration", "no declaration of encumbrances"),
        risk(witnesses < 2, "insufficient_witnesses", F.concat(witnesses.cast("string"), F.lit(" of 2 witnesses"))),
        risk(get(v, "ownership_history").isNull() | ((n == 0) & get(v, "ownership_history", "array<variant>").isNotNull()), "no_ownership_history", "no history of ownership"),
        F.transform(F.slice(F.coalesce(get(v, "_extraction_red_flags", "array<string>"), F.array().cast("array<string>")), 1, 10), lambda x: fact("risk", "extraction_red_flag", F.substr(F.trim(x), F.lit(1), F.lit(300)))),
    ]
    return out


def _patta(v: Column) -> list[Column]:
    surveys = F.filter(each(v, "survey_numbers"), is_object)
    named = F.filter(surveys, lambda s: filled(get(s, "survey_no")).isNotNull())
    all_ = F.array_join(F.transform(named, lambda s: get(s, "survey_no")), ", ")
    key = lambda s, what: F.concat(F.lit("survey_"), get(s, "survey_no"), F.lit("_" + what))
    single = F.array(fact("property", "survey_number", F.when(F.size(each(v, "survey_numbers")) > 0, all_).otherwise(get(v, "survey_number"))))
    extents = F.transform(
        named,
        lambda s: F.array(
            fact("property", key(s, "extent"), get(s, "extent")), fact("property", key(s, "class"), get(s, "classification")),
            fact("property", "extent", filled(get(s, "extent")), F.concat(F.lit("Survey "), get(s, "survey_no"))),
        ),
    )
    owners = F.when(F.size(each(v, "owner_names")) > 0, each(v, "owner_names")).when(filled(get(v, "owner")).isNotNull(), _people(v, "owner")).otherwise(_people(v, "pattadar"))
    own = F.transform(owners, lambda o: fact("party", "patta_owner", text_of(o), F.when(is_object(o), F.concat(F.lit("Share: "), _or(get(o, "share"))))))
    return [single, F.flatten(extents), own]


def _soils(v: Column) -> list[Column]:
    surveys = F.filter(each(v, "survey_numbers"), lambda s: is_object(s) & filled(get(s, "survey_no")).isNotNull())
    facts = F.transform(surveys, lambda s: F.array(fact("property", "survey_number", get(s, "survey_no")), fact("property", F.concat(F.lit("survey_"), get(s, "survey_no"), F.lit("_soil_code")), get(s, "soil_code"))))
    return [F.flatten(facts), risk(filled(get(v, "is_poramboke")).isNotNull(), "poramboke_detected", "recorded as government land")]


def _register(v: Column) -> list[Column]:
    moves = F.filter(each(v, "mutation_entries"), is_object)
    why = lambda m: F.concat(F.lit("Mutation #"), _or(get(m, "entry_number")), F.lit(": "), _or(get(m, "reason"), ""))
    chain = F.transform(moves, lambda m: F.struct(_or(get(m, "from_owner")).alias("from"), _or(get(m, "to_owner")).alias("to"), get(m, "reason").alias("type"), get(m, "date").alias("date"), get(m, "order_number").alias("order")))
    return [
        F.transform(each(v, "survey_numbers"), lambda s: fact("property", "survey_number", F.when(is_object(s), get(s, "survey_no")).otherwise(F.try_variant_get(s, "$", "string")))),
        F.flatten(F.transform(moves, lambda m: F.array(fact("party", "a_register_from", get(m, "from_owner"), why(m)), fact("party", "a_register_to", get(m, "to_owner"), why(m))))),
        F.array(fact("chain", "a_register_mutations", F.when(F.size(moves) > 0, F.to_json(chain)))),
    ]


def _adangal(v: Column) -> list[Column]:
    soil = F.lower(F.coalesce(get(v, "soil_type"), F.lit("")))
    public = F.contains(soil, F.lit("போரம்போக்கு")) | F.contains(soil, F.lit("poramboke")) | F.contains(soil, F.lit("அரசு நிலம்"))
    return [risk(public, "poramboke_detected", F.concat(F.lit("classified as "), get(v, "soil_type")))]


def _layout(v: Column) -> list[Column]:
    return [risk(get(v, "status") == "expired", "layout_expired", "the approval has expired")]


def _heirs(v: Column) -> list[Column]:
    heirs = F.filter(each(v, "heirs"), is_object)
    share = lambda h: F.concat(F.lit("Relationship: "), _or(get(h, "relationship")), F.lit(", Share: "), _or(get(h, "share_percentage")))
    minor = lambda h: F.when(filled(get(h, "minor")).isNotNull(), F.concat(F.lit("minor heir: "), _or(get(h, "name")), F.lit(" (guardian: "), _or(get(h, "guardian")), F.lit(")")))
    return [F.flatten(F.transform(heirs, lambda h: F.array(fact("party", "legal_heir", get(h, "name"), share(h)), fact("risk", "minor_heir", minor(h)))))]


def _power(v: Column) -> list[Column]:
    kind = F.lower(F.coalesce(first_of(v, "is_general_or_specific|poa_type"), F.lit("")))
    return [risk(kind.isin("general", "gpa"), "general_poa", "a general power of attorney transfers no title")]


def _court(v: Column) -> list[Column]:
    kind = F.lower(F.coalesce(get(v, "order_type"), F.lit("")))
    stops = kind.isin("injunction", "temporary_injunction", "permanent_injunction")
    return [risk(stops, "active_injunction", F.concat(F.lit("injunction in force: "), kind)), risk(kind == "attachment", "attachment_order", "the property is attached")]


def _will(v: Column) -> list[Column]:
    heirs = F.filter(each(v, "beneficiaries"), is_object)
    n = F.coalesce(F.size(get(v, "witnesses", "array<variant>")), F.when(get(v, "witnesses").isNull(), F.lit(0)))
    return [
        F.transform(heirs, lambda b: fact("party", "will_beneficiary", get(b, "name"), F.concat(F.lit("Share: "), _or(get(b, "share")), F.lit(", Property: "), _or(get(b, "property_bequeathed"))))),
        F.transform(F.filter(each(v, "witnesses"), lambda w: ~is_object(w)), lambda w: fact("party", "witness", F.trim(text_of(w)))),
        risk(n < 2, "insufficient_will_witnesses", F.concat(n.cast("string"), F.lit(" of 2 witnesses"))),
        risk(get(v, "is_registered", "boolean") == F.lit(False), "unregistered_will", "the will is not registered"),
    ]


def _partition(v: Column) -> list[Column]:
    shares = F.when(F.size(each(v, "partitioned_shares")) > 0, each(v, "partitioned_shares")).otherwise(each(v, "shares"))
    part = lambda s: F.struct(first_of(s, "name|owner").alias("to"), first_of(s, "allocated_survey|survey").alias("survey"), first_of(s, "allocated_extent|extent|share").alias("extent"))
    return [
        F.transform(each(v, "joint_owners"), lambda o: fact("party", "partition_owner", text_of(o), F.when(is_object(o), F.concat(F.lit("Original share: "), _or(get(o, "original_share")))))),
        F.transform(F.filter(shares, is_object), lambda s: fact("chain", "partition_allocation", F.to_json(part(s)))),
        risk(get(v, "consent_all_parties", "boolean") == F.lit(False), "partition_without_consent", "not all parties consented"),
    ]


def _gift(v: Column) -> list[Column]:
    paid = F.trim(filled(get(v, "consideration_amount")))
    return [
        risk(paid.isNotNull() & (paid != "nil"), "gift_with_consideration", F.concat(F.lit("consideration of "), paid)),
        risk(filled(get(v, "acceptance_clause")).isNull(), "gift_no_acceptance", "no clause of acceptance"),
    ]


def _release(v: Column) -> list[Column]:
    whole = get(v, "original_document", "variant")
    kind = F.when(is_object(whole), first_of(v, "original_document.document_type|original_document.type")).otherwise(get(v, "original_document"))
    return [F.array(fact("reference", "release_original_doc_type", kind))]


def _other(v: Column) -> list[Column]:
    pairs = F.coalesce(get(v, "property_details", "map<string,string>"), F.create_map().cast("map<string,string>"))

    def labelled(path: str, category: str, label: str, value: str, default: str) -> Column:
        own = lambda x: F.coalesce(get(x, value), F.try_variant_get(x, "$", "string"))
        return F.transform(each(v, path), lambda x: fact(category, F.when(is_object(x), _or(get(x, label), default)).otherwise(F.lit(default)), own(x)))

    return [
        F.array(*(fact("reference", k, filled(get(v, k))) for k in ("document_number", "registration_number", "case_number"))),
        labelled("key_parties", "party", "role", "name", "party"),
        F.transform(F.map_entries(pairs), lambda e: fact("property", e["key"], filled(e["value"]))),
        labelled("key_dates", "timeline", "label", "date", "date"),
        labelled("amounts", "financial", "label", "amount", "amount"),
    ]


LISTS: dict[str, Callable[[Column], list[Column]]] = {
    "EC": _ec, "SALE_DEED": _deed, "PATTA": _patta, "CHITTA": _soils, "A_REGISTER": _register, "ADANGAL": _adangal, "LAYOUT_APPROVAL": _layout, "LEGAL_HEIR": _heirs,
    "POA": _power, "COURT_ORDER": _court, "WILL": _will, "PARTITION_DEED": _partition, "GIFT_DEED": _gift, "RELEASE_DEED": _release,
}


def _any(v: Column) -> list[Column]:
    """What every kind may have: flags of the extraction, and fields that it is unsure of."""
    flags = F.coalesce(get(v, "_extraction_red_flags", "array<string>"), F.array().cast("array<string>"))
    sure = F.coalesce(get(v, "_field_confidence", "map<string,string>"), F.create_map().cast("map<string,string>"))
    weak = F.filter(F.map_entries(sure), lambda e: number(e["value"]) < SURE)
    told = F.array_join(F.transform(weak, lambda e: F.concat(e["key"], F.lit(" (conf="), e["value"], F.lit(")"))), ", ")
    return [
        F.transform(flags, lambda x: fact("risk", "extraction_red_flag", F.substr(F.trim(x), F.lit(1), F.lit(400)), "flagged during extraction", confidence=0.8)),
        F.array(fact("risk", "low_confidence_fields", F.when(F.size(weak) > 0, told), "the extraction's own confidence", confidence=0.9)),
    ]


#: The keys of each list that :data:`LISTS` and :func:`_any` give, in their order; None where a record names them.
LIST_KEYS: dict[str, tuple[tuple[str, ...] | None, ...]] = {
    "EC": (
        ("total_ec_entries",), ("ec_executant", "ec_claimant"),
        ("ec_doc_number", "ec_consideration", "ec_transaction_type", "ec_survey_number", "ec_transaction_date", "ec_market_value", "ec_pr_number", "ec_schedule_remarks"),
        ("ec_suspicious_flag",), ("ownership_transfers",), ("high_risk_transaction",),
    ),
    "SALE_DEED": (
        ("seller", "seller_aadhaar", "seller_share", "seller_pan"), ("minor_party",), ("buyer", "buyer_aadhaar", "buyer_share", "buyer_pan"), ("minor_party",), ("witness",), ("stamp_serial",), ("ownership_history",), ("recital_transfer", "prior_owner"), ("special_condition",), ("encumbrance_declaration",),
        ("undervaluation",), ("inadequate_stamp_duty",), ("gpa_sale",), ("missing_encumbrance_declaration",), ("insufficient_witnesses",), ("no_ownership_history",), ("extraction_red_flag",),
    ),
    "PATTA": (("survey_number",), None, ("patta_owner",)),
    "": (("extraction_red_flag",), ("low_confidence_fields",)),
}


def _wanted(lists: list[Column], kind: str, keys: tuple[str, ...] | None) -> list[Column]:
    """The lists that may have facts of the keys."""
    of = LIST_KEYS.get(kind, (None,) * len(lists))
    return [x for x, own in zip(lists, of, strict=True) if keys is None or own is None or set(own) & set(keys)]


def facts_of(v: Column, kind: str, keys: tuple[str, ...] | None = None) -> Column:
    """All facts of a record of a kind, as an array; those without a value too. ``keys``: at least the facts of these keys."""
    plain = [fact(c, k, first_of(v, p)) for c, k, p in FIELDS.get(kind, ()) if keys is None or k in keys]
    people = [fact("party", k, first_of(v, p, lambda x, path: text_of(get(x, path, "variant")))) for k, p in PARTIES.get(kind, ()) if keys is None or k in keys]
    lists = _wanted(_ec(v, keys) if kind == "EC" else LISTS[kind](v), kind, keys) if kind in LISTS else [] if kind in FIELDS else _other(v)
    parts = [*([F.array(*plain, *people)] if plain or people else []), *lists, *_wanted(_any(v), "", keys)]
    return F.concat(*parts) if parts else F.filter(F.array(fact("", "", F.lit(None))), lambda _: F.lit(False))


def extract(documents: DataFrame, kinds: tuple[str | None, ...] | None = None, keys: tuple[str, ...] | None = None) -> DataFrame:
    """case_id, doc_ord, filename, document_type, data (JSON) -> a row per fact with a value.

    Documents without a record have no facts; a record that is no JSON has none either.
    ``kinds``: the kinds that occur (None: the unlisted ones), for a smaller plan.
    ``keys``: the keys that are read, in the same order; what else a record says is not worked out.
    """
    out = None
    known = tuple(FIELDS)
    for kind in (*known, None) if kinds is None else kinds:
        rows = documents.where(F.col("document_type") == kind) if kind else documents.where(~F.coalesce(F.col("document_type"), F.lit("")).isin(*known))
        # a generator's output is read as a column, so that the text is parsed once
        parsed = rows.select("case_id", "doc_ord", F.col("filename").alias("source_file"), F.col("document_type").alias("source_type"), F.explode(F.array(F.try_parse_json("data"))).alias("_v")).where("_v IS NOT NULL")
        own = parsed.select("case_id", "doc_ord", "source_file", "source_type", F.posexplode(facts_of(F.col("_v"), kind or "", keys)).alias("pos", "_f")).select("case_id", "doc_ord", "source_file", "source_type", "pos", "_f.*").where(F.trim("value") != "")
        own = own if keys is None else own.where(F.col("key").isin(*keys))
        out = own if out is None else out.unionByName(own)
    return out


# conflicts

#: The keys that :func:`conflicts` reads: places, extents and surveys, the roles of buyers and owners, amounts.
CONFLICT_KEYS = (
    "survey_number", "extent", "village", "taluk", "consideration_amount", "ec_consideration",
    *(f"{front}{role}" for role in ("buyer", "claimant", "owner") for front in ("", "ec_", "patta_", "ec_patta_")),
)


def _conflict(rows: DataFrame, category: str, key: str, severity: Column | str, description: Column) -> DataFrame:
    return rows.select("case_id", F.lit(category).alias("category"), F.lit(key).alias("key"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), description.alias("description"))


def _by_source(facts: DataFrame, key: str) -> DataFrame:
    return facts.where((F.col("category") == "property") & (F.col("key") == key))


def survey_conflicts(facts: DataFrame) -> DataFrame:
    """Sources of a case whose survey numbers don't meet, or only by an error of reading."""
    rows = _by_source(facts, "survey_number").groupBy("case_id", "doc_ord", "source_file").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    own = rows.select("case_id", "doc_ord", "source_file", F.flatten(F.transform("v", lambda x: split_surveys(x["value"]))).alias("n")).where(F.size("n") > 0)
    met = own.join(own.toDF("case_id", "ord_b", "other", "m"), "case_id").where("doc_ord < ord_b").withColumn("kind", any_survey_kind("n", "m"))
    odd = met.where(F.col("kind").isin("mismatch", "ocr_fuzzy"))
    text = F.concat_ws(" / ", F.concat_ws("=", "source_file", F.array_join("n", ",")), F.concat_ws("=", "other", F.array_join("m", ",")))
    return _conflict(odd, "property", "survey_number", F.when(F.col("kind") == "mismatch", "HIGH").otherwise("WARNING"), text)


def extent_conflicts(facts: DataFrame) -> DataFrame:
    """The first extent of each source against the first source's; of a patta only surveys that others state count."""
    patta = F.col("source_type").isin("PATTA", "CHITTA")
    others = _by_source(facts, "survey_number").where(~patta).select("case_id", F.explode(split_surveys(F.col("value"))).alias("wanted")).distinct()
    extents = _by_source(facts, "extent")
    own = extents.where(patta & F.startswith("context", F.lit("Survey "))).withColumn("sn", F.substr("context", F.lit(8)))
    keys = ["case_id", "doc_ord", "source_file", "pos", "value"]
    fitting = own.join(others, "case_id").where(survey_match(F.col("sn"), F.col("wanted")) != "mismatch").select(*keys).distinct()
    every = extents.where(~patta).select(*keys).unionByName(fitting)
    first = every.groupBy("case_id", "doc_ord", "source_file").agg(F.min_by("value", "pos").alias("value")).withColumn("sqft", parse_area(F.col("value")))
    listed = F.array_sort(F.collect_list(F.struct("doc_ord", "source_file", "value", "sqft")))
    g = first.groupBy("case_id").agg(listed.alias("e")).where(F.size("e") >= 2)
    known = F.filter("e", lambda x: x["sqft"] > 0)
    ref = F.get(known, F.lit(0))["sqft"]
    apart = F.exists(known, lambda x: F.abs(ref - x["sqft"]) / F.greatest(ref, x["sqft"]) > EXTENT_TOLERANCE)
    texts = F.size(F.array_distinct(F.transform("e", lambda x: F.lower(F.trim(x["value"]))))) > 1
    odd = g.where(F.when(F.size(known) >= 2, apart).otherwise(texts))
    return _conflict(odd, "property", "extent", "WARNING", F.array_join(F.transform("e", lambda x: F.concat_ws("=", x["source_file"], x["value"])), ", "))


def place_conflicts(facts: DataFrame, key: str, severity: str, across: str) -> DataFrame:
    """Pairs of sources whose first village (or taluk) differs; ``across``: severity between two scripts."""
    first = _by_source(facts, key).groupBy("case_id", "doc_ord", "source_file").agg(F.min_by("value", "pos").alias("value"))
    met = first.join(first.toDF("case_id", "ord_b", "other", "value_b"), "case_id").where("doc_ord < ord_b").where(village_pairs("value", "value_b") == "mismatch")
    scripts = has_tamil(F.col("value")) != has_tamil(F.col("value_b"))
    return _conflict(met, "property", key, F.when(scripts, across).otherwise(severity), F.concat_ws(" / ", F.concat_ws("=", "source_file", "value"), F.concat_ws("=", "other", "value_b")))


def party_conflicts(facts: DataFrame) -> DataFrame:
    """Cases where no buyer or claimant is like any owner."""
    party = facts.where("category = 'party'").withColumn("role", F.replace(F.replace("key", F.lit("ec_"), F.lit("")), F.lit("patta_"), F.lit("")))
    buyers = party.where(F.col("role").isin("buyer", "claimant")).select("case_id", F.col("value").alias("buyer")).distinct()
    owners = party.where("role = 'owner'").select("case_id", F.col("value").alias("owner")).distinct()
    best = buyers.join(owners, "case_id").withColumn("s", name_similarity("buyer", "owner")).groupBy("case_id")
    g = best.agg(F.max("s").alias("s"), F.array_join(F.array_sort(F.collect_set("buyer")), ", ").alias("b"), F.array_join(F.array_sort(F.collect_set("owner")), ", ").alias("o"))
    return _conflict(g.where(F.col("s") < OWNER_LIKENESS), "party", "buyer_vs_owner", "HIGH", F.concat_ws(" / ", "b", "o"))


def money_conflicts(facts: DataFrame) -> DataFrame:
    """Cases whose deed and certificate share no amount."""
    money = facts.where("category = 'financial'").withColumn("v", parse_amount(F.col("value"))).where("v <> 0")
    of = lambda key: F.array_sort(F.collect_set(F.when(F.col("key") == key, F.col("v"))))
    g = money.groupBy("case_id").agg(of("consideration_amount").alias("d"), of("ec_consideration").alias("e"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.2f", x)), ", ")
    return _conflict(g.where((F.size("d") > 0) & (F.size("e") > 0) & ~F.arrays_overlap("d", "e")), "financial", "consideration_mismatch", "WARNING", F.concat_ws(" / ", shown("d"), shown("e")))


def conflicts(facts: DataFrame) -> DataFrame:
    """All typed conflicts of all cases."""
    out = survey_conflicts(facts)
    for more in (extent_conflicts(facts), place_conflicts(facts, "village", "HIGH", "MEDIUM"), place_conflicts(facts, "taluk", "MEDIUM", "LOW"), party_conflicts(facts), money_conflicts(facts)):
        out = out.unionByName(more)
    return out


def context_text(facts: DataFrame, found: DataFrame) -> DataFrame:
    """All that a case's facts and conflicts say, as lines in order of documents."""
    w = Window.partitionBy("case_id", "key", "value").orderBy("doc_ord", "pos")
    party = F.col("category") == "party"
    kept = facts.withColumn("_n", F.row_number().over(w)).where(~party | (F.col("_n") == 1))  # a party is told once
    line = F.concat(F.lit("["), F.col("category"), F.lit("] "), F.col("key"), F.lit(": "), F.substr("value", F.lit(1), F.lit(400)), F.lit(" (from "), F.col("source_file"), F.lit(")"))
    told = kept.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "doc_ord", "pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("facts"), F.count("*").alias("n"))
    odd = found.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("description")))), "\n").alias("conflicts"))
    joined = told.join(odd, "case_id", "left")
    return joined.select("case_id", F.concat_ws("\n", F.concat(F.lit("Facts: "), F.col("n").cast("string")), "conflicts", "facts").alias("context"))
