"""How sure an extraction is: six signals, a score, weak fields, a score per field."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


#: Fields that a record of a kind must have.
REQUIRED: dict[str, tuple[str, ...]] = {
    "EC": ("ec_number", "property_description", "period_from", "period_to", "total_entries_found", "transactions", "extraction_notes"),
    "PATTA": ("patta_number", "owner_names", "survey_numbers", "village", "taluk", "district", "total_extent", "land_classification", "remarks"),
    "SALE_DEED": (
        "document_number", "registration_date", "execution_date", "sro", "seller", "buyer", "property", "property_description", "financials", "payment_mode", "previous_ownership",
        "ownership_history", "encumbrance_declaration", "possession_date", "witnesses", "special_conditions", "power_of_attorney", "remarks",
    ),
    "FMB": ("survey_number", "village", "taluk", "boundaries", "remarks"),
    "ADANGAL": ("survey_number", "owner_name", "extent", "soil_type", "village", "taluk", "remarks"),
    "LAYOUT_APPROVAL": ("approval_number", "authority", "approval_date", "village", "remarks"),
    "LEGAL_HEIR": ("deceased_name", "date_of_death", "heirs", "remarks"),
    "POA": ("principal", "agent", "powers_granted", "is_general_or_specific", "revocation_status", "remarks"),
    "COURT_ORDER": ("case_number", "court_name", "order_type", "petitioner", "respondent", "status", "remarks"),
    "WILL": ("testator", "beneficiaries", "probate_status", "remarks"),
    "PARTITION_DEED": ("joint_owners", "partitioned_shares", "remarks"),
    "GIFT_DEED": ("donor", "donee", "is_revocable", "acceptance_clause", "remarks"),
    "RELEASE_DEED": ("releasing_party", "beneficiary", "original_document", "claim_released", "remarks"),
    "A_REGISTER": ("owner_name", "survey_numbers", "village", "taluk", "remarks"),
    "CHITTA": ("owner_name", "survey_numbers", "village", "taluk", "remarks"),
}
OTHER = ("document_summary", "key_parties", "property_details", "key_dates", "amounts", "notable_clauses")
#: Fields that a structure, or every element of a list, must have.
INSIDE: dict[tuple[str, str], tuple[str, ...]] = {
    ("EC", "transactions"): ("row_number", "date", "document_number", "transaction_type", "seller_or_executant", "buyer_or_claimant"),
    ("PATTA", "owner_names"): ("name", "father_name", "share"),
    ("PATTA", "survey_numbers"): ("survey_no", "extent", "classification"),
    ("SALE_DEED", "seller"): ("name",),
    ("SALE_DEED", "buyer"): ("name",),
    ("SALE_DEED", "witnesses"): ("name",),
    ("SALE_DEED", "property"): ("survey_number", "village", "taluk", "district", "extent", "boundaries", "property_type"),
    ("SALE_DEED", "financials"): ("consideration_amount", "guideline_value", "stamp_duty", "registration_fee"),
    ("SALE_DEED", "previous_ownership"): ("document_number", "document_date", "previous_owner", "acquisition_mode"),
    ("SALE_DEED", "ownership_history"): ("owner", "acquisition_mode"),
    ("FMB", "boundaries"): ("north", "south", "east", "west"),
    ("LEGAL_HEIR", "heirs"): ("name", "relationship"),
    ("POA", "principal"): ("name",),
    ("POA", "agent"): ("name",),
    ("WILL", "testator"): ("name",),
    ("WILL", "beneficiaries"): ("name", "relationship"),
    ("PARTITION_DEED", "joint_owners"): ("name",),
    ("PARTITION_DEED", "partitioned_shares"): ("name", "allocated_extent"),
    ("GIFT_DEED", "donor"): ("name",),
    ("GIFT_DEED", "donee"): ("name",),
    ("RELEASE_DEED", "releasing_party"): ("name",),
    ("RELEASE_DEED", "beneficiary"): ("name",),
}
#: Texts that stand for nothing, words of doubt, dates that are none.
PLACEHOLDER = r"(?i)^(n/?a|not\s*available|not\s*found|not\s*provided|not\s*mentioned|unknown|unclear|illegible|unreadable|unable\s*to\s*(extract|read|determine)|nil|none|empty|\-{2,}|\.{3,}|\?|0{4}[-/]0{1,2}[-/]0{1,2})$"
DOUBT = r"(?i)unclear|illegible|could\s*not\s*(determine|read|extract)|unable\s*to|unreadable|uncertain|ambiguous|partially\s*visible|low.?quality|garbled|corrupted|missing|not\s*legible"
NO_DATE = r"^(0{4}|9{4})[-/](0{1,2}|9{1,2})[-/](0{1,2}|9{1,2})$"
MONEY = ("consideration_amount", "guideline_value", "stamp_duty", "registration_fee", "total_entries_found")
ZEROS = ("0", "0.0", "0.00", "₹0", "Rs.0", "Rs. 0")
#: What a page quality costs; the score from which an extraction is trusted.
QUALITY_COST = {"EMPTY": 0.5, "LOW": 0.35, "MIXED": 0.15}
TRUSTED = 0.7
#: Bands of a check's data, and what the words for a field's confidence are worth.
BANDS = (("HIGH", 0.85), ("MODERATE", 0.65), ("LOW", 0.45))
WORDS = {"high": 1.0, "medium": 0.7, "low": 0.4}
_SURVEY = r"^[0-9]+[a-zA-Z]?(?:[/\-][0-9]+[a-zA-Z]?[0-9]*)*$"
_SURVEY_PREFIX = r"(?i)^(?:[srton]\.?\s*[fs]?\.?\s*no\.?|survey\s*no\.?|sy\.?\s*no\.?|புல\s*எண்\.?|நில\s*எண்\.?)\s*:?\s*"


def empty(x: object) -> bool:
    if isinstance(x, str):
        return not x.strip() or re.match(PLACEHOLDER, x.strip()) is not None
    return x is None or (isinstance(x, (list, dict)) and not x)


def _zero(x: object) -> bool:
    return (isinstance(x, (int, float)) and not isinstance(x, bool) and x == 0) or (isinstance(x, str) and x.strip() in ZEROS)


def _weak_fields(r: dict, kind: str) -> list[str]:
    """Required fields that are empty, mostly empty inside, or a zero where money belongs."""
    out = []
    for field in REQUIRED.get(kind, OTHER):
        x, inside = r.get(field), INSIDE.get((kind, field), ())
        if empty(x):
            out.append(field)
            continue
        if isinstance(x, dict) and inside and sum(empty(x.get(k)) for k in inside) > 0.5 * len(inside):
            out.append(field)
        rows = [e for e in x if isinstance(e, dict)] if isinstance(x, list) else []
        if rows and inside and sum(empty(e.get(k)) for e in rows for k in inside) > 0.4 * len(inside) * len(x):
            out.append(field)
        if field in MONEY and _zero(x):
            out.append(field)
        if field == "financials" and isinstance(x, dict):
            out += [f"financials.{k}" for k, v in x.items() if k in MONEY and _zero(v)]
    return out


def _odd_values(r: dict) -> list[str]:
    """Survey numbers, places and amounts that don't look like one."""
    from ..functions.scalars import _NUMBER

    prop = r["property"] if isinstance(r.get("property"), dict) else {}
    surveys = [("property.survey_number", prop.get("survey_number")), *(("survey_numbers", s.get("survey_no")) for s in r.get("survey_numbers") or [] if isinstance(s, dict))]
    out = []
    for field, s in surveys:
        normal = re.sub(r"\s+", "", re.sub(_SURVEY_PREFIX, "", str(s or "").strip().lower())).replace("-", "/")
        if normal and not re.match(_SURVEY, normal):
            out.append(field)
    for field in ("village", "taluk", "district"):
        name = r.get(field) or prop.get(field)
        if isinstance(name, str) and name and (not 3 <= len(name.strip()) <= 60 or name.replace(" ", "").strip().isdigit()):
            out.append(field)
    for field in MONEY[:3]:
        x = (r.get("financials") or {}).get(field) if isinstance(r.get("financials"), dict) else None
        if isinstance(x, str) and x:
            bare = re.sub(r"(?i)(₹|INR|Rs\.?|,|\s|crores?|crs?|lakhs?|lacs?|\.$)", "", x)
            if not re.match(_NUMBER, bare):
                out.append(f"financials.{field}")
    return out


def _damaged(text: str) -> bool:
    """The damage of :func:`..functions.tamil.garbled`, for a text outside a column."""
    n = lambda p: len(re.findall(p, text))
    tamil = n("[஀-௿]")
    if tamil < 3:
        return False
    parts = max(1, n("[ா-௏]") + n("[க-ஹ]") + n("[அ-ஔ]"))
    orphans, mixed = n("(?<![க-ஹ])[ா-௏]") / parts, n("[ऀ-୿ఀ-ൿ]") / tamil
    return round(max(0.0, 1 - orphans * 1.5 - mixed * 2.0), 3) < 0.5 or orphans > 0.3 or mixed > 0.2


def _damaged_fields(r: dict) -> list[str]:
    out = []

    def look(path: str, x: object, depth: int) -> None:
        if isinstance(x, str):
            if len(x) >= 4 and _damaged(x):
                out.append(path)
        elif depth and isinstance(x, dict):
            for k, v in x.items():
                look(f"{path}.{k}", v, depth - 1 if path.endswith("]") else 0)
        elif depth and isinstance(x, list):
            for i, v in enumerate(x):
                look(f"{path}[{i}]", v, 1)

    for k, v in r.items():
        if not k.startswith("_"):
            look(k, v, 1)
    return out


def assess(record: object, kind: str, quality: str = "HIGH") -> dict:
    """score, trusted, weak_fields and per field a score, of one record."""
    required = REQUIRED.get(kind, OTHER)
    if not isinstance(record, dict) or record.get("_fallback"):
        return {"score": 0.0, "trusted": False, "weak_fields": list(required), "fields": {f: 0.0 for f in required}}
    weak = _weak_fields(record, kind)
    score = 1.0 - QUALITY_COST.get(quality, 0.0) - 0.5 * len(weak) / max(1, len(required))
    doubts = any(isinstance(record.get(k), str) and re.search(DOUBT, record[k]) for k in ("remarks", "extraction_notes"))
    score -= 0.15 * doubts
    for field in ("registration_date", "period_from", "period_to"):
        if isinstance(record.get(field), str) and re.match(NO_DATE, record[field].strip()):
            score -= 0.1
            if field not in weak:
                weak.append(field)
    odd, damaged = _odd_values(record), _damaged_fields(record)
    score -= min(0.2, 0.05 * len(odd)) + min(0.4, 0.12 * len(damaged))
    weak += odd + damaged
    hits = lambda f: sum(w == f or w.startswith((f + ".", f + "[")) for w in weak)
    fields = {f: round(1.0 - min(0.8, 0.25 * hits(f)), 3) for f in required}
    for w in dict.fromkeys(weak):
        if re.split(r"[.\[]", w)[0] not in fields:
            fields[w] = round(max(0.0, 1.0 - 0.25 * sum(x == w or x.startswith(w + ".") for x in weak)), 3)
    score = round(min(1.0, max(0.0, score)), 3)
    return {"score": score, "trusted": score >= TRUSTED, "weak_fields": list(dict.fromkeys(weak)), "fields": fields}


_RESULT = T.StructType([
    T.StructField("score", T.DoubleType()), T.StructField("trusted", T.BooleanType()), T.StructField("weak_fields", T.ArrayType(T.StringType())), T.StructField("fields", T.MapType(T.StringType(), T.DoubleType())),
])


@pandas_udf(_RESULT)
def extraction_confidence(data: pd.Series, kind: pd.Series, quality: pd.Series) -> pd.DataFrame:
    """:func:`assess` of JSON records; a record that is no JSON object is not trusted at all."""

    def one(text: str | None, k: str | None, q: str | None) -> dict:
        try:
            r = json.loads(text or "null")
        except ValueError:
            r = None
        return assess(r, k or "", q or "HIGH")

    return pd.DataFrame([one(*x) for x in zip(data, kind, quality)], columns=["score", "trusted", "weak_fields", "fields"])


def with_confidence(documents: DataFrame) -> DataFrame:
    """Documents (document_type, data, extraction_quality) with score, trust, weak fields and field scores."""
    c = extraction_confidence("data", "document_type", "extraction_quality")
    return documents.withColumn("_c", c).select(*documents.columns, F.col("_c.score").alias("confidence"), "_c.trusted", "_c.weak_fields", F.col("_c.fields").alias("field_confidences"))


def band(score: Column) -> Column:
    return F.coalesce(*(F.when(score >= least, F.lit(name)) for name, least in BANDS), F.lit("VERY_LOW"))


def least_confidence(documents: DataFrame, kinds: Column | None = None) -> DataFrame:
    """case_id and the least confidence that any field of its documents (of some kinds) states; cases without any go."""
    words = F.create_map(*(F.lit(x) for kv in WORDS.items() for x in kv))
    rows = documents if kinds is None else documents.where(F.array_contains(kinds, F.col("document_type")))
    stated = rows.select("case_id", F.explode(F.try_variant_get(F.try_parse_json("data"), "$._field_confidence", "map<string,string>")).alias("field", "told"))
    worth = F.coalesce(F.try_element_at(words, F.lower("told")), F.lit(WORDS["medium"]))
    g = stated.groupBy("case_id").agg(F.round(F.min(worth), 3).alias("data_confidence_score"))
    return g.withColumn("data_confidence", band(F.col("data_confidence_score")))
