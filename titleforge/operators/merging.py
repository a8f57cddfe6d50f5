"""Partial records of one document: merged by kind, deduplicated, repaired.

A document is read in parts (chunks); each part gives a record as JSON. Rows are
(document, part, data); a merge is one aggregate per document, over as many fields
as its parts have, so rows of a document are bounded by its length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import name_similarity, similarity
from ..functions.surveys import normalize_survey
from ..functions.tamil import garbled


#: Likeness from which parties are one, and from which an owner is a buyer.
SAME_PARTY, SAME_OWNER = 0.65, 0.55
#: Hectares above which one survey's extent is implausible.
CEILING = 100.0
#: Lists that are laid one after the other, and those of them without repetition, by kind.
LISTS: dict[str, dict[str, bool]] = {
    "A_REGISTER": {"mutation_entries": False, "survey_numbers": True},
    "ADANGAL": {"crop_details": False},
    "LAYOUT_APPROVAL": {"plot_schedule": False, "conditions": True},
    "PARTITION_DEED": {"joint_owners": False, "partitioned_shares": False},
    "WILL": {"beneficiaries": False, "witnesses": True},
    "COURT_ORDER": {},
}
HECTARES = r"(?i)([0-9.]+)\s*(?:hectares?|hect|ha)"


# any kind: first value of each field, lists joined


def _blank(x: object) -> bool:
    return x is None or x == "" or x == [] or x == {}


def _distinct(items: Iterable, key: Callable = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False)) -> list:
    return list({key(x): x for x in reversed(list(items))}.values())[::-1]


def first_values(records: list[dict], lists: dict[str, bool]) -> dict:
    """The first value of each field; ``lists`` are joined (True: without repetition)."""
    out: dict = {}
    for r in records:
        for k, v in r.items():
            if k not in lists and not _blank(v) and _blank(out.get(k)):
                out[k] = v
    for k, once in lists.items():
        joined = [x for r in records for x in (r.get(k) or [])]
        if joined:
            out[k] = _distinct(joined, lambda x: str(x.get("survey_no", x)) if isinstance(x, dict) else str(x)) if once else joined
    return out


def generic(records: list[dict]) -> dict:
    """Unknown kinds: lists joined without repetition, details overlaid, summaries side by side."""
    fields = ("key_parties", "key_dates", "amounts", "notable_clauses")
    out: dict = {"property_details": {}}
    for r in records:
        if isinstance(r.get("property_details"), dict):
            out["property_details"] |= r["property_details"]
    for k in fields:
        out[k] = _distinct(x for r in records for x in (r[k] if isinstance(r.get(k), list) else [r[k]] if r.get(k) else []))
    told = [r["document_summary"] for r in records if isinstance(r.get("document_summary"), str)]
    return out | {"document_summary": " | ".join(told) or "Multiple chunks merged", "_chunked": True, "_chunk_count": len(records)}


# deeds


def _n_filled(x: object) -> int:
    return sum(bool(v) for v in x.values()) if isinstance(x, dict) else 0


def richer(a: object, b: object) -> object:
    """Of two values the one that says more; the first of equals."""
    if a in (None, "", 0):
        return b
    if b in (None, "", 0):
        return a
    if isinstance(a, dict) and isinstance(b, dict):
        return max(a, b, key=_n_filled)
    return max(a, b, key=len) if isinstance(a, list) and isinstance(b, list) else a


def union_parties(known: list, more: list) -> list:
    """Parties without those that another part names too; the fuller one stays."""
    name = lambda p: (p.get("name") or "") if isinstance(p, dict) else str(p)
    return _fuzzy_union(known, more, lambda a, b: bool(name(a)) and similarity(name(b), name(a)) >= SAME_PARTY, lambda p: bool(name(p)))


def union_history(known: list, more: list) -> list:
    """Earlier transfers without repetition (same owner, or same document), in order of their dates."""
    text = lambda h, k: (h.get(k) or "").strip()

    def same(a: dict, b: dict) -> bool:
        alike = bool(text(a, "owner")) and similarity(text(b, "owner"), text(a, "owner")) >= SAME_PARTY
        return alike or (text(a, "document_number") != "" and text(a, "document_number") == text(b, "document_number"))

    if not known or not more:
        return known or more
    out = _fuzzy_union(known, more, same, lambda h: isinstance(h, dict) and bool(text(h, "owner")))
    return sorted(out, key=lambda h: (h.get("document_date") or "") if isinstance(h, dict) else "")


def _fuzzy_union(known: list, more: list, same: Callable, usable: Callable) -> list:
    if not known or not more:
        return list(known or more)
    out = list(known)
    for x in filter(usable, more):
        at = next((i for i, y in enumerate(out) if same(y, x)), None)
        if at is None:
            out.append(x)
        elif _n_filled(x) > _n_filled(out[at]):
            out[at] = x
    return out


def merge_property(a: dict, b: dict) -> dict:
    """Field by field the richer value, boundaries side by side."""
    out = dict(a)
    for k, v in b.items():
        if k == "boundaries" and isinstance(a.get(k), dict) and isinstance(v, dict):
            out[k] = a[k] | {d: x for d, x in v.items() if x and not a[k].get(d)}
        else:
            out[k] = richer(a.get(k), v)
    return out


def deed(records: list[dict]) -> dict:
    """Parties and history united, the property field by field, else the richer value."""
    out: dict = {}
    for r in records:
        for k, v in r.items():
            if k in ("seller", "buyer", "witnesses") and isinstance(v, list):
                out[k] = union_parties(out.get(k) or [], v)
            elif k == "ownership_history" and isinstance(v, list):
                out[k] = union_history(out.get(k) or [], v)
            elif k == "property" and isinstance(v, dict):
                out[k] = merge_property(out.get(k) or {}, v)
            elif v is not None:
                out[k] = richer(out.get(k), v)
    return out


# pattas and certificates


def _more_filled(records: Iterable[dict], key: Callable[[dict], str]) -> list[dict]:
    """One record per key, where first seen: the one with more fields."""
    size = lambda r: sum(v not in (None, "") for v in r.values())
    out: dict[str, dict] = {}
    for r in records:
        k = key(r)
        if k not in out or size(r) > size(out[k]):
            out[k] = r
    return list(out.values())


def patta(records: list[dict]) -> dict:
    """Surveys once per number, owners once per name, else the richer value."""
    out: dict = {}
    for r in records:
        for k, v in r.items():
            if k not in ("survey_numbers", "owner_names") and not _blank(v):
                out[k] = v if _blank(out.get(k)) else richer(out[k], v)
    dicts = lambda f, k: [x for r in records for x in (r.get(f) or []) if isinstance(x, dict) and x.get(k)]
    surveys, owners = dicts("survey_numbers", "survey_no"), dicts("owner_names", "name")
    out["survey_numbers"] = _more_filled(surveys, lambda s: re.sub(r"\s+", "", str(s["survey_no"]).lower()).replace("-", "/"))
    out["owner_names"] = list({str(o["name"]).strip().lower(): o for o in reversed(owners)}.values())[::-1]
    return out


def certificate(records: list[dict]) -> dict:
    """Header fields from the first part that has them, rows of all parts, notes side by side."""
    head = {k: next((r[k] for r in records if r.get(k)), None) for k in ("ec_number", "property_description", "village", "taluk", "period_from", "period_to")}
    rows = [t for r in records for t in (r.get("transactions") or [])]
    key = lambda t: "|".join(str(t.get(k) or "").strip().lower()[:n] for k, n in (("document_number", 99), ("date", 99), ("transaction_type", 99), ("seller_or_executant", 30), ("buyer_or_claimant", 30), ("survey_number", 99)))
    kept: dict[str, dict] = {}
    weight = lambda t: sum(v not in (None, "", 0, []) for v in t.values())
    for t in rows:
        k = key(t)
        if k not in kept or weight(t) > weight(kept[k]):
            kept[k] = t
    seen: dict[str, int] = {}
    out = []
    for i, t in enumerate(kept.values(), 1):
        n, year, office = (str(t.get(k) or "").strip() for k in ("document_number", "document_year", "sro"))
        base = "EC-" + "-".join(x for x in (f"{n}/{year}" if year else n, office) if x) if n else f"EC-ROW{i}"
        seen[base] = seen.get(base, 0) + 1
        out.append({**t, "row_number": i, "transaction_id": base if seen[base] == 1 else f"{base}-{seen[base]}"})
    notes = [r["extraction_notes"] for r in records if r.get("extraction_notes")]
    if len(out) < len(rows):
        notes.append(f"{len(rows) - len(out)} rows of overlapping parts")
    return head | {"total_entries_found": len(out), "transactions": out, "extraction_notes": "; ".join(notes)}


MERGERS: dict[str, Callable[[list[dict]], dict]] = {"SALE_DEED": deed, "PATTA": patta, "EC": certificate, **{k: (lambda rs, own=own: first_values(rs, own)) for k, own in LISTS.items()}}


def merge_parts(parts: DataFrame, by: list[str]) -> DataFrame:
    """by, document_type, part, data -> one record per document, as JSON.

    A part that is no JSON object (a failed one) is noted, and doesn't stop the rest.
    """
    kinds = parts.groupBy(*by, "document_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "data"))), lambda p: p["data"]).alias("_parts"))

    @F.pandas_udf("string")
    def merged(kind: pd.Series, data: pd.Series) -> pd.Series:
        def one(kind_: str, texts: list[str | None]) -> str:
            records, failed = [], []
            for i, text in enumerate(texts, 1):
                try:
                    r = json.loads(text or "null")
                except ValueError:
                    r = None
                if isinstance(r, dict):
                    records.append(r)
                else:
                    failed.append(f"Chunk {i} failed")
            out = MERGERS.get(kind_, generic)(records)
            if failed:
                at = "remarks" if kind_ == "SALE_DEED" else "extraction_notes"
                out[at] = "; ".join([x for x in (out.get(at),) if x] + failed)
            return json.dumps(out, ensure_ascii=False, sort_keys=True)

        return pd.Series([one(k, t) for k, t in zip(kind, data)], dtype="object")

    return kinds.select(*by, "document_type", merged("document_type", "_parts").alias("data"))


# repairs of pattas


def fix_serial(extent: Column) -> Column:
    """An extent behind the row's number (7.92.50): without it, if that is 1 to 20 and dwarfs the rest."""
    pattern = r"(?i)^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{2,4})\s*(hectares?|hect|ha|ஹெக்டேர்|ஹெ)?"
    s = F.trim(extent)
    a, b, c = (F.regexp_extract(s, pattern, i).try_cast("double") for i in (1, 2, 3))
    real = b / 100 + c / 10000
    wrong = (a >= 1) & (a <= 20) & (real < 100) & (a + real > 5 * real)
    return F.when(s.rlike(pattern) & wrong, F.concat(F.format_string("%.4f", real), F.lit(" hectares"))).otherwise(extent)


def fix_survey_prefix(extent: Column, bases: Column) -> Column:
    """An extent behind a survey number of the record (317.925): only the decimals, if they are a fiftieth or less."""
    pattern = r"(?i)^([0-9]{2,4})\.?([0-9]{1,4}(?:\.[0-9]+)?)\s*(hectares?|hect|ha|ஹெக்டேர்|ஹெ)"
    s = F.trim(extent)
    head, tail = F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2)
    real, whole = F.concat(F.lit("0."), tail).try_cast("double"), F.concat(head, F.lit("."), tail).try_cast("double")
    return F.when(s.rlike(pattern) & F.array_contains(bases, head) & (real > 0) & (whole / real > 50), F.concat(F.format_string("%.4f", real), F.lit(" hectares"))).otherwise(extent)


def hectares(extent: Column) -> Column:
    return F.regexp_extract(extent, HECTARES, 1).try_cast("double")


def total_extent(surveys: Column) -> Column:
    """The sum of the surveys' hectares as text; null if none is stated."""
    stated = F.filter(F.transform(surveys, lambda s: hectares(s["extent"])), lambda x: x.isNotNull())
    return F.when(F.size(stated) > 0, F.concat(F.format_string("%.4f", F.aggregate(stated, F.lit(0.0), lambda t, x: t + x)), F.lit(" hectares")))


def dedup_surveys(surveys: Column) -> Column:
    """Surveys once per normal form, where first seen: the entry with more fields."""
    normal = lambda s: F.coalesce(F.when(normalize_survey(s["survey_no"]) != "", normalize_survey(s["survey_no"])), F.trim(s["survey_no"]))
    size = lambda s: sum(F.when(F.coalesce(s[k], F.lit("")) != "", 1).otherwise(0) for k in ("survey_no", "extent", "classification"))
    keyed = F.transform(F.filter(surveys, lambda s: F.trim(s["survey_no"]) != ""), lambda s, i: F.struct(normal(s).alias("k"), size(s).alias("n"), (-i).alias("i"), s.alias("s")))
    keys = F.array_distinct(F.transform(keyed, lambda x: x["k"]))
    return F.transform(keys, lambda k: F.array_max(F.transform(F.filter(keyed, lambda x: x["k"] == k), lambda x: F.struct(x["n"].alias("n"), x["i"].alias("i"), x["s"].alias("s"))))["s"])


def implausible(surveys: Column, total: Column) -> Column:
    """Notes on extents above what one survey, or all together, can plausibly have."""
    one = F.transform(F.filter(surveys, lambda s: hectares(s["extent"]) > CEILING), lambda s: F.concat(F.lit("survey "), s["survey_no"], F.lit(": "), F.format_string("%.2f", hectares(s["extent"])), F.lit(" ha")))
    n = F.greatest(F.size(surveys), F.lit(1))
    return F.concat(one, F.filter(F.array(F.when(hectares(total) > CEILING * n, F.concat(F.lit("total: "), F.format_string("%.2f", hectares(total)), F.lit(" ha")))), lambda x: x.isNotNull()))


def owner_key(name: Column) -> Column:
    """A name without initials and spaces, in lower case. Vowel signs don't count as parts of words here."""
    edge = r"(?:(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_]))"
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), edge + r"[a-z஀-௿]\.\s*", ""), r"\s+", "")


def merge_couples(owners: Column, text: Column) -> Column:
    """Owners without husbands who stand there besides their wives; the wife keeps his name as father_name.

    Couples are what the text writes as one (husband, mark, wife); without any, owners whose
    father_name is another owner's name.
    """
    pattern = r"(?i)([^\n,;]+?)\s+(?:மனைவி|w/o|wife\s+of)\s+([^\n,;]+)"
    t = F.coalesce(text, F.lit(""))
    written = F.zip_with(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)), lambda h, w: F.struct(owner_key(h).alias("h"), owner_key(w).alias("w")))
    named = F.transform(owners, lambda o: owner_key(o["name"]))
    inferred = F.transform(F.filter(owners, lambda o: (owner_key(o["father_name"]) != "") & F.array_contains(named, owner_key(o["father_name"])) & (owner_key(o["father_name"]) != owner_key(o["name"]))), lambda o: F.struct(owner_key(o["father_name"]).alias("h"), owner_key(o["name"]).alias("w")))
    couples = F.when(F.size(written) > 0, written).otherwise(inferred)
    husbands, wives = F.transform(couples, lambda c: c["h"]), F.transform(couples, lambda c: c["w"])
    husband_of = lambda o: F.filter(couples, lambda c: c["w"] == owner_key(o["name"]))
    his_name = lambda o: F.get(F.transform(F.filter(owners, lambda h: owner_key(h["name"]) == F.element_at(husband_of(o), -1)["h"]), lambda h: F.trim(h["name"])), F.lit(0))
    kept = F.filter(owners, lambda o: ~F.array_contains(husbands, owner_key(o["name"])) | F.array_contains(wives, owner_key(o["name"])))
    told = F.transform(kept, lambda o: F.struct(o["name"].alias("name"), F.when(F.size(husband_of(o)) > 0, F.coalesce(his_name(o), o["father_name"])).otherwise(o["father_name"]).alias("father_name"), o["share"].alias("share")))
    return F.when((F.size(owners) < 2) | (F.size(couples) == 0), owners).otherwise(told)


def repair_pattas(pattas: DataFrame, text: Column) -> DataFrame:
    """total_extent, survey_numbers and owner_names put right, in the order that the repairs need."""
    shaped = lambda s, x: F.struct(s["survey_no"].alias("survey_no"), x.alias("extent"), s["classification"].alias("classification"))
    one = pattas.withColumns({"total_extent": fix_serial(F.col("total_extent")), "_serial": F.transform("survey_numbers", lambda s: shaped(s, fix_serial(s["extent"])))})
    bases = F.filter(F.transform("_serial", lambda s: F.regexp_extract(F.trim(s["survey_no"]), r"^([0-9]+)", 1)), lambda b: b != "")
    two = one.withColumn("_bases", bases).withColumn("_fixed", F.transform("_serial", lambda s: shaped(s, fix_survey_prefix(s["extent"], F.col("_bases")))))
    moved = F.exists(F.arrays_zip(F.col("_serial").alias("a"), F.col("_fixed").alias("b")), lambda p: ~p["a"]["extent"].eqNullSafe(p["b"]["extent"]))
    three = two.withColumn("total_extent", F.when(moved, F.coalesce(total_extent(F.col("_fixed")), F.col("total_extent"))).otherwise(F.col("total_extent"))).withColumn("survey_numbers", dedup_surveys(F.col("_fixed")))
    four = three.withColumn("extent_notes", implausible(F.col("survey_numbers"), F.col("total_extent")))
    return four.withColumn("owner_names", merge_couples(F.col("owner_names"), text)).drop("_serial", "_bases", "_fixed")


# repairs of deeds and sketches


def swapped_parties(parties: DataFrame, hints: DataFrame) -> DataFrame:
    """Documents whose sellers are the text's buyers and the reverse, and not the right way round.

    ``parties``: doc, role, name as extracted; ``hints``: doc, role, name, garbage as the
    text's parts name them. Documents whose hints are mostly parts of addresses are left alone.
    """
    sound = hints.groupBy("doc").agg((F.count_if("garbage") <= 0.5 * F.count("*")).alias("ok"), F.count_if(F.col("role") == "seller").alias("s"), F.count_if(F.col("role") == "buyer").alias("b")).where("ok and s > 0 and b > 0")
    met = parties.join(hints.select("doc", F.col("role").alias("hint_role"), F.col("name").alias("hint")), "doc").join(sound.select("doc"), "doc", "left_semi")
    like = met.withColumn("same", name_similarity("name", "hint") >= SAME_OWNER)
    any_ = lambda a, b: F.coalesce(F.bool_or(F.when((F.col("role") == a) & (F.col("hint_role") == b), F.col("same"))), F.lit(False))
    g = like.groupBy("doc").agg(any_("seller", "seller").alias("ss"), any_("buyer", "buyer").alias("bb"), any_("seller", "buyer").alias("sb"), any_("buyer", "seller").alias("bs"))
    return g.where("sb and bs and not (ss or bb)").select("doc")


def unswap(parties: DataFrame, hints: DataFrame) -> DataFrame:
    """The parties with the roles of swapped documents exchanged."""
    wrong = swapped_parties(parties, hints).withColumn("_swap", F.lit(True))
    other = F.when(F.col("role") == "seller", "buyer").when(F.col("role") == "buyer", "seller").otherwise(F.col("role"))
    return parties.join(wrong, "doc", "left").withColumn("role", F.when(F.col("_swap"), other).otherwise(F.col("role"))).drop("_swap")


def past_transfers(history: DataFrame, buyers: DataFrame) -> DataFrame:
    """doc, pos, owner of a deed's history without entries whose owner is a buyer: that is the current sale."""
    met = history.where(F.trim("owner") != "").join(buyers.where("name <> ''").select("doc", "name"), "doc")
    current = met.where(name_similarity(F.trim("owner"), F.col("name")) >= SAME_OWNER).select("doc", "pos").distinct()
    return history.join(current, ["doc", "pos"], "left_anti")


def override_header(record: Column, header: Column) -> Column:
    """A sketch's fields under its printed header: the survey number always, places only where empty; and what was corrected."""
    own, printed = F.trim(F.coalesce(record["survey_number"], F.lit(""))), F.when(header["survey_number"] != "", header["survey_number"])
    place = lambda k: F.when(F.trim(F.coalesce(record[k], F.lit(""))) == "", F.coalesce(header[k], record[k])).otherwise(record[k])
    flag = F.when((own != "") & (own != printed), F.concat(F.lit("survey number "), own, F.lit(" corrected to the header's "), printed))
    return F.struct(F.coalesce(printed, record["survey_number"]).alias("survey_number"), *(place(k).alias(k) for k in ("village", "taluk", "district")), flag.alias("red_flag"))


def flag_garbled(transactions: DataFrame) -> DataFrame:
    """Rows of certificates with low confidence where a party's Tamil is damaged (names of four characters or more)."""
    low = lambda c: F.when((F.length(c) >= 4) & garbled(F.col(c))["is_garbled"], F.lit("low"))
    return transactions.withColumns({f"{c}_confidence": low(c) for c in ("seller_or_executant", "buyer_or_claimant")})
