"""Fields of a sale deed from its text, by patterns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .scalars import number

#: Patterns of registration numbers and survey numbers.
REGISTRATION = r"(?i)R\s*/\s*([A-Za-z஀-௿]+(?:\s+[A-Za-z஀-௿]+)*)\s*/\s*Book\s*([0-9]+)\s*/\s*([0-9]+)\s*/\s*([0-9]{4})"
REGISTRATION_SHORT = r"(?:வருடம்|அஞ்சல்\s*எண்)[:\s]*([0-9]{3,5})\s*/?\s*([0-9]{2,4})"
SURVEY_TAMIL = r"(?:க\s*\.\s*ச\s*\.?\s*(?:எண்\s*\.?\s*)?|புல\s*(?:எண்|ம்\s*எண்)\s*\.?\s*)(\d+(?:\s*/\s*\w+)*)"
SURVEY_ENGLISH = r"(?:S\.?\s*F\.?\s*No\.?\s*|T\.?\s*S\.?\s*No\.?\s*|R\.?\s*S\.?\s*No\.?\s*|Survey\s+No\.?\s*)(\d+(?:\s*/\s*\w+)*)"
#: Patterns of ids, money and stamp paper.
PAN = r"(?i)(?:PAN\s*(?:NO\.?\s*)?)?([A-Z]{5}\s?[0-9]{4}\s?[A-Z])"
AADHAAR = r"(?i)(?:aadhaar|aadhar|UID|ஆதார்|ஆதா(?:ர்)?\s*எண்)\s*(?:NO\.?\s*)?[:\s]*([0-9]{4}\s?[0-9]{4}\s?[0-9]{4})"
AADHAAR_BARE = r"\b([0-9]{4}\s[0-9]{4}\s[0-9]{4})\b"
AMOUNT = r"(?:ரூபாய்|ரூ\.?|₹|Rs\.?)\s*([0-9,]+(?:\.[0-9]{1,2})?)\s*(?:/\s*-)?"
VENDOR = r"(?i)(?:stamp\s*vendor|முத்திரைத்தாள்\s*வணிகர்)\s*[:\-]?\s*([A-Za-z஀-௿][A-Za-z஀-௿\s.]{3,60})"
VENDOR_LICENSED = r"(?i)licensed\s+(?:stamp\s+)?vendor\s*[:\-]?\s*([A-Za-z][A-Za-z\s.]{3,60})"
SERIAL = r"[A-Za-z]\s*[0-9]{5,8}"
STAMP_VALUE = r"(?:Rs\.?|ரூ\.?)\s*\n?\s*([0-9,]+)\s*\n"
DENOMINATION = r"(?i)(?:Rs\.?|ரூ\.?|₹)\s*([0-9,]+)\s*(?:/\s*-)?"
STAMP_DUTY = r"(?i)(?:முத்திரை(?:த்)?\s*தீர்வை|stamp\s*duty|முத்திரைத்தாள்\s*(?:கட்டணம்|விலை))\s*(?:ரூ\.?|Rs\.?|₹)\s*([0-9,]+)"
#: Kinds of land, in the order of trial.
LAND = (
    (r"நன்சை|நன்செய்|wet\s*land", "Wet"),
    (r"புன்சை|புஞ்சை|புன்செய்|dry\s*land", "Dry"),
    (r"மைதானம்|maidan", "Maidan"),
    (r"தோட்டம்|garden", "Garden"),
)
#: Ways of payment, in the order of trial.
PAYMENT = (
    (r"NEFT|RTGS|(?:online|bank)\s*transfer|வங்கி\s*பரிவர்த்தனை", "Bank Transfer"),
    (r"(?:demand\s*)?draft|வங்கி\s*வரைவோலை|D\.?D\.?", "Demand Draft"),
    (r"cheque|காசோலை|காசாளை|செக்", "Cheque"),
    (r"ரொக்க(?:ம்|மாக)|cash|நகத", "Cash"),
)
#: Words that declare a property free of burdens.
FREE = (
    r"(?i)(?:பாரமில்லை"
    r"|பாரம்?\s*(?:இல்லை|இல்ல)"
    r"|எவ்வித(?:மான)?\s*பாரம்?\s*(?:இல்லை|இல்ல)"
    r"|free\s*(?:from|of)\s*(?:all\s*)?encumbrance"
    r"|no\s*encumbrance"
    r"|ஈடு\s*கட்டு\s*இல்லை"
    r"|இந்தச?\s*சொத்து\s*எவ்வித)"
)
#: Words that mention an earlier transfer.
TRANSFER = (
    r"(?i)(?:பத்திரம்\s*(?:எழுதி|வைத்|வழங்கி|கொடுத்)"
    r"|deed\s*(?:dated|no|number|executed)"
    r"|கிரய(?:(?:ப்\s*)?பத்திரம்|ம்)"
    r"|sale\s*deed\s*(?:dated|no)"
    r"|வாரிசு\s*(?:சான்|பட்ட)"
    r"|பாகப்பிரிவினை"
    r"|தான\s*(?:(?:ப்\s*)?பத்திரம்|ம்)"
    r"|settlement\s*deed)"
)
#: Words of farm land, homes and trade; the pattern of a house site.
AGRICULTURAL = ("விவசாய", "விவசாயம்", "நிலம்", "புன்செய்", "புஞ்சை", "நன்செய்", "agricultural", "farm", "dry land", "wet land")
RESIDENTIAL = ("வீட்டு", "குடியிருப்பு", "residential", "house site", "plot", "flat", "apartment")
COMMERCIAL = ("வணிக", "commercial", "shop", "office", "industrial")
HOUSE_SITE = "மனை(?!வி)"
#: Where the buyer's part begins; names after a title; words that no name holds.
BUYER_MARKS = ("எழுதி வாங்குபவர்", "வாங்குபவர்", "எழுதி வாங்கு", "purchaser")
TITLED = (
    r"(?iu)(?:திரு(?:மதி)?\.?\s*|Thiru(?:mathi)?\.?\s*|Mr\.?\s*|Mrs\.?\s*|Sri\.?\s*|Smt\.?\s*)"
    r"([A-Za-z஀-௿][\p{L}\p{N}_\s.஀-௿]{1,40}?)(?:\s+அவர்கள்|\s+S/o|\s+D/o|\s+W/o|\s+மகன்|\s+மகள்|\s+மனைவி|\s*,|\s*\n)"
)
NO_NAME = (
    "மாவட்டம்", "தாலூக்கா", "தாலூக்", "கிராமம்", "கிராம", "நகரம்", "டவுன்", "வட்டம்", "பேட்டை", "நகர்", "மண்டலம்",
    "ஊராட்சி", "மாநகரம்", "மாவட்ட", "பகுதி", "ரோடு", "வீதி", "எக்ஸ்டென்சன்", "லேஅவுட்", "district", "taluk", "town",
    "village", "nagar", "road", "street", "extension", "layout", "இலக்கமிட்ட", "விலாசத்தில்", "வசித்து",
)
#: Where a schedule begins and ends, words before a described property, words of recitals, of addresses.
SCHEDULE = r"(?i)(?:அட்டவணை|சொத்து\s*விவரம்|property\s*schedule|schedule\s*of\s*property)"
SCHEDULE_END = r"(?i)(?:சாட்சிகள்|எழுதிக் கொடுப்பவர்|witness|signature)"
INTRO = r"(?i)(?:கீழ்க்கண்ட\s*சொத்து|கீழ்கண்ட\s*சொத்து|below\s*mentioned\s*property|property\s*more\s*fully\s*described|சொத்தின்\s*விவரம்)"
RECITAL = r"(?i)(?:பட்டா\s*எண்|patta\s*no|previously|earlier\s*deed|முன்பு|முந்தைய|பழைய\s*பத்திரம்|கிரையப்\s*பத்திரம்\s*எழுதிக்)"
ADDRESS = r"(?i)வசித்து\s*வரும்|கதவு\s*எண்|வீட்டில்|door\s*no|residing\s*at|முகவரி|address"
ADDRESS_LINE = ("வசித்து வரும்", "கதவு எண்", "வீட்டில்", "door no")
#: How villages, taluks and districts are named, in the order of trial.
VILLAGE = (
    r"([஀-௿][஀-௿\w\s\.]{2,40}?)\s+கிராமம்",
    r"(?:கிராமம்|கிராம)\s*[,:.]?\s*([஀-௿][^\n,;]{2,40})",
    r"([஀-௿][஀-௿\s]{2,30})\s*கிராமத்தில்",
)
TALUK = (
    r"([஀-௿][஀-௿\w\s\.]{2,40}?)\s+(?:தாலூக்கா|தாலூக்|வட்டம்)",
    r"(?:தாலூக்கா|தாலூக்|வட்டம்)\s*[,:.]?\s*([஀-௿][^\n,;]{2,40})",
)
DISTRICT = (
    r"([஀-௿][஀-௿\w\s\.]{2,40}?)\s+மாவட்டம்",
    r"(?:மாவட்டம்)\s*[,:.]?\s*([஀-௿][^\n,;]{2,40})",
)
#: An earlier deed, its date, its owner.
EARLIER_DEED = r"(?i)(?:பத்திரம்\s*எழுதிக்?\s*கொடுத்|deed\s*(?:dated|executed))"
EARLIER_DATE = r"(?i)([0-9]{1,2}[.\-/][0-9]{1,2}[.\-/][0-9]{4})\s*-?\s*(?:ம்\s*)?(?:தேதி|dated|நாள்)"
EARLIER_OWNER = r"(?iu)(?:திரு|Mr|Sri|Thiru)\.?\s*([A-Za-z஀-௿][\p{L}\p{N}_\s.஀-௿]{2,50}?)\s*(?:அவர்கள|கவுண்டர்|S/o|D/o|W/o)"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _squeezed(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda x: F.upper(F.regexp_replace(x, r"\s+", ""))))


def _none(c: Column) -> Column:
    return F.when(c != "", c)


def _whole(text: Column) -> Column:
    return number(F.replace(text, F.lit(","), F.lit(""))).cast("long")


def _first(text: Column, cases: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(*(F.when(text.rlike(f"(?i)(?:{p})"), F.lit(v)) for p, v in cases), F.lit(None).cast("string"))


# zones


def schedule_zone(text: Column) -> Column:
    """The schedule of the property: from its heading to the next part, 2,000 characters at most; null without one."""
    start = F.regexp_instr(text, F.lit(SCHEDULE))
    after = F.regexp_instr(F.substr(text, start + 100), F.lit(SCHEDULE_END))
    return F.when(start > 0, F.substr(text, start, F.when(after > 0, after + 99).otherwise(F.lit(2000))))


def party_sections(text: Column) -> Column:
    """The seller's and the buyer's part: before and from the first word for a buyer; null without one."""
    low = F.lower(text)
    places = F.filter(F.array(*(F.instr(low, m) for m in BUYER_MARKS)), lambda i: i > 0)
    at = F.array_min(places)
    return F.struct(F.trim(F.substr(text, F.lit(1), at - 1)).alias("seller"), F.trim(F.substr(text, at)).alias("buyer"))


def garbage_name(name: Column) -> Column:
    """Whether a capture is part of an address, or has under four letters."""
    low = F.lower(name)
    return F.exists(F.array(*map(F.lit, NO_NAME)), lambda w: F.contains(low, w)) | (F.length(F.regexp_replace(name, r"[^\p{L}஀-௿]", "")) < 4)


def party_names(section: Column) -> Column:
    """Names after a title, without what addresses add."""
    names = F.transform(_all(section, TITLED), lambda n: F.regexp_replace(F.trim(n), r"[\s,;.\-]+$", ""))
    return F.array_distinct(F.filter(names, lambda n: (F.length(n) > 2) & ~garbage_name(n)))


def near_address(text: Column, at: Column, radius: int = 500) -> Column:
    """Whether an address stands within ``radius`` characters of a place (from 0)."""
    start = F.greatest(at - radius, F.lit(0))
    return F.substr(text, start + 1, at + radius - start).rlike(ADDRESS)


# places and surveys need match positions, which no built-in function gives for every match


def _tidy(place: str) -> str:
    return re.sub(r"[\s,;.:\-]+$", "", place.strip()).strip()


def _zone(text: str) -> str | None:
    head = re.search(SCHEDULE, text)
    if head is None:
        return None
    end = re.search(SCHEDULE_END, text[head.start() + 100 :])
    return text[head.start() : head.start() + (100 + end.start() if end else 2000)]


def _survey_places(text: str) -> list[tuple[int, str]]:
    """Start and number of every mention, Tamil ones first."""
    each = [(m.start(), re.sub(r"\s*/\s*", "/", m[1].strip())) for m in re.finditer(SURVEY_TAMIL, text)]
    return each + [(m.start(), re.sub(r"\s*/\s*", "/", m[1].strip())) for m in re.finditer("(?i)" + SURVEY_ENGLISH, text)]


def survey_numbers_text(text: str) -> list[str]:
    """The schedule's numbers; else all but those in recitals that no schedule or intro is near."""
    zone = _zone(text)
    if zone and (found := _survey_places(zone)):
        return list(dict.fromkeys(s for _, s in found))
    kept: dict[str, None] = {}
    for at, s in _survey_places(text):
        around = text[max(0, at - 300) : at + 100]
        if re.search(RECITAL, around) is None or re.search(SCHEDULE, around) or re.search(INTRO, around):
            kept[s] = None
    return list(kept)


def location_text(text: str) -> tuple[str, str, str]:
    """Village, taluk, district: from the schedule, near surveys, after an intro, then any line but addresses."""
    zone = _zone(text)

    def regions():
        """Texts in order of trust, and whether a match at a place of it counts."""
        if zone:
            yield zone, None
        for at, _ in _survey_places(text):
            start = max(0, at - 500)
            yield text[start : at + 500], lambda i, start=start: re.search(ADDRESS, text[max(0, start + i - 500) : start + i + 500]) is None
        intro = None if zone else re.search(INTRO, text)
        if intro:
            yield text[intro.start() : intro.start() + 1500], None
        lines = text.split("\n")
        marked = [any(w in line.lower() for w in ADDRESS_LINE) for line in lines]
        for i, line in enumerate(lines):
            if not any(marked[max(0, i - 3) : i + 1]):
                yield line, None

    found = ["", "", ""]
    for region, counts in regions():
        for k, patterns in enumerate((VILLAGE, TALUK, DISTRICT)):
            if not found[k]:
                hits = (re.search(p, region) for p in patterns)
                found[k] = next((_tidy(m[1]) for m in hits if m and (counts is None or counts(m.start()))), "")
        if all(found):
            break
    return found[0], found[1], found[2]


@pandas_udf(T.ArrayType(T.StringType()))
def survey_numbers(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else survey_numbers_text(t))


@pandas_udf(T.StructType([T.StructField(k, T.StringType()) for k in ("village", "taluk", "district")]))
def property_location(text: pd.Series) -> pd.DataFrame:
    rows = [location_text(t or "") for t in text]
    return pd.DataFrame([[x or None for x in r] for r in rows], columns=["village", "taluk", "district"], dtype="object")


# single fields


def registration_number(text: Column) -> Column:
    """full, short, office, book: a full number beats a short one."""
    full = [F.regexp_extract(text, REGISTRATION, i) for i in range(1, 5)]
    short = [F.regexp_extract(text, REGISTRATION_SHORT, i) for i in (1, 2)]
    return F.struct(
        F.when(full[2] != "", F.concat(F.lit("R/"), F.trim(full[0]), F.lit("/Book"), full[1], F.lit("/"), full[2], F.lit("/"), full[3])).alias("full"),
        F.when(full[2] != "", F.concat_ws("/", full[2], full[3])).when(short[0] != "", F.concat_ws("/", *short)).alias("short"),
        _none(F.trim(full[0])).alias("office"),
        F.when(full[1] != "", F.concat(F.lit("Book "), full[1])).alias("book"),
    )


def aadhaar_numbers(text: Column) -> Column:
    """Those that are named so; without any, bare ones in the first half."""
    keyed, bare = _squeezed(_all(text, AADHAAR)), _squeezed(_all(F.substr(text, F.lit(1), (F.length(text) / 2).cast("int")), AADHAAR_BARE))
    return F.when(F.size(keyed) > 0, keyed).otherwise(bare)


def land_classification(text: Column) -> Column:
    return F.coalesce(_first(schedule_zone(text), LAND), _first(text, LAND))


def stamp_vendor(text: Column) -> Column:
    head = F.substr(text, F.lit(1), F.lit(4000))
    clean = lambda p: _none(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract(head, p, 1), r"^\s+|\s+$", "")), r"[.,;:\-]+$", ""))
    return F.coalesce(clean(VENDOR), clean(VENDOR_LICENSED))


def stamp_serials(text: Column) -> Column:
    return _squeezed(_all(F.substr(text, F.lit(1), F.lit(8000)), SERIAL, 0))


def consideration_amount(text: Column) -> Column:
    """The largest amount of 1,000 or more."""
    return F.array_max(F.filter(F.transform(_all(text, AMOUNT), lambda a: number(F.replace(a, F.lit(","), F.lit("")))), lambda a: a >= 1000))


def stamp_value(text: Column) -> Column:
    return number(F.replace(F.regexp_extract(F.substr(text, F.lit(1), F.lit(2000)), STAMP_VALUE, 1), F.lit(","), F.lit("")))


def stamp_duty_stated(text: Column) -> Column:
    """The stamp duty that the text states, from 1,000 up."""
    paid = _whole(F.regexp_extract(text, STAMP_DUTY, 1))
    return F.when(paid >= 1000, paid)


def stamp_sheets(text: Column) -> Column:
    """Distinct sheets, and their value together: null without a denomination of 100 or more."""
    each = _whole(F.regexp_extract(F.substr(text, F.lit(1), F.lit(8000)), DENOMINATION, 1))
    n = F.size(stamp_serials(text))
    return F.struct(F.when(each >= 100, n).otherwise(0).alias("sheets"), F.when(each >= 100, F.greatest(n, F.lit(1)) * each).alias("total"))


def ownership_transfers(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TRANSFER))


def payment_mode(text: Column) -> Column:
    return _first(text, PAYMENT)


def encumbrance_free(text: Column) -> Column:
    return text.rlike(FREE)


def property_type(text: Column) -> Column:
    """Farm land or a home if its words beat both others; else trade if any of its words occurs."""
    low = F.lower(text)
    votes = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))
    farm, trade = votes(AGRICULTURAL), votes(COMMERCIAL)
    home = votes(RESIDENTIAL) + text.rlike(HOUSE_SITE).cast("int")
    return F.when((farm > home) & (farm > trade), "Agricultural").when((home > farm) & (home > trade), "Residential").when(trade > 0, "Commercial")


def previous_ownership(text: Column) -> Column:
    """Date and owner within 200 characters of an earlier deed; else the first date of the text."""
    at = F.regexp_instr(text, F.lit(EARLIER_DEED))
    start = F.greatest(at - 200, F.lit(1))
    around = F.when(at > 0, F.substr(text, start, at - start + 200 + F.length(F.regexp_extract(text, EARLIER_DEED, 0))))
    date = lambda t: _none(F.regexp_extract(t, EARLIER_DATE, 1))
    return F.struct(F.coalesce(date(around), date(text)).alias("date"), _none(F.trim(F.regexp_extract(around, EARLIER_OWNER, 1))).alias("owner"))


def deed_hints(text: Column) -> Column:
    """What a deed's text tells at once; null (or no elements) where it doesn't."""
    number_, sheets, sections, before, place = registration_number(text), stamp_sheets(text), party_sections(text), previous_ownership(text), property_location(text)
    stated = stamp_value(text)
    transfers = ownership_transfers(text)
    return F.struct(
        number_["full"].alias("registration_number"),
        number_["short"].alias("document_number"),
        number_["office"].alias("sro"),
        number_["book"].alias("book_number"),
        survey_numbers(text).alias("survey_numbers"),
        _squeezed(_all(text, PAN)).alias("pan_numbers"),
        aadhaar_numbers(text).alias("aadhaar_numbers"),
        land_classification(text).alias("land_classification"),
        stamp_vendor(text).alias("stamp_vendor"),
        stamp_serials(text).alias("stamp_serials"),
        F.when(sheets["sheets"] >= 2, sheets["sheets"]).alias("stamp_sheets"),
        F.when(sheets["sheets"] >= 2, sheets["total"]).alias("total_stamp_value"),
        F.coalesce(stated, F.when(sheets["sheets"] < 2, sheets["total"]).cast("double")).alias("stamp_value"),
        stamp_duty_stated(text).alias("stamp_duty_stated"),
        consideration_amount(text).alias("consideration_amount"),
        place["village"].alias("village"),
        place["taluk"].alias("taluk"),
        place["district"].alias("district"),
        sections["seller"].alias("seller_section"),
        sections["buyer"].alias("buyer_section"),
        party_names(sections["seller"]).alias("seller_names"),
        party_names(sections["buyer"]).alias("buyer_names"),
        before["date"].alias("previous_date"),
        before["owner"].alias("previous_owner"),
        F.when(transfers > 0, transfers).alias("ownership_transfers"),
        payment_mode(text).alias("payment_mode"),
        encumbrance_free(text).alias("encumbrance_free"),
        property_type(text).alias("property_type"),
    )


#: What a prompt calls each hint, and what it must not be taken for.
LABELS = {
    "registration_number": "Registration number (not a survey number)",
    "sro": "Registrar's office",
    "survey_numbers": "Survey numbers of the property",
    "village": "Village of the property (not of a person)",
    "taluk": "Taluk",
    "district": "District",
    "property_type": "Property type",
    "consideration_amount": "Consideration",
    "pan_numbers": "PAN",
    "aadhaar_numbers": "Aadhaar",
    "land_classification": "Land classification",
    "seller_names": "Sellers (named before the buyer's part)",
    "buyer_names": "Buyers (named in the buyer's part)",
    "stamp_duty_stated": "Stamp duty as stated",
    "stamp_sheets": "Stamp sheets",
    "total_stamp_value": "Value of all stamp sheets",
    "stamp_value": "Value of a stamp sheet",
    "stamp_serials": "Stamp serial numbers",
    "stamp_vendor": "Stamp vendor",
    "book_number": "Book",
    "previous_date": "Date of the earlier deed",
    "previous_owner": "Earlier owner",
    "ownership_transfers": "Earlier transfers mentioned",
    "payment_mode": "Payment",
}


def hint_lines(hints: Column) -> Column:
    """The hints that are there as lines of text; the empty text if none is."""
    lists = ("survey_numbers", "pan_numbers", "aadhaar_numbers", "seller_names", "buyer_names", "stamp_serials")
    shown = lambda k: _none(F.array_join(hints[k], ", ")) if k in lists else F.format_string("%.0f", hints[k].cast("double")) if k in ("consideration_amount", "stamp_value") else hints[k].cast("string")
    lines = [F.when(shown(k).isNotNull() & hints[k].isNotNull(), F.concat(F.lit(f"{label}: "), shown(k))) for k, label in LABELS.items()]
    return F.concat_ws("\n", *lines, F.when(hints["encumbrance_free"], "Declared free of encumbrances"))


def fmb_header(text: Column) -> Column:
    """Survey, village, taluk, district and area from the first 800 characters of a sketch."""
    head = F.substr(text, F.lit(1), F.lit(800))
    get = lambda p: _none(F.trim(F.regexp_extract(head, p, 1)))
    return F.struct(
        get(r"(?i)(?:survey\s*no\.?|S\.?\s*F\.?\s*No\.?|புல\s*எண்)\s*[:.]?\s*([0-9]+[A-Za-z0-9/]*)").alias("survey_number"),
        *(get(rf"(?iu)(?:{names})\s*[:.]?\s*([\p{{L}}\p{{M}}]+(?: [\p{{L}}\p{{M}}]+)?)").alias(k) for k, names in (("village", "village|கிராமம்"), ("taluk", "taluk|வட்டம்"), ("district", "district|மாவட்டம்"))),
        get(r"(?i)(?:area|extent|பரப்பு)\s*[:.]?\s*([0-9.]+\s*[A-Za-z.]*)").alias("area"),
    )
