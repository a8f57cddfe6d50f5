"""Survey numbers: normal forms, parts, and whether two mean the same parcel."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .scalars import ascii_digits

#: Tamil letters of subdivisions, longest first.
SUBDIVISIONS = (("எப்", "f"), ("எச்", "h"), ("பி", "b"), ("சி", "c"), ("டி", "d"), ("ஜி", "g"), ("ஏ", "a"), ("ஈ", "e"))

#: What may stand before a survey number.
PREFIX = (
    r"(?iu)^(?:s\.?f\.?\s*no\.?|r\.?s\.?\s*no\.?|t\.?s\.?\s*no\.?|o\.?s\.?\s*no\.?|n\.?s\.?\s*no\.?|s\.?no\.?"
    r"|survey\s*no\.?|sy\.?\s*no\.?|புல\s*எண்\.?|நில\s*எண்\.?)\s*:?\s*"
)
#: Kinds of survey that a prefix names.
KIND = r"(?i)^(s\.?f|r\.?s|t\.?s|o\.?s|n\.?s)\.?\s*no\.?"

VALID = r"^[0-9]+[A-Za-z]?([/-][0-9]+[A-Za-z]*[0-9]*)*$"


def survey_kind(text: Column) -> Column:
    return F.upper(F.replace(F.regexp_extract(F.trim(text), KIND, 1), F.lit("."), F.lit("")))


def normalize_survey(text: Column) -> Column:
    s = ascii_digits(F.lower(F.trim(text)))
    for tamil, letter in SUBDIVISIONS:
        s = F.replace(s, F.lit(tamil), F.lit(letter))
    s = F.replace(F.regexp_replace(s, PREFIX, ""), F.lit("-"), F.lit("/"))
    return F.coalesce(F.regexp_replace(s, r"\s+", ""), F.lit(""))


def survey_parts(normal: Column) -> Column:
    """A normal form's base, sub and subsub: 45/2b2 is 45, 2, b2."""
    parts = F.split(normal, "/")
    second, third = F.coalesce(F.get(parts, 1), F.lit("")), F.get(parts, 2)
    pattern = r"^([0-9]+)([a-z]\w*)?$"
    mixed = second.rlike(pattern)
    return F.struct(
        F.get(parts, 0).alias("base"),
        F.when(mixed, F.regexp_extract(second, pattern, 1)).otherwise(second).alias("sub"),
        F.coalesce(third, F.when(mixed, F.regexp_extract(second, pattern, 2)), F.lit("")).alias("subsub"),
    )


def _digit_changed(a: Column, b: Column) -> Column:
    """Of two texts one edit apart: whether the edit is about digits."""
    longer = F.when(F.length(a) >= F.length(b), a).otherwise(b)
    shorter = F.when(F.length(a) >= F.length(b), b).otherwise(a)
    at = F.sequence(F.lit(1), F.length(longer))
    differs = F.filter(at, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    changed = F.substr(a, F.get(differs, 0), F.lit(1)).rlike("[0-9]") & F.substr(b, F.get(differs, 0), F.lit(1)).rlike("[0-9]")
    extra = F.filter(at, lambda i: F.concat(F.substr(longer, F.lit(1), i - 1), F.substr(longer, i + 1, F.length(longer))) == shorter)
    return F.coalesce(F.when(F.length(a) == F.length(b), changed).otherwise(F.substr(longer, F.get(extra, 0), F.lit(1)).rlike("[0-9]")), F.lit(False))


def survey_match(a: Column, b: Column) -> Column:
    """exact, subdivision, ocr_fuzzy or mismatch of two survey numbers."""
    return match_normal(normalize_survey(a), normalize_survey(b))


def match_normal(na: Column, nb: Column) -> Column:
    """The same for normal forms; cheaper to plan where these are columns already."""
    pa, pb = survey_parts(na), survey_parts(nb)
    has = lambda c: c != ""
    same_base = (pa["base"] == pb["base"]) & has(pa["base"])
    same_sub = (pa["sub"] == pb["sub"]) & has(pa["sub"])
    close = (F.length(na) >= 5) & (F.length(nb) >= 5) & (F.levenshtein(na, nb) <= 1)
    return (
        F.when(~has(na) | ~has(nb), "mismatch")
        .when(na == nb, "exact")
        .when(same_base & (has(pa["sub"]) != has(pb["sub"])), "subdivision")
        .when(same_base & same_sub & (has(pa["subsub"]) != has(pb["subsub"])), "subdivision")
        .when(same_base & same_sub & has(pa["subsub"]) & has(pb["subsub"]) & (pa["subsub"] != pb["subsub"]), "mismatch")
        .when(same_base & has(pa["sub"]) & has(pb["sub"]) & (pa["sub"] != pb["sub"]), "mismatch")
        .when(close & ~_digit_changed(na, nb), "ocr_fuzzy")
        .otherwise("mismatch")
    )


def split_surveys(text: Column) -> Column:
    """The survey numbers of a list; soil codes (like 4-3) are left out."""
    parts = F.filter(F.transform(F.split(ascii_digits(text), "[,;]+"), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"^[0-9]{1,2}-[0-9]{1,2}$"))
    leading = r"^([0-9]+[a-zA-Z]?(?:[/\-][0-9]+[a-zA-Z]?[0-9]*)*)"
    inside = r"\b([0-9]{2,}[a-zA-Z]?(?:[/\-][0-9]+[a-zA-Z]?[0-9]*)*)"

    def numbers(p: Column) -> Column:
        found = F.regexp_extract_all(p, F.lit(inside), F.lit(1))
        return F.when(p.rlike(leading), F.array(F.regexp_extract(p, leading, 1))).when(p.rlike(PREFIX), F.array(p)).when(F.size(found) > 0, found).otherwise(F.array(p))

    return F.flatten(F.transform(parts, numbers))


def any_survey_match(a: Column, b: Column) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: survey_match(x, y) != "mismatch"))


def match_text(a: str | None, b: str | None) -> str:
    """The same comparison of two normal forms in plain Python."""

    def parts(s: str) -> tuple[str, str, str]:
        p = s.split("/")
        second = p[1] if len(p) > 1 else ""
        m = re.fullmatch(r"([0-9]+)([a-z]\w*)?", second)
        return p[0], m[1] if m else second, p[2] if len(p) > 2 else (m[2] or "") if m else ""

    if not a or not b:
        return "mismatch"
    if a == b:
        return "exact"
    (base_a, sub_a, last_a), (base_b, sub_b, last_b) = parts(a), parts(b)
    if base_a and base_a == base_b:
        if bool(sub_a) != bool(sub_b) or (sub_a and sub_a == sub_b and bool(last_a) != bool(last_b)):
            return "subdivision"
        if sub_a != sub_b or last_a != last_b:
            return "mismatch"
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return "mismatch"
    if len(a) == len(b):
        odd = [(x, y) for x, y in zip(a, b) if x != y]
        return "ocr_fuzzy" if len(odd) == 1 and not (odd[0][0].isdigit() and odd[0][1].isdigit()) else "mismatch"
    long, short = (a, b) if len(a) > len(b) else (b, a)
    extra = [c for i, c in enumerate(long) if long[:i] + long[i + 1 :] == short]
    return "ocr_fuzzy" if extra and not extra[0].isdigit() else "mismatch"


@pandas_udf(T.StringType())
def match_pairs(a: pd.Series, b: pd.Series) -> pd.Series:
    """For pairs by the million: the expression takes longer to plan than this to run."""
    return pd.Series([match_text(x, y) for x, y in zip(a, b)], dtype="object")


@pandas_udf(T.StringType())
def match_lists(a: pd.Series, b: pd.Series) -> pd.Series:
    """How the first two normal forms of two lists that match do so; mismatch if none does."""
    return pd.Series([next((m for x in u for y in v if (m := match_text(x, y)) != "mismatch"), "mismatch") for u, v in zip(a, b)], dtype="object")


def any_survey_kind(a: Column | str, b: Column | str) -> Column:
    """exact, subdivision, ocr_fuzzy or mismatch of two lists of survey numbers."""
    return match_lists(F.transform(a, normalize_survey), F.transform(b, normalize_survey))
