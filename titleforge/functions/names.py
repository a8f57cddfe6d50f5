"""Names of persons and places: normal forms and likeness."""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .tamil import fix_orphans_text, has_tamil_text, transliterate_text

#: Titles and relation marks that are cut off the front, in this order.
FRONT = ("mr.", "mrs.", "ms.", "sri.", "smt.", "thiru.", "thirumathi.", "selvi.", "selvan.", "dr.", "prof.", "s/o", "d/o", "w/o", "son of", "daughter of", "wife of")
#: Titles, relations in English, relations in Tamil (the first: wife, stands after the husband).
TITLE = r"^(mr\.?|mrs\.?|ms\.?|dr\.?|sri\.?|smt\.?|thiru\.?|thirumathi\.?|selvi\.?|shri\.?|shr\.?|kumari\.?|m/s\.?|messrs\.?)\s*"
RELATION = r"\b(s/o|d/o|w/o|son of|daughter of|wife of|husband of|c/o|care of)\b"
WIFE, TAMIL_RELATION = "மனைவி", r"(மனைவி|மகன்|மகள்|கணவர்)\s+"
PARTY_SPLIT = r"(?iu)\s*(?:,\s*(?:and|&|மற்றும்)\s+|,\s*|\s+(?:and|&|மற்றும்)\s+)\s*"
#: Spellings of village endings, and the one that stands for them, in the order of trial.
ENDINGS = (
    ("pet", "pettai"), ("petai", "pettai"), ("pettai", "pettai"), ("pete", "pettai"),
    ("puram", "puram"), ("pur", "puram"), ("pore", "puram"),
    ("nagar", "nagar"), ("nagaram", "nagar"), ("nager", "nagar"),
    ("ur", "ur"), ("oor", "ur"), ("uru", "ur"), ("ooru", "ur"),
    ("palayam", "palayam"), ("paliam", "palayam"),
    ("kuppam", "kuppam"), ("kupam", "kuppam"),
    ("mangalam", "mangalam"), ("mangalm", "mangalam"),
)
#: Sounds that spellings confuse, in the order of replacement.
SOUNDS = (("ch", "s"), ("th", "t"), ("zh", "l"), ("sh", "s"), ("aa", "a"), ("oo", "o"), ("ee", "e"), ("ii", "i"), ("uu", "u"), ("ai", "a"), ("au", "a"))

_INITIAL = r"\b[a-z]\.\s*"


def normalize_name(name: Column) -> Column:
    s = F.lower(F.trim(name))
    for front in FRONT:
        # one mention of s each: nested conditions would triple the expression every time
        s = F.regexp_replace(s, "^" + front.replace(".", r"\.") + r"\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, _INITIAL, ""), r"\s+", " "))


def split_parties(names: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(names), PARTY_SPLIT), lambda p: F.trim(p)), lambda p: p != "")


def name_parts(name: Column) -> Column:
    """Given name and patronymic, around a relation mark."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    s = F.trim(F.regexp_replace(F.lower(F.trim(name)), TITLE, ""))
    tamil = F.regexp_extract(s, TAMIL_RELATION, 1)
    before, after = squeeze(F.regexp_extract(s, r"(?s)^(.*?)" + TAMIL_RELATION, 1)), squeeze(F.regexp_extract(s, r"(?s)^.*?" + TAMIL_RELATION + r"(.*)$", 2))
    cut = F.split(s, RELATION, 2)
    wife = tamil == WIFE
    given = F.when(wife, F.when(after != "", after).otherwise(before)).when(tamil != "", before).otherwise(squeeze(F.get(cut, 0)))
    father = F.when(wife, F.when(after != "", before).otherwise("")).when(tamil != "", after).otherwise(F.coalesce(squeeze(F.get(cut, 1)), F.lit("")))
    return F.struct(F.coalesce(given, F.lit("")).alias("given"), F.coalesce(father, F.lit("")).alias("patronymic"))


def normalize_village(name: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(name)), r"\s*\(\s*(?:r|rural|u|urban|town|village|municipality|corp)\s*\)\s*", " ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[,.\-'\"()]", ""), r"\s+", " "))
    ending = F.coalesce(*(F.when(s.endswith(a) & (F.length(s) > len(a)), F.concat(F.substr(s, F.lit(1), F.length(s) - len(a)), F.lit(b))) for a, b in ENDINGS), s)
    return F.coalesce(ending, F.lit(""))


def phonetic(s: Column) -> Column:
    for a, b in SOUNDS:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def village_match(a: Column, b: Column, a_latin: Column | None = None, b_latin: Column | None = None) -> Column:
    """exact, fuzzy, cross_script or mismatch; ``_latin``: transliterations, if there are any."""
    na, nb = normalize_village(a), normalize_village(b)
    match = F.when((na == "") | (nb == ""), "mismatch").when(na == nb, "exact").when((F.levenshtein(na, nb) <= 2) | na.contains(nb) | nb.contains(na), "fuzzy")
    if a_latin is not None and b_latin is not None:
        ta, tb = normalize_village(a_latin), normalize_village(b_latin)
        pa, pb = phonetic(ta), phonetic(tb)
        near = F.levenshtein(pa, pb) <= F.greatest(F.lit(5), F.floor(F.least(F.length(pa), F.length(pb)) / 2))
        tamil = a.rlike("[஀-௿]") | b.rlike("[஀-௿]")
        match = match.when(tamil & (ta != "") & (tb != "") & ((ta == tb) | (pa == pb) | near | ta.contains(tb) | tb.contains(ta)), "cross_script")
    return match.otherwise("mismatch")


# pairs of places by the million: the expression above with two spellings each is too large to compile


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _village(name: str) -> str:
    s = re.sub(r"\s*\(\s*(?:r|rural|u|urban|town|village|municipality|corp)\s*\)\s*", " ", name.strip().lower())
    s = re.sub(r"\s+", " ", re.sub(r"[,.\-'\"()]", "", s)).strip()
    return next((s[: -len(end)] + put for end, put in ENDINGS if s.endswith(end) and len(s) > len(end)), s)


def _sounds(s: str) -> str:
    for a, b in SOUNDS:
        s = s.replace(a, b)
    return s


def village_match_text(a: str | None, b: str | None) -> str:
    """exact, fuzzy, cross_script or mismatch of two places' names, Tamil or Latin."""
    na, nb = _village(a or ""), _village(b or "")
    if not na or not nb:
        return "mismatch"
    if na == nb:
        return "exact"
    if na in nb or nb in na or _edits(na, nb) <= 2:
        return "fuzzy"
    if has_tamil_text(a) or has_tamil_text(b):
        la, lb = (_village(transliterate_text(x)) if has_tamil_text(x) else n for x, n in ((a, na), (b, nb)))
        pa, pb = _sounds(la), _sounds(lb)
        if la and lb and (pa == pb or la in lb or lb in la or _edits(pa, pb) <= max(5, min(len(pa), len(pb)) // 2)):
            return "cross_script"
    return "mismatch"


def _pairs_once(f: Callable[[str | None, str | None], object], a: pd.Series, b: pd.Series) -> list:
    """``f`` of each pair; pairs that come again in a batch are worked out once."""
    pairs = list(zip(a, b))
    known = {p: f(*p) for p in set(pairs)}
    return [known[p] for p in pairs]


@pandas_udf(T.StringType())
def village_pairs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_pairs_once(village_match_text, a, b), dtype="object")


# likeness: the ratio of matching blocks has no SQL form


def _given_and_father(name: str) -> tuple[str, str]:
    s = re.sub(TITLE, "", name.strip().lower()).strip()
    m = re.search(TAMIL_RELATION, s)
    tidy = lambda x: " ".join(x.split())
    if m:
        before, after = tidy(s[: m.start()]), tidy(s[m.end() :])
        if m[1] == WIFE:
            return (after, before) if after else (before, "")
        return before, after
    parts = re.split(RELATION, s, maxsplit=1)
    return tidy(parts[0]), tidy(parts[2]) if len(parts) > 2 else ""


def base_similarity(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    a, b = re.sub(_INITIAL, "", a).strip(), re.sub(_INITIAL, "", b).strip()
    a, b = (fix_orphans_text(x) if has_tamil_text(x) else x for x in (a, b))
    if a.replace(" ", "") == b.replace(" ", ""):
        return 1.0
    if has_tamil_text(a) or has_tamil_text(b):
        la, lb = compare_form(a), compare_form(b)
        if la and lb:
            a, b = la, lb
            if a.replace(" ", "") == b.replace(" ", ""):
                return 1.0
    ta, tb = set(a.split()), set(b.split())
    jaccard = len(ta & tb) / len(ta | tb) if ta and tb else 0.0
    score = 0.4 * jaccard + 0.6 * SequenceMatcher(None, a, b).ratio()
    if len(ta) != len(tb):
        score = max(score, SequenceMatcher(None, a.replace(" ", ""), b.replace(" ", "")).ratio())
    return score


def compare_form(s: str) -> str:
    """For comparing across scripts: Latin letters, without initials."""
    return re.sub(_INITIAL, "", transliterate_text(s) if has_tamil_text(s) else s).strip()


def similarity(a: str | None, b: str | None) -> float:
    """Likeness of two names, 0 to 1; patronymics count 0.4 if both have one."""
    (g1, p1), (g2, p2) = _given_and_father(a or ""), _given_and_father(b or "")
    if not g1 or not g2:
        return 0.0
    given = base_similarity(g1, g2)
    if p1 and p2:
        return 0.6 * given + 0.4 * base_similarity(p1, p2)
    return given * 0.85 if p1 or p2 else given


@pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_pairs_once(similarity, a, b), dtype="float64")
