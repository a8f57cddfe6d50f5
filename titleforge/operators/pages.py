"""Page text: quality, cleaning, choice between sources, and splitting of HTML."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.tamil import fix_orphans, garbled, has_tamil

#: Thresholds of page quality.
MIN_CHARS, MAX_CID_RATIO, MIN_WORDS = 50, 0.15, 10
#: How much a way of extraction is trusted, less is better.
METHOD_RANK = {"sarvam": 0, "ocr_fallback": 1, "ocr": 1, "pdfplumber": 2, "failed": 3}
CID = r"\(cid:[0-9]+\)"


def page_quality(text: Column) -> Column:
    """char_count, word_count, cid_count, cid_ratio, quality and reason of a page."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(F.regexp_replace(t, r"^\s+|\s+$", ""))
    words = F.regexp_count(t, F.lit(r"\S+"))
    cids = F.regexp_extract_all(t, F.lit(CID), F.lit(0))
    ratio = F.aggregate(cids, F.lit(0), lambda acc, m: acc + F.length(m)) / F.greatest(chars, F.lit(1))
    reason = (
        F.when(chars < MIN_CHARS, F.format_string("too few characters (%d)", chars))
        .when(ratio > MAX_CID_RATIO, F.format_string("high (cid:) ratio (%.0f%%)", ratio * 100))
        .when(words < MIN_WORDS, F.format_string("too few words (%d)", words))
    )
    return F.struct(
        chars.alias("char_count"),
        words.alias("word_count"),
        F.size(cids).alias("cid_count"),
        F.round(ratio, 3).alias("cid_ratio"),
        F.when(reason.isNull(), "HIGH").otherwise("LOW").alias("quality"),
        reason.alias("reason"),
    )


def light_quality(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    enough = (F.length(F.trim(t)) >= MIN_CHARS) & (F.regexp_count(t, F.lit(r"\S+")) >= MIN_WORDS)
    return F.when(enough, "HIGH").otherwise("LOW")


def rollup(quality: Column) -> Column:
    """Aggregate of page qualities: LOW, HIGH, MIXED, or EMPTY without pages."""
    return (
        F.when(F.count(quality) == 0, "EMPTY").when(F.bool_and(quality == "LOW"), "LOW").when(F.bool_and(quality == "HIGH"), "HIGH").otherwise("MIXED")
    )


def needs_ocr(quality: Column, pages: Column | None = None) -> Column:
    """Which documents go to the first engine; with page counts, to the second."""
    if pages is None:
        return quality.isin("LOW", "EMPTY", "MIXED")
    return quality.isin("LOW", "EMPTY") | ((quality == "MIXED") & (pages == 0))


def take_ocr(old: Column, new: Column, cid_reason: Column, all_low: bool = False) -> Column:
    """Whether recognised text replaces extracted text."""
    n_old, n_new = F.length(F.trim(F.coalesce(old, F.lit("")))), F.length(F.trim(F.coalesce(new, F.lit(""))))
    factor = 1.2 if all_low else 1.5
    better = (page_quality(new)["quality"] == "HIGH") & (page_quality(old)["quality"] == "LOW")
    return F.when(cid_reason, n_new > MIN_CHARS).otherwise((n_new > n_old * factor) | better)


def merge_pages(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge by page: keys, text, quality, tables, from_second.

    The second source wins if it alone is good, is much longer, or has sound
    Tamil text where the first is shorter or damaged; tables stay those of the first.
    """
    a, b = first.alias("a"), second.alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    ta, tb = F.col("a.text"), F.col("b.text")
    qa, qb = page_quality(ta), page_quality(tb)
    sound = lambda t: ~garbled(t)["is_garbled"]
    wins = (
        F.when(tb.isNull(), F.lit(False))
        .when(ta.isNull(), F.lit(True))
        .when((qb["quality"] == "HIGH") & (qa["quality"] == "LOW"), F.lit(True))
        .when((qb["char_count"] > qa["char_count"] * 1.3) & (qb["char_count"] > 50), F.lit(True))
        .when(has_tamil(tb) & (qb["char_count"] >= qa["char_count"] * 0.8) & sound(tb), F.lit(True))
        .when(has_tamil(ta) & garbled(ta)["is_garbled"] & (qb["char_count"] > 30) & sound(tb), F.lit(True))
        .otherwise(F.lit(False))
    )
    tables = F.col("a.tables") if "tables" in first.columns else F.lit(None).cast("string")
    return joined.select(
        *(F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys),
        F.when(wins, tb).otherwise(ta).alias("text"),
        F.when(wins, qb["quality"]).otherwise(qa["quality"]).alias("quality"),
        tables.alias("tables"),
        wins.alias("from_second"),
    )


def best_pages(pages: DataFrame, by: list[str], n: int, page: str = "page_number", quality: str = "quality", method: str = "extraction_method") -> DataFrame:
    """The ``n`` best pages of each document, by quality, method and page."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in METHOD_RANK.items() for x in kv)), F.col(method)), F.lit(2))
    order = Window.partitionBy(*by).orderBy((F.col(quality) != "HIGH").cast("int"), rank, page)
    return pages.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank").sortWithinPartitions(*by, page)


# cleaning


def strip_cid(text: Column) -> Column:
    t = F.regexp_replace(text, CID, "")
    t = F.regexp_replace(t, r"[^\S\n]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\n\s*\n", "\n"), r"^\s+|\s+$", "")


def collapse_repetitions(text: Column) -> Column:
    """Three or more copies of a short token in a row become three."""
    return F.regexp_replace(text, r"(?U)((?:\([^)]{1,10}\)|\S{1,20})(?:\s+|))\1{2,}", "$1$1$1")


def _capped(text: str, most: int, least_words: int) -> str:
    words = re.findall(r"[^ \t\n\x0b\f\r]+", text)
    if len(words) < least_words:
        return " ".join(words)
    seen: Counter = Counter()
    out = []
    for w in words:
        seen[w] += 1
        if seen[w] <= most or len(w) < 3:
            out.append(w)
    return " ".join(out)


def cap_tokens(text: Column, most: int = 6, least_words: int = 30) -> Column:
    """``text`` with at most ``most`` of each token of three letters or more. Counting inside a
    row has no linear form among the built-in functions; this needs no exchange."""

    @pandas_udf(T.StringType())
    def capped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _capped(t, most, least_words))

    return capped(text)


def repeats(text: Column) -> Column:
    """Whether a text of 50 characters or more is a runaway model's: a short token ten times
    in a row, or a phrase of 20 to 80 characters four times."""
    short = r"""(["']?[^"',;\n]{1,30}["']?(?:\s*[,;]?\s*))\1{9,}"""
    return (F.length(text) >= 50) & (text.rlike(short) | text.rlike(r"(.{20,80})\1{3,}"))


def normalize_ocr(text: Column) -> Column:
    """Digits, vowel signs, survey prefixes, date separators, blank lines and repeated marks."""
    from ..functions.scalars import ascii_digits

    # orphan signs are rare: only texts that have one go through Python
    t = ascii_digits(text)
    t = F.coalesce(F.when(t.rlike("(?<![க-ஹா-ௌ])[ா-ௌ]"), fix_orphans(t)), t)
    for letter in "SRTON":
        tail = "F" if letter == "S" else "S"
        t = F.regexp_replace(t, rf"(?i)\b{letter}\.?\s*{tail}\.?\s*No\.?\s*:?\s*", f"{letter}.{tail}.No. ")
    t = F.regexp_replace(t, r"([0-9]{1,2})\s*[./]\s*([0-9]{1,2})\s*[./]\s*([0-9]{4})", "$1-$2-$3")
    t = F.regexp_replace(t, r"\n{4,}", "\n\n")
    return F.regexp_replace(t, r"(\([A-Z]\))\s*(?:\([A-Z]\)\s*){2,}", "$1")


def html_text(html: Column) -> Column:
    """Text of a page: scripts and styles go, tags become line breaks."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", "")
    t = F.regexp_replace(t, r"<[^>]+>", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n")


def html_pages(html: Column) -> Column:
    """Pages of an HTML result: cut at page marks, rules or page breaks."""
    marks = r"(?i)<[a-z]+[^>]*(?:data-page-number=|class=\"[^\"]*\bpage(?:-body-container)?\b[^\"]*\"|page-break-(?:before|after))[^>]*>|<hr[^>]*>"
    parts = F.transform(F.split(html, marks), lambda p: F.regexp_replace(html_text(p), r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")
