"""Cutting texts: by characters, pages, boundaries and budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Chunk size, overlap, hits and diversity by kind of document.
DEFAULTS = {"chunk_size": 1000, "overlap": 200, "top_k": 5, "mmr_lambda": 0.6}
PROFILES = {
    "EC": {"chunk_size": 800, "top_k": 6, "mmr_lambda": 0.5},
    "SALE_DEED": {"chunk_size": 1500, "overlap": 300},
    "PATTA": {"chunk_size": 600, "overlap": 100, "top_k": 3},
    "A_REGISTER": {"chunk_size": 600, "overlap": 100, "top_k": 3},
}
LEAST = 50


def profile(kind: str = "") -> dict:
    return {**DEFAULTS, **PROFILES.get(kind, {})}


def char_chunks(text: Column, size: int, overlap: int) -> Column:
    """Pieces of ``size`` characters, each ``overlap`` into the one before; short ones go."""
    step = size - overlap
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(starts, lambda s, i: F.struct(i.alias("chunk_index"), F.substr(text, s + 1, F.lit(size)).alias("chunk")))
    return F.filter(parts, lambda p: F.length(F.trim(p["chunk"])) >= LEAST)


def page_groups(pages: DataFrame, by: list[str], page: str, text: str, n: int) -> DataFrame:
    """Groups of ``n`` pages, texts joined in page order."""
    group = F.floor((F.col(page) - 1) / n)
    return (
        pages.groupBy(*by, group.cast("int").alias("chunk_index"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, text))), lambda p: p[text]), "\n").alias("chunk"), F.count("*").alias("n_pages"))
    )


def segments(rows: DataFrame, key: str, text: str, boundary: str) -> DataFrame:
    """Text between boundaries: key, segment (from 0), offset, body. What stands before the first counts."""
    gaps = F.split(F.col(text), f"(?={boundary})")
    each = rows.select(key, F.posexplode(gaps).alias("segment", "body"))
    before = Window.partitionBy(key).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("offset", F.coalesce(F.sum(F.length("body")).over(before), F.lit(0)))


def with_tail(rows: DataFrame, by: list[str], order: str, text: str, n: int = 500) -> DataFrame:
    """Each chunk led by the last ``n`` characters of the one before."""
    prior = F.lag(text).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn(text, F.when(prior.isNull(), F.col(text)).otherwise(F.concat(F.right(prior, F.lit(n)), F.lit("\n"), F.col(text))))


def offset_page(marks: DataFrame, pages: DataFrame, key: str, offset: str, start: str, page: str) -> DataFrame:
    """The page that each offset falls on: the last page that starts at or before it."""
    joined = marks.join(pages, key).where(F.col(start) <= F.col(offset))
    return joined.groupBy(*marks.columns).agg(F.max_by(page, start).alias(page))


def pack(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """A bin number for each row: rows fill a bin in order while it stays within the budget.

    A running sum that starts again has no window form; each key is one document.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", bin int"

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        bins, used, at = [], 0, 0
        for n in pdf[size]:
            if used and used + n > budget:
                at, used = at + 1, 0
            used += n
            bins.append(at)
        return pdf.assign(bin=pd.Series(bins, index=pdf.index, dtype="int32"))

    return rows.groupBy(key).applyInPandas(fill, schema)


def sections(rows: DataFrame, by: list[str], order: str, line: str, marker: str) -> DataFrame:
    """Lines gathered into sections that start where ``marker`` matches."""
    at = Window.partitionBy(*by).orderBy(order)
    cut = rows.withColumn("section", F.sum(F.col(line).rlike(marker).cast("int")).over(at))
    return cut.groupBy(*by, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda s: s[line]), "\n").alias("body"))


#: Headings that begin a section of a deed.
SECTION_MARKS = (
    "schedule", "property schedule", "schedule of property",
    "boundaries", "boundary description",
    "consideration", "sale consideration",
    "witness", "witnesses", "attestation",
    "conditions", "special conditions", "covenants",
    "recitals", "whereas",
    "encumbrances", "free from encumbrance",
    "அட்டவணை",
    "எல்லை",
    "விலை",
    "சாட்சிகள்",
)
#: Pages and characters of a chunk at most.
MOST_PAGES, MOST_CHARS = 20, 120_000


def _joined(rows: pd.DataFrame, key: str, order: str, text: str, spans: list[tuple[int, int]], glue: str) -> pd.DataFrame:
    """Rows first to last of each span as one text."""
    parts = [(rows[key].iloc[0], i, int(rows[order].iloc[a]), int(rows[order].iloc[b]), glue.join(rows[text].iloc[a : b + 1])) for i, (a, b) in enumerate(spans)]
    return pd.DataFrame(parts, columns=[key, "chunk_index", "first", "last", "chunk"])


def packed_with_overlap(rows: DataFrame, key: str, order: str, text: str, budget: int = MOST_CHARS, most: int = MOST_PAGES, glue: str = "") -> DataFrame:
    """Segments (or pages) gathered while they stay within the budget; each chunk begins with the
    last segment of the one before. key, chunk_index, first, last, chunk. One group per document."""
    kind = rows.schema[key].dataType.simpleString()

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        sizes = pdf[text].str.len().tolist()
        spans, start, used = [], 0, 0
        for i, n in enumerate(sizes):
            if i > start and (used + n > budget or i - start >= most):
                spans.append((start, i - 1))
                start, used = i - 1, sizes[i - 1]
            used += n
        return _joined(pdf, key, order, text, [*spans, (start, len(sizes) - 1)], glue)

    return rows.select(key, order, text).groupBy(key).applyInPandas(fill, f"{key} {kind}, chunk_index int, first int, last int, chunk string")


def section_chunks(pages: DataFrame, key: str, page: str, text: str, most: int = MOST_PAGES) -> DataFrame:
    """A deed's pages cut where a page names a section; a section of one page joins the one before
    while that has room. Without two such pages, every ``most`` pages. One group per document."""
    kind = pages.schema[key].dataType.simpleString()

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(page)
        low = pdf[text].str.lower()
        marked = [i for i, t in enumerate(low) if any(m in t for m in SECTION_MARKS)]
        starts = sorted({0, *marked}) if len(marked) >= 2 and len(pdf) > 0 else [0]
        spans = [(a, min(a + most, b) - 1) for s, b in zip(starts, [*starts[1:], len(pdf)]) for a in range(s, b, most)]
        merged: list[tuple[int, int]] = []
        for a, b in spans:
            if merged and a == b and merged[-1][1] - merged[-1][0] + 1 < most:
                merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
        return _joined(pdf, key, page, text, merged, "\n\n")

    return pages.select(key, page, text).groupBy(key).applyInPandas(cut, f"{key} {kind}, chunk_index int, first int, last int, chunk string")


def prior_summary(record: Column) -> Column:
    """What a chunk's record (a variant) told, for the reader of the next one."""
    from ..functions.variants import each, filled, get, text_of

    names = lambda k: F.when(F.size(each(record, k)) > 0, F.array_join(F.transform(F.slice(each(record, k), 1, 3), text_of), ", "))
    fields = (
        ("Doc No", filled(get(record, "document_number"))), ("Reg Date", filled(get(record, "registration_date"))), ("SRO", filled(get(record, "sro"))), ("Sellers", names("seller")), ("Buyers", names("buyer")),
        ("Survey No", filled(get(record, "property.survey_number"))), ("Extent", filled(get(record, "property.extent"))), ("Village", filled(get(record, "property.village"))), ("Consideration", filled(get(record, "financials.consideration_amount"))),
    )
    return F.concat_ws("\n", *(F.concat(F.lit(f"{label}: "), value) for label, value in fields))
