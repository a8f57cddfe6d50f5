"""Document kinds by keywords, and which pages and checks they allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks a document of each kind.
KEYWORDS = (
    ("EC", r"சுமையின்மை\s*சான்றிதழ்|Encumbrance\s+Certificate|Certificate\s+of\s+Encumbrance|வில்லங்கச்?\s*சான்று|வில்லங்க\s*சான்றிதழ்|EC\s*(?:No|Number|எண்)[.:\s]"),
    ("PATTA", r"பட்டா\s*எண்|Patta\s*(?:No|Number|Chitta)[.:\s]"),
    ("A_REGISTER", r"அ[\-‐–]?\s*பதிவேடு|A[\-‐–]?\s*Register|A[\-‐–]?\s*Pathivedu"),
    ("SALE_DEED", r"விற்பனை\s*பத்திரம்|Sale\s+Deed|Deed\s+of\s+(?:Sale|Conveyance)|விலை\s*ஆவணம்|Certified\s+Copy\s+of\s+(?:R|Register)|Book\s*(?:I|1)\s*/\s*[0-9]+\s*/\s*[0-9]{4}"),
    ("CHITTA", r"சிட்டா\s|Chitta\s*(?:No|Number|Extract)[.:\s]"),
    ("ADANGAL", r"அடங்கல்|Adangal|Village\s+Account"),
    ("FMB", r"Field\s+Measurement\s+Book|FMB\s*(?:No|Sketch|Extract)|வரைபட\s*எண்|நில\s*அளவை"),
    ("LAYOUT_APPROVAL", r"Layout\s+Approval|CMDA|DTCP|வரைபட\s*ஒப்புதல்|Planning\s+Permission|Approved\s+Layout"),
    ("LEGAL_HEIR", r"Legal\s+Heir\s+Certificate|சட்ட\s*வாரிசு\s*சான்றிதழ்|வாரிசு\s*சான்று"),
    ("POA", r"Power\s+of\s+Attorney|அதிகார\s*பத்திரம்|General\s+Power|Special\s+Power\s+of\s+Attorney"),
    ("COURT_ORDER", r"Court\s+Order|நீதிமன்ற\s*ஆணை|Decree|(?:District|High|Supreme)\s+Court|O\.?S\.?\s*No\.?"),
    ("WILL", r"Last\s+Will|Testament|உயிலின்|உயில்\s"),
    ("PARTITION_DEED", r"Partition\s+Deed|பாகப்\s*பிரிவினை\s*பத்திரம்|Deed\s+of\s+Partition"),
    ("GIFT_DEED", r"Gift\s+Deed|தான\s*பத்திரம்|Deed\s+of\s+Gift"),
    ("RELEASE_DEED", r"Release\s+Deed|விடுதலை\s*பத்திரம்|Deed\s+of\s+Release|Mortgage\s+Release"),
)
#: Confidence of a kind that a single keyword match gives.
SINGLE = 0.85


def matches(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """The kinds whose pattern occurs, in the order listed."""
    return F.filter(F.array(*(F.when(text.rlike(f"(?iu)(?:{p})"), F.lit(kind)) for kind, p in patterns)), lambda k: k.isNotNull())


def prefer(found: Column, kept: str, dropped: str) -> Column:
    """Without ``dropped`` where ``kept`` is there too."""
    return F.when(F.array_contains(found, kept), F.array_remove(found, dropped)).otherwise(found)


def keyword_kind(text: Column, filename: Column | None = None) -> Column:
    """All kinds found, and the kind with its confidence if there is just one."""
    found = matches(text, KEYWORDS)
    if filename is not None:
        hinted = filename.rlike(r"(?i)CCA[_\-]?Online") & ~F.array_contains(found, "SALE_DEED")
        found = F.when(hinted, F.array_append(found, F.lit("SALE_DEED"))).otherwise(found)
    found = prefer(found, "EC", "SALE_DEED")
    single = F.size(found) == 1
    return F.struct(found.alias("found"), F.when(single, F.get(found, 0)).alias("kind"), F.when(single, F.lit(SINGLE)).alias("confidence"))


def retry(keyword: Column, model: Column) -> Column:
    """Whether a model's kind disagrees with the single keyword kind."""
    return keyword.isNotNull() & model.isNotNull() & (keyword != model)


def satisfied(requires: Column, available: Column) -> Column:
    """Whether any group of required kinds is wholly there; no groups: yes."""
    return (F.size(requires) == 0) | F.exists(requires, lambda g: F.size(F.array_except(g, available)) == 0)


def missing(requires: Column, available: Column) -> Column:
    """The kinds that the nearest group still lacks (the first of equally near ones)."""
    gaps = F.transform(requires, lambda g, i: F.struct(F.size(F.array_except(g, available)).alias("n"), i.alias("i"), F.array_except(g, available).alias("kinds")))
    return F.array_min(gaps)["kinds"]


def gate(registry: DataFrame, cases: DataFrame) -> DataFrame:
    """Every check for every case: runnable or not, and what is missing.

    The registry is a small static table (tens of rows), so its product with the
    cases is bounded by a constant times the cases.
    """
    both = cases.join(F.broadcast(registry), F.lit(True))
    ok = satisfied(F.col("requires"), F.col("available"))
    return both.withColumn("runnable", ok).withColumn("missing", F.when(~ok, missing(F.col("requires"), F.col("available"))))
