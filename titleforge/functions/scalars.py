"""Money, areas and dates written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tamil digits, 0 to 9.
TAMIL_DIGITS = "௦௧௨௩௪௫௬௭௮௯"

#: Square feet in a unit of area.
SQUARE_FEET = {
    "sq.ft": 1.0,
    "sqft": 1.0,
    "sq ft": 1.0,
    "square feet": 1.0,
    "sq.m": 10.764,
    "sqm": 10.764,
    "sq m": 10.764,
    "square meters": 10.764,
    "cents": 435.6,
    "cent": 435.6,
    "acres": 43560.0,
    "acre": 43560.0,
    "hectares": 107639.0,
    "hectare": 107639.0,
    "ha": 107639.0,
    "ground": 2400.0,
    "grounds": 2400.0,
    "kuzhi": 144.0,
    "kuzhis": 144.0,
    "ares": 1076.39,
    "are": 1076.39,
    "guntha": 1089.0,
    "gunthas": 1089.0,
}

#: Date layouts, in the order in which they are tried.
DATE_LAYOUTS = ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "yyyy/M/d", "M/d/yyyy", "d MMM yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMM d, yyyy")

_NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$"


def ascii_digits(text: Column) -> Column:
    return F.translate(text, TAMIL_DIGITS, "0123456789")


def number(text: Column) -> Column:
    """A number as plain text, underscores between digits allowed; else null."""
    t = F.trim(text)
    return F.when(t.rlike(_NUMBER), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))


def parse_amount(text: Column) -> Column:
    """Rupees in a text: currency marks, thousands commas, lakh and crore.

    Any ``cr`` counts as crore, and the marks are case-sensitive: both as in the
    records that this has to agree with.
    """
    s = ascii_digits(F.trim(text))
    for mark in ("Rs.", "Rs", "₹", "INR"):
        s = F.replace(s, F.lit(mark), F.lit(""))
    s = F.trim(F.replace(s, F.lit(","), F.lit("")))
    low = F.lower(s)
    crore, lakh = low.contains("cr"), low.contains("lakh") | low.contains("lac")
    bare = (
        F.when(crore, F.regexp_replace(s, r"(?i)\s*(crores?|crs?)\.?", ""))
        .when(lakh, F.regexp_replace(s, r"(?i)\s*(lakhs?|lacs?)\.?", ""))
        .otherwise(s)
    )
    times = F.when(crore, F.lit(1e7)).when(lakh, F.lit(1e5)).otherwise(F.lit(1.0))
    return number(F.replace(bare, F.lit(" "), F.lit(""))) * times


def parse_area(text: Column) -> Column:
    """Square feet in a text; number and unit pairs add up, a bare number is square feet."""
    units = sorted(SQUARE_FEET, key=len, reverse=True)
    pattern = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(" + "|".join(u.replace(".", r"\.") for u in units) + ")"
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    factor = F.create_map(*(F.lit(x) for kv in SQUARE_FEET.items() for x in kv))
    each = F.zip_with(values, names, lambda v, u: v.cast("double") * F.try_element_at(factor, F.lower(u)))
    total = F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, total).otherwise(number(F.replace(text, F.lit(","), F.lit(""))))


def parse_date(text: Column) -> Column:
    """The first layout that fits; else 1 January of the first year in the text."""
    t = F.trim(text)
    tried = [F.try_to_date(t, layout) for layout in DATE_LAYOUTS]
    year = F.regexp_extract(t, r"\b((?:19|20)[0-9]{2})\b", 1)
    return F.coalesce(*tried, F.when(year != "", F.try_to_date(F.concat(year, F.lit("-01-01")), "yyyy-MM-dd")))


def suspiciously_round(amount: Column) -> Column:
    """Whole lakhs from a lakh up, whole ten thousands below."""
    return (amount > 0) & F.when(amount >= 100_000, F.pmod(amount, F.lit(100_000.0)) == 0).otherwise(F.pmod(amount, F.lit(10_000.0)) == 0)


def indian_grouping(amount: Column) -> Column:
    """Whole rupees with the last three digits apart and pairs before them."""
    digits = F.abs(amount).cast("decimal(38,0)").cast("string")
    head = F.reverse(F.regexp_replace(F.reverse(F.substr(digits, F.lit(1), F.length(digits) - 3)), r"([0-9]{2})(?=[0-9])", "$1,"))
    grouped = F.when(F.length(digits) > 3, F.concat(head, F.lit(","), F.right(digits, F.lit(3)))).otherwise(digits)
    return F.concat(F.when(amount < 0, "-").otherwise(""), grouped)


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, rounded by its exact binary value and to even, without grouping.

    ``format_string`` rounds the shortest decimal text of the number instead, and its halves up: 1.005 would be 1.01.
    """
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def document_age(date: Column, as_of: Column) -> Column:
    """Days and years (of 365.25 days) since a date, and what follows from them."""
    days = F.datediff(as_of, date)
    years = F.round(days / 365.25, 1)
    return F.struct(days.alias("days"), years.alias("years"), (days > 12 * 365).alias("beyond_limitation"), (days > 30 * 365).alias("over_thirty_years"), (days < 0).alias("in_future"))
