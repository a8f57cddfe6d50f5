"""URL filter: rules first, then a ratio of two character models.

URLs that a rule decides train two character models, one of accepted and one of
rejected URLs: Markov models of variable order (contexts of 0 to ``ORDER``
characters, Witten-Bell interpolation, the shorter context backs up the
longer). A URL without a rule is judged by the difference of its log-likelihoods
under the two, divided by its length. The cut-off is calibrated on the URLs that
rules decide: it splits the distance of the two kinds' means in proportion to
their deviations. DataFrame functions only.

Characters are folded to ``SYMBOLS`` (letters without case, one sign for all
digits, some punctuation, one sign for the rest), so a model never has more than
``len(SYMBOLS) ** (ORDER + 1)`` entries, whatever the input. It is broadcast if
a count finds it under ``BROADCAST_GRAMS``; otherwise it is joined by shuffle.

Cases:

* a null URL, or one without ``://``, has empty host and path and no rule; what
  the models judge is empty too, and it is blocked;
* a path that is empty matches no rule, as rules' paths start with ``/``;
* of several fitting rules the longest decides, of equally long ones the first
  listed;
* without rule-decided URLs of one of the kinds nothing is known, and every
  other URL that has a host is allowed;
* null ids and repeated rows are judged like any other, one row each; other
  columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

#: The rules of the production filter.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
ORDER = 3
_PUNCTUATION = "./_-?=&#%:~+"
#: Letters, digits as 0, punctuation, * for the rest, ^ before the start, $ at the end.
SYMBOLS = string.ascii_lowercase + "0" + _PUNCTUATION + "*^$"
#: A model has no more entries than grams of ``SYMBOLS`` (about 3 million of 40 bytes): it can always be broadcast.
MOST_GRAMS = len(SYMBOLS) ** (ORDER + 1)


def host(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def folded(url: Column) -> Column:
    """What follows ``://``, folded to ``SYMBOLS``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    digits = F.translate(_lower(rest), "123456789", "0" * 9)
    return F.regexp_replace(digits, r"[^a-z0./_\-?=&#%:~+]", "*")


def rule(host_: Column, path_: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The rule that decides, as a struct of its text and verdict; else null."""

    def fits(text: str) -> Column:
        name, _, rest = text.partition("/")
        return ((host_ == name) | host_.endswith("." + name)) & path_.startswith("/" + rest)

    longest = sorted(rules, key=lambda r: -len(r[0]))
    return F.coalesce(*(F.when(fits(text), F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))) for text, verdict in longest))


def _grams(rows: DataFrame) -> DataFrame:
    """A row for each character and the end: it and the ``ORDER`` before it."""
    padded = F.concat(F.lit("^" * ORDER), F.col("_text"), F.lit("$"))
    parts = F.transform(F.sequence(F.lit(1), F.length("_text") + 1), lambda i: F.substr(padded, i, F.lit(ORDER + 1)))
    return rows.withColumn("_gram", F.explode(parts))


def ratios(grams: DataFrame) -> DataFrame:
    """_gram, allow, block (counts) -> _gram and the log of its two probabilities' ratio."""
    level = None
    for k in range(ORDER + 1):
        own = grams.groupBy(F.right("_gram", F.lit(k + 1)).alias("_g")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        context = Window.partitionBy(F.left("_g", F.lit(k)))
        for kind in ("allow", "block"):
            own = own.withColumn(f"_n_{kind}", F.sum(kind).over(context)).withColumn(f"_t_{kind}", F.sum((F.col(kind) > 0).cast("int")).over(context))
        if level is None:
            own = own.withColumns({f"_q_{kind}": F.lit(1.0 / len(SYMBOLS)) for kind in ("allow", "block")})
        else:
            own = own.join(level, F.right(own["_g"], F.lit(k)) == level["_s"]).drop("_s")
        level = own.select(
            F.col("_g").alias("_s"),
            *(
                F.when(F.col(f"_n_{kind}") > 0, (F.col(kind) + F.col(f"_t_{kind}") * F.col(f"_q_{kind}")) / (F.col(f"_n_{kind}") + F.col(f"_t_{kind}")))
                .otherwise(F.col(f"_q_{kind}"))
                .alias(f"_q_{kind}")
                for kind in ("allow", "block")
            ),
        )
    return level.select(F.col("_s").alias("_gram"), F.log(F.col("_q_allow") / F.col("_q_block")).alias("_ratio"))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the models' score of every page."""
    url = F.col("url")
    rows = (
        pages.select("page_id", "url")
        .withColumns({"host": host(url), "path": path(url), "_text": folded(url)})
        .withColumn("_by", rule(F.col("host"), F.col("path"), rules))
        .select(F.monotonically_increasing_id().alias("_row"), "page_id", "host", "path", "_text", F.col("_by.rule").alias("rule"), F.col("_by.verdict").alias("_ruled"))
    )
    rows = materialize(rows, "urls")
    grams = _grams(rows.select("_row", "_ruled", "_text"))
    counts = grams.groupBy("_gram").agg(*(F.sum((F.col("_ruled").eqNullSafe(kind)).cast("long")).alias(kind) for kind in ("allow", "block")))
    model = materialize(ratios(materialize(counts, "url-grams")), "url-model")
    if model.count() > MOST_GRAMS:
        raise AssertionError("more grams than the symbols allow")
    # of a row only its number goes with each character; its mean joins it again
    means = _grams(rows.select("_row", "_text")).select("_row", "_gram").join(F.broadcast(model), "_gram").groupBy("_row").agg(F.avg("_ratio").alias("score"))
    scored = materialize(rows.join(means, "_row"), "url-scores")
    of = scored.agg(
        *(f(F.when(F.col("_ruled") == kind, F.col("score"))).alias(f"{name}_{kind}") for kind in ("allow", "block") for name, f in (("m", F.avg), ("s", F.stddev_pop)))
    )
    # between the means, nearer to the kind that deviates less
    spread = F.col("s_allow") + F.col("s_block")
    cut = of.select(F.when(spread > 0, (F.col("m_allow") * F.col("s_block") + F.col("m_block") * F.col("s_allow")) / spread).otherwise((F.col("m_allow") + F.col("m_block")) / 2))
    by_model = F.when((F.col("_text") != "") & F.coalesce(F.col("score") >= cut.scalar(), F.lit(True)), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_ruled", by_model).alias("verdict"), "score")
