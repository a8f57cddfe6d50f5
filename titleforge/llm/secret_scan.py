"""Secret scan with multipart credential linking, with DataFrame functions only.

Parts are found by patterns: strong ones (the base) are always reported; weak
ones, which alone mean little, only where the complementary parts of a
credential stand within ``SCOPE`` code points: a weak secret near an access
identifier, a weak identifier (a short key, a user, a mail address) near a secret, an
endpoint near both. The
nearness is the gap from a part's end to the next one's start, by an interval
join: positions are cut into buckets of the scope's width, the parts of a role
that touch a bucket are reduced to their first start and last end, and each part
meets the buckets that it touches and the two beside them, so that the join's
size is proportional to the parts and their lengths.

Cases:

* null text counts as empty; documents without parts have counts of 0, no spans
  and the digest of the empty text;
* parts of any length are matched whole, over whole texts; positions are code
  points, ends exclusive;
* equal starts are ordered by kind, as listed in ``KINDS``;
* null ids and repeated rows each give a row; other columns are kept by
  :func:`redacted`; columns that start with ``_scan_`` are this module's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

#: Kinds in the order of equal starts; the first three are the base.
KINDS = ("assign", "access", "hex", "weak_assign", "weak_access", "weak_hex", "user", "endpoint")
SCOPE = 200
MASK = "[SECRET]"

#: The patterns of the base.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of at least the weak length; longer ones are strong. A shorter run can't
#: hide a longer match, so the lower limit may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{12,}"
#: A labelled user, account or client, or a mail address: an identifier, never reported alone.
USER = r"""(?i)\b(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{2,}|\b[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"""
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"

#: Least lengths: of the strong (base) and weak parts.
ASSIGN_STRONG, ASSIGN_WEAK = 12, 8
ACCESS_STRONG = 18
HEX_STRONG = 16

_ROLE = {"assign": "secret", "weak_assign": "secret", "hex": "secret", "weak_hex": "secret", "access": "id", "weak_access": "id", "user": "id", "endpoint": "endpoint"}


def _runs(text: Column, pattern: str, kind: Column | None = None) -> Column:
    """Matches as (gap before, length, kind); gaps are measured from the last match's end."""
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, p, F.lit(0))
    return F.zip_with(gaps, F.transform(found, lambda m: F.struct(F.length(m).alias("n"), kind(m).alias("kind"))), lambda g, m: F.struct(g.alias("gap"), m["n"].alias("n"), m["kind"].alias("kind")))


def _assign_kind(m: Column) -> Column:
    n = F.length(F.regexp_extract(m, "^" + ASSIGN, 2))
    return F.when(n >= ASSIGN_STRONG, "assign").when(n >= ASSIGN_WEAK, "weak_assign")


def _hex_kind(m: Column) -> Column:
    return F.when(F.length(m) >= HEX_STRONG, "hex").when(m.rlike("[0-9]") & m.rlike("[a-f]"), "weak_hex")


def _parts(docs: DataFrame) -> DataFrame:
    """``docs`` with _scan_row and, per pattern, its matches."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.lit(None).cast("array<struct<gap:int,n:int,kind:string>>")
    found = F.array(
        _runs(text, ASSIGN, _assign_kind),
        F.when(F.contains(text, F.lit("AKIA")), _runs(text, ACCESS, lambda m: F.when(F.length(m) >= ACCESS_STRONG, "access").otherwise("weak_access"))).otherwise(none),
        _runs(text, HEX, _hex_kind),
        F.when(text.rlike(r"(?i)@|user|login|account|client"), _runs(text, USER, lambda m: F.lit("user"))).otherwise(none),
        F.when(text.rlike(r"://|[0-9]\.[0-9]"), _runs(text, ENDPOINT, lambda m: F.lit("endpoint"))).otherwise(none),
    )
    # the piece after the last match comes out with a null length
    found = F.filter(F.transform(found, lambda a: F.filter(a, lambda m: m["n"].isNotNull())), lambda a: F.size(a) > 0)
    return docs.withColumn("_scan_row", F.monotonically_increasing_id()).withColumn("_scan_found", found)


def spans(rows: DataFrame) -> DataFrame:
    """_scan_row, _scan_found -> _scan_row, kind, start, end of what is reported."""
    each = rows.select("_scan_row", F.posexplode("_scan_found").alias("_p", "_a")).select("_scan_row", "_p", F.posexplode("_a").alias("_i", "_m"))
    before = Window.partitionBy("_scan_row", "_p").orderBy("_i")
    placed = each.withColumn("end", F.sum(F.col("_m.gap") + F.col("_m.n")).over(before)).where(F.col("_m.kind").isNotNull())
    role = F.create_map(*(F.lit(x) for kv in _ROLE.items() for x in kv))
    placed = placed.select("_scan_row", F.col("_m.kind").alias("kind"), (F.col("end") - F.col("_m.n")).cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    placed = materialize(placed.withColumn("_role", role[F.col("kind")]), "secret-parts")
    low, high = F.floor(F.col("start") / SCOPE), F.floor(F.col("end") / SCOPE)
    covered = placed.withColumn("_b", F.explode(F.sequence(low, high)))
    ends = covered.groupBy("_scan_row", "_b", "_role").agg(F.min("start").alias("_first"), F.max("end").alias("_last"))
    weak = placed.where(~F.col("kind").isin(*KINDS[:3]))
    near = (
        weak.withColumn("_at", F.explode(F.sequence(low - 1, high + 1)))
        .join(ends.withColumnsRenamed({"_b": "_at", "_role": "_other"}), ["_scan_row", "_at"])
        .withColumn("_near", F.when(F.col("_at") < low, F.col("start") - F.col("_last") <= SCOPE).when(F.col("_at") > high, F.col("_first") - F.col("end") <= SCOPE).otherwise(F.lit(True)))
        .groupBy("_scan_row", "kind", "start", "end", "_role")
        .agg(*(F.max(F.col("_near") & (F.col("_other") == r)).alias(f"_by_{r}") for r in ("id", "secret")))
    )
    linked = near.where(
        F.when(F.col("_role") == "secret", F.col("_by_id")).when(F.col("_role") == "id", F.col("_by_secret")).otherwise(F.col("_by_id") & F.col("_by_secret"))
    )
    cols = ("_scan_row", "kind", "start", "end")
    return placed.where(F.col("kind").isin(*KINDS[:3])).select(*cols).unionByName(linked.select(*cols))


def _listed(found: DataFrame) -> DataFrame:
    """Per _scan_row its spans, sorted by start and kind."""
    order = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    return found.groupBy("_scan_row").agg(F.array_sort(F.collect_list(F.struct("start", order[F.col("kind")].alias("k"), "end", "kind"))).alias("_scan_spans"))


def _count(all_spans: Column, kind: str) -> Column:
    return F.size(F.filter(all_spans, lambda s: s["kind"] == kind)).cast("long")


def scan_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base, and all spans of every document."""
    rows = materialize(_parts(docs.select("doc_id", "text")).drop("text"), "secret-rows")
    joined = rows.select("_scan_row", "doc_id").join(_listed(spans(rows)), "_scan_row", "left")
    all_spans = F.coalesce(F.col("_scan_spans"), F.array().cast("array<struct<start:bigint,k:int,end:bigint,kind:string>>"))
    base = F.filter(all_spans, lambda s: s["k"] < 3)
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return joined.select(
        "doc_id",
        *(_count(all_spans, k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(all_spans).alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``MASK`` in place of every reported span."""
    rows = materialize(_parts(docs), "secret-texts")
    hit = F.size("_scan_found") > 0
    joined = rows.where(hit).join(_listed(spans(rows.where(hit).select("_scan_row", "_scan_found"))), "_scan_row", "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def cut(acc: Column, s: Column) -> Column:
        # a span inside an earlier one adds nothing
        kept = F.concat(acc["out"], F.substr(F.col("text"), acc["at"].cast("int") + 1, F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int")))
        mask = F.when(s["start"] >= acc["at"], F.lit(MASK)).otherwise(F.lit(""))
        return F.struct(F.concat(kept, mask).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate("_scan_spans", start, cut, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"].cast("int") + 1, F.length("text"))))
    text = F.when(F.col("_scan_spans").isNull(), F.col("text")).otherwise(done)
    with_text = joined.withColumn("text", text).select(*docs.columns)
    return rows.where(~hit | hit.isNull()).select(*docs.columns).unionByName(with_text)
