"""Chain of title: links of all document kinds, deduplicated, ordered, numbered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_date
from ..functions.variants import each, filled, get, text_of

#: Stand-ins for a missing party.
PLACEHOLDERS = ("", "unknown", "not available", "n/a", "na", "-")
#: What ways of acquiring are called in a chain.
ACQUIRED = {
    "sale": "SALE",
    "gift": "GIFT",
    "inheritance": "INHERITANCE",
    "partition": "PARTITION",
    "settlement": "SETTLEMENT",
    "unknown": "OTHER",
    "will": "WILL",
    "release": "RELEASE",
    "exchange": "EXCHANGE",
    "relinquishment": "RELINQUISHMENT",
    "adoption": "ADOPTION",
}
#: Kinds that transfer title, burden it, are procedural, judicial or structural.
TITLE = ("sale", "gift", "partition", "will", "exchange", "settlement", "relinquishment", "adoption", "sale deed", "gift deed", "partition deed", "release deed")
ENCUMBRANCE = ("mortgage", "lease", "agreement", "surety")
ADMINISTRATIVE = ("rectification", "cancellation", "release", "reconveyance", "declaration", "receipt")
JUDICIAL = ("court_order",)
STRUCTURAL = ("power_of_attorney", "trust", "amalgamation", "other")
CHAIN_RELEVANT = (*TITLE, "release")


def is_title(kind: Column) -> Column:
    return F.lower(F.trim(F.coalesce(kind, F.lit("")))).isin(*TITLE)


def risk_tier(kind: Column) -> Column:
    k = F.lower(F.trim(F.coalesce(kind, F.lit("other"))))
    return F.when(k.isin(*ENCUMBRANCE, *JUDICIAL), "CRITICAL").when(k.isin(*ADMINISTRATIVE), "ROUTINE").otherwise("IMPORTANT")


def links(rows: DataFrame, case: Column, date: Column, seller: Column, buyer: Column, kind: Column, document: Column, notes: Column, source: Column) -> DataFrame:
    """Edges of one document kind; those without two real ends go."""
    real = lambda c: ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*PLACEHOLDERS)
    return rows.where(real(seller) & real(buyer)).select(
        case.alias("case_id"), date.alias("date"), F.trim(seller).alias("seller"), F.trim(buyer).alias("buyer"), F.upper(kind).alias("transaction_type"), document.alias("document_number"), F.coalesce(notes, F.lit("")).alias("notes"), source.alias("source")
    )


# links of each kind of record


def acquired(mode: Column, otherwise: Column | None = None) -> Column:
    """The kind of transaction behind a way of acquiring."""
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in ACQUIRED.items() for x in kv)), F.lower(mode))
    return F.coalesce(known, F.lit("OTHER") if otherwise is None else otherwise)


def _link(seller: Column, buyer: Column, date: Column, kind: Column | str, document: Column, source: str, notes: Column | str = "", transaction: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.struct(
        text(date).alias("date"), text(seller).alias("seller"), text(buyer).alias("buyer"), F.upper(F.trim(F.coalesce(lit(kind), F.lit("OTHER")))).alias("transaction_type"),
        text(document).alias("document_number"), text(lit(notes)).alias("notes"), F.lit(source).alias("source"), text(F.lit("") if transaction is None else transaction).alias("transaction_id"),
    )


def joined_names(v: Column, path: str) -> Column:
    """The names of a list of parties, or a plain text."""
    listed = F.filter(F.transform(each(v, path), lambda p: F.trim(text_of(p))), lambda n: n != "")
    return F.when(get(v, path, "array<variant>").isNotNull(), F.array_join(listed, ", ")).otherwise(F.trim(F.coalesce(get(v, path), F.lit(""))))


def _ec(v: Column) -> Column:
    kind = lambda t: F.lower(F.trim(F.coalesce(get(t, "transaction_type"), F.lit(""))))
    document = lambda t: F.concat_ws("/", filled(get(t, "document_number")), F.when(filled(get(t, "document_number")).isNotNull(), filled(get(t, "document_year"))))
    moves = F.filter(each(v, "transactions"), lambda t: kind(t).isin(*CHAIN_RELEVANT))
    return F.transform(moves, lambda t: _link(get(t, "seller_or_executant"), get(t, "buyer_or_claimant"), get(t, "date"), kind(t), document(t), "EC", transaction=get(t, "transaction_id")))


def _deed(v: Column) -> Column:
    sellers, buyers = joined_names(v, "seller"), joined_names(v, "buyer")
    p = "previous_ownership."
    history = F.filter(each(v, "ownership_history"), lambda h: (F.trim(get(h, "acquired_from")) != "") & (F.trim(get(h, "owner")) != ""))
    mode = lambda c: acquired(F.coalesce(filled(c), F.lit("unknown")))
    return F.concat(
        F.array(_link(sellers, buyers, F.coalesce(get(v, "registration_date"), get(v, "execution_date")), "SALE", get(v, "document_number"), "Sale Deed")),
        F.array(_link(get(v, p + "previous_owner"), F.get(F.split(sellers, ","), 0), get(v, p + "document_date"), mode(get(v, p + "acquisition_mode")), get(v, p + "document_number"), "Sale Deed", "Previous ownership link")),
        F.transform(history, lambda h: _link(get(h, "acquired_from"), get(h, "owner"), get(h, "document_date"), mode(get(h, "acquisition_mode")), get(h, "document_number"), "Sale Deed", "Ownership history")),
    )


def _register(v: Column) -> Column:
    def one(m: Column) -> Column:
        why = F.trim(F.coalesce(filled(get(m, "reason")), F.lit("OTHER")))
        return _link(F.coalesce(filled(get(m, "from_owner")), get(v, "owner_name")), get(m, "to_owner"), get(m, "date"), acquired(why, F.upper(why)), get(m, "order_number"), "A-Register")

    return F.transform(each(v, "mutation_entries"), one)


def _party(v: Column, path: str) -> Column:
    return text_of(get(v, path, "variant"))


def _single(seller: str, buyer: str, kind: str, source: str, notes: str = "") -> Callable[[Column], Column]:
    return lambda v: F.array(_link(_party(v, seller), _party(v, buyer), get(v, "registration_date"), kind, get(v, "registration_number"), source, notes))


def _partition(v: Column) -> Column:
    joint = joined_names(v, "joint_owners")
    return F.transform(each(v, "partitioned_shares"), lambda s: _link(joint, get(s, "name"), get(v, "registration_date"), "PARTITION", get(v, "registration_number"), "Partition Deed"))


def _will(v: Column) -> Column:
    day = F.coalesce(get(v, "execution_date"), get(v, "registration_date"))
    share = lambda b: F.concat(F.lit("Bequest: "), filled(get(b, "share")))
    return F.transform(each(v, "beneficiaries"), lambda b: _link(_party(v, "testator"), get(b, "name"), day, "WILL", get(v, "registration_number"), "Will", share(b)))


def _heirs(v: Column) -> Column:
    day = F.coalesce(get(v, "date_of_death"), get(v, "certificate_date"))
    notes = lambda h: F.concat_ws(", ", filled(get(h, "relationship")), F.concat(filled(get(h, "share_percentage")), F.lit("%")))
    return F.transform(each(v, "heirs"), lambda h: _link(get(v, "deceased_name"), get(h, "name"), day, "INHERITANCE", get(v, "certificate_number"), "Legal Heir", notes(h)))


def _court(v: Column) -> Column:
    kind = F.lower(F.trim(F.coalesce(get(v, "order_type"), F.lit(""))))
    notes = F.concat(F.lit("Order type: "), kind, F.lit(", status: "), F.coalesce(get(v, "status"), F.lit("unknown")))
    only = F.array(_link(get(v, "petitioner"), get(v, "respondent"), get(v, "order_date"), "COURT_ORDER", get(v, "case_number"), "Court Order", notes))
    return F.filter(only, lambda x: kind.isin("decree", "attachment"))


#: The links of each kind of record, in the order in which they are laid out.
EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "EC": _ec,
    "SALE_DEED": _deed,
    "A_REGISTER": _register,
    "GIFT_DEED": _single("donor", "donee", "GIFT", "Gift Deed"),
    "PARTITION_DEED": _partition,
    "RELEASE_DEED": _single("releasing_party", "beneficiary", "RELEASE", "Release Deed"),
    "WILL": _will,
    "LEGAL_HEIR": _heirs,
    "COURT_ORDER": _court,
    "POA": _single("principal", "agent", "POWER_OF_ATTORNEY", "POA", "Authorisation (not title transfer)"),
}


def extract(documents: DataFrame) -> DataFrame:
    """case_id, doc_ord, filename, document_type, data (JSON) -> all links with two real ends."""
    out = None
    real = lambda c: ~F.lower(c).isin(*PLACEHOLDERS)
    for kind, links_of in EXTRACTORS.items():
        read = documents.where(F.col("document_type") == kind).select("case_id", "doc_ord", "filename", F.explode(F.array(F.try_parse_json("data"))).alias("_v")).where("_v IS NOT NULL")
        own = read.select("case_id", "doc_ord", "filename", F.posexplode(links_of(F.col("_v"))).alias("pos", "_l")).select("case_id", "doc_ord", "pos", "filename", "_l.*")
        own = own.where(real(F.col("seller")) & real(F.col("buyer")))
        out = own if out is None else out.unionByName(own)
    return out.withColumn("day", parse_date(F.col("date"))).withColumn("valid", F.lit(True))


def build(documents: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """The chain of each case: links of all records, one per key, laid under a model's, numbered."""
    own = fold(extract(documents))
    if judged is not None:
        own = overlay(own, judged)
    return number(own.withColumn("date_text", F.col("date")).withColumn("date", F.col("day"))).drop("day", "_key")


def link_key() -> Column:
    """Document, kind and buyer; without a document seller, buyer and kind."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    return F.when(low("document_number") != "", F.concat_ws("|", low("document_number"), low("transaction_type"), low("buyer"))).otherwise(F.concat(low("seller"), F.lit(">"), low("buyer"), F.lit("|"), low("transaction_type")))


def fold(edges: DataFrame) -> DataFrame:
    """One link per case and key, in the order of the records: a later one replaces it
    if only that is dated, or if its notes are longer. A fold, as the rule isn't an order."""
    fields = [c for c in edges.columns if c not in ("case_id",)]
    row = F.struct("doc_ord", "pos", *(F.col(c) for c in fields if c not in ("doc_ord", "pos")))
    g = edges.groupBy("case_id", link_key().alias("_key")).agg(F.array_sort(F.collect_list(row)).alias("_l"))
    better = lambda kept, new: ((kept["date"] == "") & (new["date"] != "")) | (F.length(new["notes"]) > F.length(kept["notes"]))
    won = F.aggregate(F.slice("_l", F.lit(2), F.greatest(F.size("_l") - 1, F.lit(0))), F.get("_l", F.lit(0)), lambda kept, new: F.when(better(kept, new), new).otherwise(kept))
    return g.select("case_id", "_key", won.alias("_w")).select("case_id", "_key", "_w.*")


def overlay(edges: DataFrame, judged: DataFrame) -> DataFrame:
    """A model's links (case_id, date, seller, buyer, transaction_type, document_number, notes, valid):
    they fill empty notes, set ``valid`` where they state it, and add links that we lack."""
    last = judged.groupBy("case_id", link_key().alias("_key")).agg(F.max_by(F.struct("notes", "valid", "date", "seller", "buyer", "transaction_type", "document_number"), F.struct(F.length("notes"), "date", "seller")).alias("_j"))
    both = edges.join(last, ["case_id", "_key"], "full_outer")
    j = lambda k: F.col(f"_j.{k}")
    new = F.col("source").isNull()
    kept = [c for c in edges.columns if c not in ("case_id", "_key")]
    given = {c: F.coalesce(F.col(c), F.coalesce(j(c), F.lit(""))) for c in ("date", "seller", "buyer", "transaction_type", "document_number")}
    given |= {
        "notes": F.when(F.coalesce(F.col("notes"), F.lit("")) != "", F.col("notes")).otherwise(F.coalesce(j("notes"), F.lit(""))),
        "valid": F.coalesce(j("valid"), F.col("valid"), F.lit(True)),
        "source": F.coalesce(F.col("source"), F.lit("LLM")),
        "transaction_id": F.coalesce("transaction_id", F.lit("")),
        "day": F.when(new, parse_date(j("date"))).otherwise(F.col("day")),
    }
    return both.select("case_id", "_key", *(given.get(c, F.col(c)).alias(c) for c in kept))


def out_links(edges: DataFrame) -> DataFrame:
    """For each person of a case, to whom it passed on, and from which sources that is known."""
    return edges.groupBy("case_id", "seller").agg(F.array_sort(F.collect_set("buyer")).alias("buyers"), F.array_sort(F.collect_set("source")).alias("sources"))


def dedup(edges: DataFrame) -> DataFrame:
    """One edge per document, kind and buyer (without a document: per ends and kind); dated, then longer notes."""
    ends = F.concat_ws("|", F.concat_ws(">", F.lower("seller"), F.lower("buyer")), "transaction_type")
    by_document = F.concat_ws("|", "document_number", "transaction_type", F.lower("buyer"))
    key = F.when(F.coalesce(F.col("document_number"), F.lit("")) != "", by_document).otherwise(ends)
    w = Window.partitionBy("case_id", key).orderBy(F.col("date").isNull(), F.desc(F.length("notes")), "source", "date", "seller")
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def number(edges: DataFrame) -> DataFrame:
    """In order of date (else the year of the document), unknown last, then document."""
    year = F.regexp_extract(F.coalesce(F.col("document_number"), F.lit("")), r"((?:19|20)[0-9]{2})", 1)
    at = F.coalesce(F.col("date"), F.when(year != "", F.try_to_date(F.concat(year, F.lit("-01-01")), "yyyy-MM-dd")))
    w = Window.partitionBy("case_id").orderBy(at.asc_nulls_last(), "document_number", "seller", "buyer", "transaction_type")
    return edges.withColumn("sequence", F.row_number().over(w))


def merge(edges: DataFrame, judged: DataFrame, on: list[str]) -> DataFrame:
    """A model's chain laid over ours: it fills empty notes, sets ``valid``, and adds what we lack."""
    a, b = edges.alias("a"), judged.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on], "full_outer")
    rest = [c for c in edges.columns if c not in {*on, "notes"}]
    return joined.select(
        *(F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in on),
        F.when(F.coalesce(F.col("a.notes"), F.lit("")) != "", F.col("a.notes")).otherwise(F.col("b.notes")).alias("notes"),
        F.coalesce(F.col("b.valid"), F.lit(True)).alias("valid"),
        *(F.col(f"a.{c}").alias(c) for c in rest),
    )
