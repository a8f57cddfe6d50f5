"""Cases: documents with JSON records -> typed tables, one per kind of record."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parse_amount, parse_area, parse_date
from ..functions.variants import each, get, text_of
from ..operators.chain import risk_tier

#: The records' layouts. Fields that come as text or as a structure stay text.
EC = (
    "struct<ec_number:string,village:string,taluk:string,period_from:string,period_to:string,total_entries_found:int,extraction_notes:string,survey_number:string,property_description:string,"
    "transactions:array<struct<row_number:int,date:string,document_number:string,document_year:string,sro:string,transaction_type:string,seller_or_executant:string,buyer_or_claimant:string,extent:string,"
    "survey_number:string,consideration_amount:string,market_value:string,remarks:string,plot_number:string,suspicious_flags:array<string>,transaction_id:string>>>"
)
_PARTY = "array<struct<name:string,father_name:string,age:string,address:string,pan:string,aadhaar:string>>"
DEED = (
    f"struct<document_number:string,registration_date:string,execution_date:string,sro:string,seller:{_PARTY},buyer:{_PARTY},"
    "property:struct<survey_number:string,village:string,taluk:string,district:string,extent:string,property_type:string,plot_number:string,boundaries:string>,"
    "financials:struct<consideration_amount:string,guideline_value:string,stamp_duty:string,registration_fee:string>,power_of_attorney:string,encumbrance_declaration:string,remarks:string,"
    "previous_ownership:struct<document_number:string,document_date:string,previous_owner:string,acquisition_mode:string>,"
    "ownership_history:array<struct<owner:string,acquired_from:string,acquisition_mode:string,document_number:string,document_date:string,remarks:string>>,witnesses:array<struct<name:string>>>"
)
PATTA = "struct<patta_number:string,village:string,taluk:string,district:string,total_extent:string,owner_names:array<struct<name:string,father_name:string,share:string>>,survey_numbers:array<struct<survey_no:string,extent:string,classification:string>>>"
FMB = "struct<survey_number:string,village:string,taluk:string,district:string,area_acres:string,boundaries:map<string,string>,adjacent_surveys:array<struct<direction:string,survey_no:string,owner_name:string>>>"


@dataclass
class CaseTables:
    """documents(case_id, doc_ord, filename, document_type, data) and what follows from it."""

    documents: DataFrame
    #: Parsed tables are read by many rules: keep them, in memory or on disk.
    keep: bool = True

    def _kept(self, rows: DataFrame) -> DataFrame:
        return rows.persist(StorageLevel.MEMORY_AND_DISK) if self.keep else rows

    def release(self) -> None:
        for name, value in vars(self).items():
            if isinstance(value, DataFrame) and name != "documents":
                value.unpersist()

    def _of(self, kind: str, layout: str) -> DataFrame:
        rows = self.documents.where(F.col("document_type") == kind)
        # a generator's output is read as columns: a projection would repeat the parsing in every use
        return rows.select("case_id", "doc_ord", "filename", F.inline(F.array(F.from_json(F.coalesce("data", F.lit("{}")), layout))))

    @cached_property
    def ec(self) -> DataFrame:
        return self._kept(self._of("EC", EC).withColumns({"start": parse_date(F.col("period_from")), "end": parse_date(F.col("period_to"))}))

    @cached_property
    def transactions(self) -> DataFrame:
        each = self.ec.select("case_id", "doc_ord", "filename", "start", "end", F.posexplode("transactions").alias("pos", "t")).select("case_id", "doc_ord", "filename", "start", "end", "pos", "t.*")
        kind = F.lower(F.trim(F.coalesce("transaction_type", F.lit(""))))
        return self._kept(each.withColumns({"day": parse_date(F.col("date")), "amount": parse_amount(F.col("consideration_amount")), "kind": kind, "tier": risk_tier(F.col("transaction_type"))}))

    @cached_property
    def deeds(self) -> DataFrame:
        d = self._of("SALE_DEED", DEED)
        money = {k: parse_amount(F.col(f"financials.{k}")) for k in ("consideration_amount", "guideline_value", "stamp_duty", "registration_fee")}
        return self._kept(d.withColumns({"day": F.coalesce(parse_date(F.col("registration_date")), parse_date(F.col("execution_date"))), "sqft": parse_area(F.col("property.extent")), **money}))

    @cached_property
    def parties(self) -> DataFrame:
        """Sellers and buyers of deeds."""
        both = [self.deeds.select("case_id", "doc_ord", "filename", F.lit(role).alias("role"), F.posexplode(role).alias("pos", "p")).select("case_id", "doc_ord", "filename", "role", "pos", "p.*") for role in ("seller", "buyer")]
        return self._kept(both[0].unionByName(both[1]))

    @cached_property
    def pattas(self) -> DataFrame:
        return self._kept(self._of("PATTA", PATTA).withColumn("sqft", parse_area(F.col("total_extent"))))

    @cached_property
    def land_records(self) -> DataFrame:
        """Village, taluk, district and owners of the land registers, read as they are."""
        rows = self.documents.where(F.col("document_type").isin("PATTA", "CHITTA", "A_REGISTER"))
        v = F.col("_v")
        read = rows.select("case_id", "doc_ord", "filename", "document_type", F.explode(F.array(F.try_parse_json("data"))).alias("_v"))
        names = F.filter(F.transform(each(v, "owner_names"), lambda o: F.trim(text_of(o))), lambda n: n != "")
        return self._kept(read.select("case_id", "doc_ord", "filename", "document_type", *(get(v, k).alias(k) for k in ("village", "taluk", "district")), names.alias("owners")))

    @cached_property
    def owners(self) -> DataFrame:
        """Owners that the land registers name."""
        return self._kept(self.land_records.select("case_id", "doc_ord", "filename", "document_type", F.posexplode("owners").alias("pos", "name")))

    @cached_property
    def patta_owners(self) -> DataFrame:
        return self._kept(self.pattas.select("case_id", "doc_ord", "filename", F.posexplode("owner_names").alias("pos", "o")).select("case_id", "doc_ord", "filename", "pos", "o.name"))

    @cached_property
    def patta_surveys(self) -> DataFrame:
        return self._kept(self.pattas.select("case_id", "doc_ord", "filename", F.posexplode("survey_numbers").alias("pos", "s")).select("case_id", "doc_ord", "filename", "pos", "s.*").withColumn("sqft", parse_area(F.col("extent"))))

    @cached_property
    def fmb(self) -> DataFrame:
        return self._kept(self._of("FMB", FMB))

    @cached_property
    def boundaries(self) -> DataFrame:
        """Boundaries of deeds by direction; text or structure, read as a structure where it is one."""
        as_map = F.from_json(F.col("property.boundaries"), "map<string,string>")
        return self._kept(self.deeds.select("case_id", "filename", F.explode(as_map).alias("direction", "boundary")).withColumn("direction", F.lower("direction")))

    @cached_property
    def places(self) -> DataFrame:
        """Village, taluk and district of each document that states them, in document order."""
        parts = [
            self.ec.select("case_id", "doc_ord", "filename", F.lit("EC").alias("document_type"), "village", "taluk", F.lit(None).cast("string").alias("district")),
            self.deeds.select("case_id", "doc_ord", "filename", F.lit("SALE_DEED").alias("document_type"), "property.village", "property.taluk", "property.district"),
            self.land_records.select("case_id", "doc_ord", "filename", "document_type", "village", "taluk", "district"),
            self.fmb.select("case_id", "doc_ord", "filename", F.lit("FMB").alias("document_type"), "village", "taluk", "district"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return self._kept(out)

    @cached_property
    def surveys(self) -> DataFrame:
        """Survey numbers with the document and kind of document that state them."""
        from ..functions.surveys import split_surveys

        lists: list[tuple[DataFrame, str, Column]] = [
            (self.transactions, "EC", F.col("survey_number")),
            (self.deeds, "SALE_DEED", F.col("property.survey_number")),
            (self.patta_surveys, "PATTA", F.col("survey_no")),
            (self.fmb, "FMB", F.col("survey_number")),
        ]
        out = None
        for rows, kind, c in lists:
            own = rows.select("case_id", "doc_ord", "filename", F.lit(kind).alias("document_type"), F.explode(split_surveys(c)).alias("survey"))
            out = own if out is None else out.unionByName(own)
        return self._kept(out.where(F.trim("survey") != ""))

    @cached_property
    def resolved(self) -> DataFrame:
        """All mentions of persons with the cluster that each belongs to."""
        from ..operators.identity import resolve

        return self._kept(resolve(self))
