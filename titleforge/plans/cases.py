"""Cases made of the driver's tables: a customer's orders as certificate, deed, patta and sketch.

``BASE`` states the same rows as SQL: ``t``, a row per line of a certificate, and ``d``, a row
per case (its last order). The queries run the package's operators over the JSON records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.cases import CaseTables
from ..sources.tables import load

#: The day at which ages are measured.
AS_OF = "2010-01-01"

#: The kinds of record of a case.
CASE_KINDS = ("EC", "SALE_DEED", "PATTA", "FMB")
KINDS = {"1-URGENT": "Sale", "2-HIGH": "Mortgage", "3-MEDIUM": "Gift", "4-NOT SPECIFIED": "Release", "5-LOW": "Sale"}
SELLERS = {"F": "Murugan", "O": "Lakshmi", "P": "Xavier"}
BUYERS = {"1-URGENT": "Anbarasu", "2-HIGH": "Zubeida", "3-MEDIUM": "Kumar", "4-NOT SPECIFIED": "Quentin", "5-LOW": "Murugan"}


def _case(pairs: dict[str, str], c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


BASE = f"""
t AS (
  SELECT o_custkey AS case_id, o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice) AS BIGINT) AS amount, o_orderstatus AS st, o_orderpriority AS pr,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS pos, {_case(KINDS, "o_orderpriority")} AS kind, {_case(SELLERS, "o_orderstatus")} AS seller, {_case(BUYERS, "o_orderpriority")} AS buyer,
    c_nationkey AS nk, c_mktsegment AS seg, CAST(floor(c_acctbal) AS BIGINT) AS bal, n_name, r_name, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS sub
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
d AS (SELECT t.*, CASE st WHEN 'O' THEN day + 4000 ELSE day END AS registered, 10 * amount AS paid, 1000 * bal AS guide, CAST(floor(amount * 0.66) AS BIGINT) AS duty, 500 + (case_id % 7) * 400 AS sqft
  FROM t QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY o_orderkey DESC) = 1)
"""


def _map(pairs: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), c)


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """``t`` of :data:`BASE`."""
    nation = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    who = load(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    o = load(spark, sf, "orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("case_id"), "o_orderkey", F.to_date("o_orderdate").alias("day"), F.floor("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"),
        F.row_number().over(w).alias("pos"), _map(KINDS, F.col("o_orderpriority")).alias("kind"), _map(SELLERS, F.col("o_orderstatus")).alias("seller"), _map(BUYERS, F.col("o_orderpriority")).alias("buyer"),
        F.col("c_nationkey").alias("nk"), F.col("c_mktsegment").alias("seg"), F.floor("c_acctbal").alias("bal"), "n_name", "r_name", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("sub"),
    )


def last_rows(t: DataFrame) -> DataFrame:
    """``d`` of :data:`BASE`."""
    w = Window.partitionBy("case_id").orderBy(F.desc("o_orderkey"))
    d = t.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return d.withColumns({
        "registered": F.when(F.col("st") == "O", F.date_add("day", 4000)).otherwise(F.col("day")), "paid": 10 * F.col("amount"), "guide": 1000 * F.col("bal"),
        "duty": F.floor(F.col("amount") * 0.66), "sqft": 500 + (F.col("case_id") % 7) * 400,
    })


def _day(c: Column) -> Column:
    return F.date_format(c, "dd-MM-yyyy")


def _text(c: Column) -> Column:
    return c.cast("string")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Four records per case as JSON."""
    t = rows(spark, sf)
    d = last_rows(t)
    survey = F.concat(_text(F.col("nk") + 100), F.lit("/"))
    line = F.struct(
        F.col("pos").alias("row_number"), _day(F.col("day")).alias("date"), _text(F.col("o_orderkey")).alias("document_number"), _text(F.year("day")).alias("document_year"), F.col("kind").alias("transaction_type"),
        F.col("seller").alias("seller_or_executant"), F.col("buyer").alias("buyer_or_claimant"), _text(F.col("amount")).alias("consideration_amount"), F.concat(survey, _text(F.col("sub"))).alias("survey_number"),
        F.concat(F.lit("EC-"), _text(F.col("o_orderkey"))).alias("transaction_id"), F.concat(F.lit("Plot "), _text(F.col("case_id") % 50)).alias("plot_number"),
    )
    ec = t.groupBy("case_id").agg(
        F.to_json(F.struct(
            F.concat(F.lit("EC"), _text(F.first("case_id"))).alias("ec_number"), _day(F.min("day")).alias("period_from"), _day(F.max("day")).alias("period_to"), F.first("n_name").alias("village"), F.first("r_name").alias("taluk"),
            F.concat(_text(F.first("nk") + 100), F.lit("/1")).alias("survey_number"), F.array_sort(F.collect_list(line)).alias("transactions"),
        )).alias("data")
    )
    person = lambda name, age, pan: F.array(F.struct(name.alias("name"), _text(age).alias("age"), pan.alias("pan")))
    pan = lambda head, n: F.concat(F.lit(head), F.lpad(_text(n), 4, "0"), F.lit("K"))
    deed = d.select("case_id", F.to_json(F.struct(
        _text(F.col("o_orderkey")).alias("document_number"), _day(F.col("registered")).alias("registration_date"), F.lit("Adyar").alias("sro"),
        person(F.col("seller"), F.col("nk") * 6, pan("ABCDE", F.col("case_id") % 10000)).alias("seller"), person(F.col("buyer"), F.col("nk") + 20, F.when(F.col("sub") == 3, F.lit("12345")).otherwise(pan("PQRST", F.col("case_id") % 10000))).alias("buyer"),
        F.struct(F.concat(survey, F.lit("1")).alias("survey_number"), F.col("n_name").alias("village"), F.col("r_name").alias("taluk"), F.when(F.col("sub") == 1, "Chennai").otherwise("Salem").alias("district"), F.concat(_text(F.col("sqft")), F.lit(" sqft")).alias("extent"),
                 F.concat(F.lit("Plot "), _text(F.col("case_id") % 40)).alias("plot_number"), F.struct(F.lit("house of Ravi").alias("north"), F.when(F.col("sub") == 1, "canal").otherwise("land of Mani").alias("south")).alias("boundaries")).alias("property"),
        F.struct(_text(F.col("paid")).alias("consideration_amount"), _text(F.col("guide")).alias("guideline_value"), _text(F.col("duty")).alias("stamp_duty"), F.lit("50").alias("registration_fee")).alias("financials"),
        F.struct(F.lit("01-01-1990").alias("document_date"), F.lit("Ponni").alias("previous_owner"), F.lit("Gift").alias("acquisition_mode")).alias("previous_ownership"),
    )).alias("data"))
    patta = d.select("case_id", F.to_json(F.struct(
        _text(F.col("case_id")).alias("patta_number"), F.col("n_name").alias("village"), F.when(F.col("sub") == 2, F.lit("Elsewhere")).otherwise(F.col("r_name")).alias("taluk"), F.array(F.struct(F.when(F.col("sub") == 1, F.col("seller")).when(F.col("sub") == 2, F.col("buyer")).otherwise("Ponni").alias("name"))).alias("owner_names"),
        F.array(F.struct(F.concat(survey, F.lit("1")).alias("survey_no"), F.concat(_text(F.col("sqft") + F.col("nk") * 10), F.lit(" sqft")).alias("extent"))).alias("survey_numbers"), F.concat(_text(F.col("sqft") * 2), F.lit(" sqft")).alias("total_extent"),
    )).alias("data"))
    fmb = d.select("case_id", F.to_json(F.struct(F.concat(survey, F.lit("1")).alias("survey_number"), F.struct(F.lit("temple road").alias("north"), F.lit("canal").alias("south")).alias("boundaries"))).alias("data"))
    out = None
    for i, (kind, part) in enumerate((("EC", ec), ("SALE_DEED", deed), ("PATTA", patta), ("FMB", fmb))):
        own = part.select("case_id", F.lit(i).alias("doc_ord"), F.lit(f"{kind.lower()}.pdf").alias("filename"), F.lit(kind).alias("document_type"), "data")
        out = own if out is None else out.unionByName(own)
    return out


def tables(spark: SparkSession, sf: str) -> CaseTables:
    return CaseTables(documents(spark, sf))
