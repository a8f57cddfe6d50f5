"""Queries over the driver's tables, and the SQL that states the same result.

The tables are generic; each query runs an operator of the package on the table
that is nearest in shape. ``SQL`` is for DuckDB and has the same columns.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import document_age, parse_amount, parse_date, suspiciously_round
from ..operators import chain, chunking, classify, facts, identity, pages, retrieval, scoring, sequences
from ..sources.tables import load
from ..streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The day that ages are measured at: all results are repeatable.
AS_OF = "2001-08-01"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _date(c: str) -> F.Column:
    return F.to_date(F.col(c))


# --- text ---------------------------------------------------------------

_QUALITY = r"""
SELECT doc_id, source, chars AS char_count, words AS word_count, cids AS cid_count,
  CASE WHEN chars < 50 OR cid_chars / greatest(chars, 1) > 0.15 OR words < 10 THEN 'LOW' ELSE 'HIGH' END AS quality
FROM (
  SELECT doc_id, source, CAST(length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS INTEGER) AS chars,
    CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS words,
    CAST(len(regexp_extract_all(text, '\(cid:[0-9]+\)')) AS INTEGER) AS cids,
    coalesce(list_sum(list_transform(regexp_extract_all(text, '\(cid:[0-9]+\)'), lambda x: length(x))), 0) AS cid_chars
  FROM documents
)
"""


@query(_QUALITY)
def page_quality(spark: SparkSession, sf: str) -> DataFrame:
    q = load(spark, sf, "documents").select("doc_id", "source", pages.page_quality(F.col("text")).alias("q"))
    return q.select("doc_id", "source", "q.char_count", "q.word_count", "q.cid_count", "q.quality")


@query(f"""
SELECT source, CASE WHEN bool_and(quality = 'LOW') THEN 'LOW' WHEN bool_and(quality = 'HIGH') THEN 'HIGH' ELSE 'MIXED' END AS quality, count(*) AS n_pages
FROM ({_QUALITY}) GROUP BY source
""")
def quality_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return page_quality(spark, sf).groupBy("source").agg(pages.rollup(F.col("quality")).alias("quality"), F.count("*").alias("n_pages"))


@query(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\(cid:[0-9]+\)', '', 'g'), '[^\S\n]+', ' ', 'g'), '\n\s*\n', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS cleaned
FROM documents
""")
def cid_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.md5(pages.strip_cid(F.col("text")).cast("binary")).alias("cleaned"))


@query()
def repeat_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: DuckDB's patterns have no back-references; tested by brute force."""
    return load(spark, sf, "documents").select("doc_id", F.length(pages.collapse_repetitions(F.col("text"))).alias("n_chars_left"))


@query(r"""
WITH w AS (
  SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents)
), k AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, w ORDER BY pos) AS k FROM w
)
SELECT doc_id, count(*) AS n_words, md5(string_agg(w, ' ' ORDER BY pos)) AS capped FROM k WHERE n < 30 OR k <= 6 OR length(w) < 3 GROUP BY doc_id
""")
def token_cap(spark: SparkSession, sf: str) -> DataFrame:
    capped = load(spark, sf, "documents").select("doc_id", pages.cap_tokens(F.col("text")).alias("text"))
    return capped.select("doc_id", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n_words"), F.md5(F.col("text").cast("binary")).alias("capped"))


_KINDS = (("SECRET", r"token|password"), ("LICENSE", r"licen[sc]e|copyright"), ("EN", " the | and "), ("DE", " und | die "), ("FR", " les | des "), ("ES", " los | que "))
_KIND_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i)(?:{p})') THEN '{k}' END" for k, p in _KINDS) + "], lambda k: k IS NOT NULL)"
_KIND_SQL = f"CASE WHEN list_contains({_KIND_SQL}, 'SECRET') THEN list_filter({_KIND_SQL}, lambda k: k <> 'LICENSE') ELSE {_KIND_SQL} END"


def _kinds(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    return docs.withColumn("found", classify.prefer(classify.matches(F.col("text"), _KINDS), "SECRET", "LICENSE"))


@query(f"""
SELECT doc_id, array_to_string(found, ',') AS found, CASE WHEN len(found) = 1 THEN found[1] END AS kind, CASE WHEN len(found) = 1 THEN 0.85::DOUBLE END AS confidence
FROM (SELECT doc_id, {_KIND_SQL} AS found FROM documents)
""")
def keyword_classify(spark: SparkSession, sf: str) -> DataFrame:
    single = F.size("found") == 1
    return _kinds(spark, sf).select("doc_id", F.array_join("found", ",").alias("found"), F.when(single, F.get("found", 0)).alias("kind"), F.when(single, F.lit(classify.SINGLE)).alias("confidence"))


@query(f"""
SELECT lang, count(*) AS n_docs, count(*) FILTER (len(found) = 1 AND lower(found[1]) <> lang) AS n_disagree
FROM (SELECT lang, {_KIND_SQL} AS found FROM documents) GROUP BY lang
""")
def classify_disagree(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.size("found") == 1, F.lower(F.get("found", 0)))
    return _kinds(spark, sf).groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if(classify.retry(kind, F.col("lang"))).alias("n_disagree"))


@query(f"""
SELECT source, doc_id, quality FROM (
  SELECT source, doc_id, quality, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN quality = 'HIGH' THEN 0 ELSE 1 END, doc_id) AS n FROM ({_QUALITY})
) WHERE n <= 2
""")
def best_pages_topn(spark: SparkSession, sf: str) -> DataFrame:
    rows = page_quality(spark, sf).withColumn("extraction_method", F.lit("pdfplumber"))
    return pages.best_pages(rows, ["source"], 2, page="doc_id").select("source", "doc_id", "quality")


@query(r"""
SELECT page_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]+>', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g') AS t
  FROM pages
)
""")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    t = load(spark, sf, "pages").select("page_id", pages.html_text(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("text"))


@query()
def html_pages(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", F.size(pages.html_pages(F.col("html"))).alias("n_parts"))


@query(f"""
WITH q AS ({_QUALITY.replace("FROM documents", "FROM (SELECT doc_id, 'a' AS source, text FROM documents)")}),
b AS ({_QUALITY.replace("FROM documents", "FROM (SELECT item_id AS doc_id, 'b' AS source, text FROM benchmark)")})
SELECT coalesce(q.doc_id, b.doc_id) AS page, CASE WHEN w THEN b.quality ELSE q.quality END AS quality, w AS from_second
FROM (
  SELECT q.doc_id AS qid, b.doc_id AS bid, CASE WHEN b.doc_id IS NULL THEN false WHEN q.doc_id IS NULL THEN true WHEN b.quality = 'HIGH' AND q.quality = 'LOW' THEN true
    WHEN b.char_count > q.char_count * 1.3 AND b.char_count > 50 THEN true ELSE false END AS w
  FROM q FULL JOIN b ON q.doc_id = b.doc_id
) m LEFT JOIN q ON q.doc_id = m.qid LEFT JOIN b ON b.doc_id = m.bid
""")
def page_merge_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "documents").select(F.col("doc_id").alias("page"), "text")
    b = load(spark, sf, "benchmark").select(F.col("item_id").alias("page"), "text")
    return pages.merge_pages(a, b, ["page"]).select("page", "quality", "from_second")


# --- chunks -------------------------------------------------------------


@query("""
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(length(c) AS INTEGER) AS n_chars, md5(c) AS chunk FROM (
  SELECT doc_id, i, substring(text, CAST(i * 800 + 1 AS BIGINT), 1000) AS c FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 800.0) AS BIGINT))) AS i FROM documents)
) WHERE length(trim(c)) >= 50
""")
def char_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "documents").select("doc_id", F.explode(chunking.char_chunks(F.col("text"), 1000, 200)).alias("c"))
    return c.select("doc_id", "c.chunk_index", F.length("c.chunk").alias("n_chars"), F.md5(F.col("c.chunk").cast("binary")).alias("chunk"))


@query("""
SELECT source, CAST(floor((n - 1) / 20) AS INTEGER) AS chunk_index, count(*) AS n_pages, md5(string_agg(text, chr(10) ORDER BY n)) AS chunk
FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) GROUP BY ALL
""")
def page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    rows = load(spark, sf, "documents").select("source", "text", n.alias("n"))
    return chunking.page_groups(rows, ["source"], "n", "text", 20).withColumn("chunk", F.md5(F.col("chunk").cast("binary")))


@query("""
SELECT doc_id, CAST(n AS INTEGER) AS turn_no, md5(CASE WHEN p IS NULL THEN text ELSE right(p, 500) || chr(10) || text END) AS chunk
FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents)
""")
def chunk_overlap(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    rows = load(spark, sf, "documents").select("doc_id", "source", "text", n.alias("turn_no"))
    return chunking.with_tail(rows, ["source"], "turn_no", "text").select("doc_id", "turn_no", F.md5(F.col("text").cast("binary")).alias("chunk"))


@query(r"""
SELECT doc_id, CAST(segment - 1 AS INTEGER) AS segment, CAST(sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY segment) - length(body) - 1 - CASE WHEN segment = 1 THEN 0 ELSE 1 END AS BIGINT) AS offset_at,
  CAST(length(body) + CASE WHEN segment = 1 THEN 0 ELSE 1 END AS INTEGER) AS n_chars
FROM (SELECT doc_id, unnest(s) AS body, generate_subscripts(s, 1) AS segment FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))
""")
def semantic_segments(spark: SparkSession, sf: str) -> DataFrame:
    s = chunking.segments(load(spark, sf, "documents"), "doc_id", "text", "\n")
    return s.select("doc_id", "segment", F.col("offset").cast("long").alias("offset_at"), F.length("body").alias("n_chars"))


@query("""
SELECT doc_id, n_chars, used FROM (SELECT doc_id, source, n_chars, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents) WHERE used <= 30000
""")
def evidence_budget(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.within_budget(load(spark, sf, "documents"), ["source"], "doc_id", F.col("n_chars"), 30_000).select("doc_id", "n_chars", "used")


# --- retrieval ----------------------------------------------------------

_TOKENS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_/.-]{{3,}}'))"


@query(rf"""
WITH k AS (SELECT item_id, {_TOKENS.format("text")} AS kw FROM benchmark)
SELECT item_id, doc_id, round(list_sum(list_transform(kw, lambda w: CASE WHEN contains(lower(text), w) THEN 1 ELSE 0 END * CASE WHEN regexp_matches(w, '[0-9]') THEN 2 ELSE 1 END))
  / list_sum(list_transform(kw, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN 2.0 ELSE 1.0 END)), 6)::DOUBLE AS score
FROM k JOIN documents ON true
""")
def keyword_score(spark: SparkSession, sf: str) -> DataFrame:
    """Every passage against every document."""
    asked = load(spark, sf, "benchmark").select("item_id", retrieval.keywords(F.col("text")).alias("kw"))
    scored = retrieval.keyword_scores(asked, load(spark, sf, "documents").select("doc_id", F.lower("text").alias("low")))
    return scored.withColumn("score", F.round("score", 6))


_NEAREST = """
SELECT query_id, chunk_id, label, round(distance, 6) AS distance, rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label, q.label AS query_label, 1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS distance,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), c.vec_id) AS INTEGER) AS rank
  FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id {0}
) WHERE rank <= {1}
"""


def _nearest(spark: SparkSession, sf: str, k: int, same_label: bool = False) -> DataFrame:
    e = load(spark, sf, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("label").alias("query_label"))
    rows = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "label")
    if same_label:
        asked = asked.withColumnRenamed("query_label", "label")
        met = asked.join(rows, "label").where("query_id <> chunk_id").withColumn("distance", 1 - retrieval.cosine(F.col("query_vec"), F.col("vec")))
        order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return retrieval.top_k(asked, rows, k, max_distance=3.0)


@query(_NEAREST.format("", 10))
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf, 10).select("query_id", "chunk_id", "label", F.round("distance", 6).alias("distance"), "rank")


@query(_NEAREST.format("AND q.label = c.label", 5))
def filtered_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf, 5, same_label=True).select("query_id", "chunk_id", "label", F.round("distance", 6).alias("distance"), "rank")


@query(f"""
SELECT query_label, chunk_id, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY query_label ORDER BY distance, chunk_id) AS INTEGER) AS merged_rank FROM (
  SELECT query_label, chunk_id, min(distance) AS distance FROM ({_NEAREST.format("", 10).replace("SELECT query_id, chunk_id, label, round(distance, 6) AS distance, rank", "SELECT query_label, chunk_id, distance")}) GROUP BY ALL
) QUALIFY merged_rank <= 25
""")
def multi_query_dedup(spark: SparkSession, sf: str) -> DataFrame:
    merged = retrieval.merge_hits(_nearest(spark, sf, 10), "query_label", "chunk_id", "distance")
    return merged.select("query_label", "chunk_id", F.round("distance", 6).alias("distance"), "merged_rank")


@query(rf"""
WITH n AS ({_NEAREST.format("", 20).replace("round(distance, 6) AS distance", "distance")}),
s AS (
  SELECT n.query_id, n.chunk_id, n.distance, list_sum(list_transform(kw, lambda w: CASE WHEN contains(lower(d.text), w) THEN 1 ELSE 0 END * CASE WHEN regexp_matches(w, '[0-9]') THEN 2 ELSE 1 END))
    / list_sum(list_transform(kw, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN 2.0 ELSE 1.0 END)) AS kw
  FROM n JOIN documents d ON d.doc_id = n.chunk_id JOIN (SELECT doc_id, {_TOKENS.format("text")} AS kw FROM documents) q ON q.doc_id = n.query_id
)
SELECT query_id, chunk_id, round(greatest(0, distance - 0.15 * kw), 6)::DOUBLE AS hybrid FROM s
""")
def hybrid_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords of the asking document's whole text."""
    docs = load(spark, sf, "documents")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), retrieval.keywords(F.col("text")).alias("kw"))
    hits = _nearest(spark, sf, 20).select("query_id", "chunk_id", "distance")
    # lower case below the join: once a text, not once a keyword
    met = hits.join(docs.select(F.col("doc_id").alias("chunk_id"), F.lower("text").alias("low")), "chunk_id").join(asked, "query_id")
    return met.select("query_id", "chunk_id", F.round(retrieval.rerank(F.col("distance"), retrieval.keyword_share(F.col("kw"), F.col("low"))), 6).alias("hybrid"))


@query()
def mmr_select(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: a greedy choice; tested by brute force."""
    hits = _nearest(spark, sf, 15).withColumn("relevance", 1 - F.col("distance"))
    return retrieval.mmr(hits, 5, 0.6)


# --- sequences ----------------------------------------------------------

_GAPS = """
SELECT o_custkey, o_orderkey, CAST(date_diff('day', p, d) AS INTEGER) AS gap_days FROM (
  SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS p FROM orders
)
"""
_FLIP = f"SELECT o_custkey, o_orderkey, gap_days, CASE WHEN gap_days < 180 THEN 'FAIL' ELSE 'WARNING' END AS status FROM ({_GAPS}) WHERE gap_days < 365"


@query(_FLIP)
def rapid_flip(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").select("o_custkey", "o_orderkey", _date("o_orderdate").alias("d"))
    g = sequences.gaps(rows, ["o_custkey"], "d", ["o_orderkey"])
    return g.select("o_custkey", "o_orderkey", "gap_days", sequences.gap_tier(F.col("gap_days")).alias("status")).where("status is not null")


@query("""
SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, last_value(ts IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM events) WHERE ts < p
""")
def out_of_order(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.out_of_order(load(spark, sf, "events"), ["user_id"], "ts", ["event_id"]).select("user_id", "event_id")


@query("""
SELECT o_custkey, o_orderkey, round(greatest(o_totalprice / p, p / o_totalprice), 4) AS ratio FROM (
  SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders WHERE o_totalprice > 0
) WHERE greatest(o_totalprice / p, p / o_totalprice) >= 10
""")
def scale_jump(spark: SparkSession, sf: str) -> DataFrame:
    j = sequences.scale_jumps(load(spark, sf, "orders"), ["o_custkey"], "o_totalprice", ["o_orderkey"])
    return j.select("o_custkey", "o_orderkey", F.round("ratio", 4).alias("ratio"))


@query(f"""
SELECT o_orderkey, CAST(n AS INTEGER) AS days, round(n / 365.25, 1)::DOUBLE AS years, n > 12 * 365 AS beyond_limitation FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS n FROM orders)
""")
def document_ages(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "orders").select("o_orderkey", document_age(_date("o_orderdate"), F.lit(AS_OF).cast("date")).alias("a"))
    return a.select("o_orderkey", "a.days", "a.years", "a.beyond_limitation")


@query("""
SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 60 AS e FROM orders) o ON l.l_orderkey = o.o_orderkey
WHERE CAST(l.l_shipdate AS DATE) < s OR CAST(l.l_shipdate AS DATE) > e
""")
def range_violation(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select(F.col("l_orderkey"), "l_linenumber", _date("l_shipdate").alias("at"))
    spans = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), _date("o_orderdate").alias("s"), F.date_add(_date("o_orderdate"), 60).alias("e"))
    return sequences.outside(lines, spans, "l_orderkey", "at", "s", "e").select("l_orderkey", "l_linenumber")


# --- signs of fabrication ----------------------------------------------


@query("""
SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE r) AS n_round FROM (
  SELECT o_custkey, CASE WHEN a >= 100000 THEN a % 100000 = 0 ELSE a > 0 AND a % 10000 = 0 END AS r FROM (SELECT o_custkey, round(o_totalprice / 1000) * 1000 AS a FROM orders)
) GROUP BY o_custkey
""")
def round_amounts(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "orders").select("o_custkey", suspiciously_round(F.round(F.col("o_totalprice") / 1000) * 1000).alias("r"))
    return a.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if("r").alias("n_round"))


@query("""
SELECT o_orderkey, l_linenumber, abs(o_totalprice - l_extendedprice) / greatest(o_totalprice, l_extendedprice) > 0.05 AS mismatch FROM (
  SELECT o_orderkey, o_totalprice, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey
) WHERE n = 1
""")
def first_match_join(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    li = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    m = sequences.first_match(o, li, ["o_orderkey"], ["o_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])
    return m.select("o_orderkey", "l_linenumber", (sequences.relative_difference(F.col("o_totalprice"), F.col("l_extendedprice")) > 0.05).alias("mismatch"))


@query("""
WITH s AS (SELECT l_orderkey, l_suppkey, list(DISTINCT l_returnflag) AS m FROM lineitem GROUP BY ALL)
SELECT a.l_orderkey, a.l_suppkey AS owner_a, b.l_suppkey AS owner_b FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey WHERE NOT list_has_any(a.m, b.m)
""")
def disjoint_sets(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.disjoint_pairs(load(spark, sf, "lineitem"), ["l_orderkey"], "l_suppkey", "l_returnflag")


@query("""
SELECT a.s_nationkey, a.s_suppkey AS pos_a, b.s_suppkey AS pos_b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey
WHERE abs(abs(a.s_acctbal) - abs(b.s_acctbal)) / greatest(abs(a.s_acctbal), abs(b.s_acctbal)) > 0.1
""")
def area_pairwise(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "supplier").select("s_nationkey", "s_suppkey", F.abs("s_acctbal").alias("v"))
    return sequences.pairwise(rows, ["s_nationkey"], "s_suppkey", "v", 0.10).select("s_nationkey", "pos_a", "pos_b")


# --- facts --------------------------------------------------------------

_FACTS = """
SELECT category, key, value, source_file, source_type, nation FROM (
  SELECT unnest(['party', 'financial', 'reference']) AS category, unnest(['name', 'segment', 'nation']) AS key, unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS value,
    CAST(c_custkey AS VARCHAR) AS source_file, 'customer' AS source_type, c_nationkey AS nation FROM customer
  UNION ALL
  SELECT unnest(['party', 'reference']), unnest(['name', 'nation']), unnest([s_name, CAST(s_nationkey AS VARCHAR)]), CAST(s_suppkey AS VARCHAR), 'supplier', s_nationkey FROM supplier
) WHERE value IS NOT NULL AND trim(value) <> ''
"""


@query(_FACTS)
def facts_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    c, s = load(spark, sf, "customer"), load(spark, sf, "supplier")
    a = facts.unpivot(c.withColumn("nation", F.col("c_nationkey")), F.col("c_custkey"), "customer", [("party", "name", F.col("c_name")), ("financial", "segment", F.col("c_mktsegment")), ("reference", "nation", F.col("c_nationkey"))], ["nation"])
    b = facts.unpivot(s.withColumn("nation", F.col("s_nationkey")), F.col("s_suppkey"), "supplier", [("party", "name", F.col("s_name")), ("reference", "nation", F.col("s_nationkey"))], ["nation"])
    return a.unionByName(b).select("category", "key", "value", "source_file", "source_type", "nation")


@query(f"SELECT category, count(*) AS n_facts FROM ({_FACTS}) GROUP BY ROLLUP (category)")
def fact_summary_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return facts.summary(facts_unpivot(spark, sf), ["category"])


@query(f"""
SELECT nation, category, key, count(DISTINCT source_file) AS n_sources, count(DISTINCT lower(trim(value))) AS n_values, count(DISTINCT lower(trim(value))) = 1 AS consistent
FROM ({_FACTS}) GROUP BY ALL HAVING count(DISTINCT source_file) > 1
""")
def cross_refs(spark: SparkSession, sf: str) -> DataFrame:
    return facts.cross_references(facts_unpivot(spark, sf), ["nation"])


@query(f"""
SELECT nation, category, key, count(*) AS n_values, string_agg(v || '=' || n, ';' ORDER BY v) AS conflicting_values FROM (
  SELECT nation, category, key, lower(trim(value)) AS v, count(DISTINCT source_file) AS n FROM ({_FACTS}) GROUP BY ALL
) GROUP BY ALL HAVING count(*) > 1
""")
def fact_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Conflicts of every key."""
    return facts.conflicts(facts_unpivot(spark, sf), ["nation"])


# --- names --------------------------------------------------------------


@query("""
WITH w AS (SELECT DISTINCT p_partkey, p_brand, left(unnest(string_split(lower(p_name), ' ')), 1) AS block FROM part)
SELECT block, p_brand, count(DISTINCT p_partkey) AS n_parts FROM w WHERE block <> '' GROUP BY ALL
""")
def party_blocking(spark: SparkSession, sf: str) -> DataFrame:
    k = load(spark, sf, "part").select("p_partkey", "p_brand", F.explode(identity.block_keys(F.col("p_name"))).alias("block"))
    return k.groupBy("block", "p_brand").agg(F.countDistinct("p_partkey").alias("n_parts"))


@query("""
SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE levenshtein(a.p_name, b.p_name) <= 6
""")
def levenshtein_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of parts of a brand and size whose names are near; a group's names are compared once each, however many parts bear them."""
    p = load(spark, sf, "part").select("p_brand", "p_size", "p_partkey", "p_name")
    names = p.select("p_brand", "p_size", "p_name").distinct()
    both = names.toDF("p_brand", "p_size", "na").join(names.toDF("p_brand", "p_size", "nb"), ["p_brand", "p_size"]).where("abs(length(na) - length(nb)) <= 6")
    near = both.withColumn("distance", F.levenshtein("na", "nb", 6)).where("distance >= 0")
    of = p.toDF("p_brand", "p_size", "a", "na").join(near, ["p_brand", "p_size", "na"])
    return of.join(p.toDF("p_brand", "p_size", "b", "nb"), ["p_brand", "p_size", "nb"]).where("a < b").select("a", "b", "distance")


@query()
def name_similarities(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: matching blocks; tested against the plain function."""
    p = load(spark, sf, "part").select(F.col("p_brand").alias("case_id"), "p_partkey", "p_name")
    return identity.pairs(p, "case_id", "p_partkey", "p_name").where("similarity >= 0.5").select("case_id", "a", "b", F.round("similarity", 6).alias("similarity"))


@query()
def identity_clusters(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").select(F.concat_ws("-", "p_brand", "p_size").alias("case_id"), "p_partkey", "p_name")
    return identity.clusters(p, "case_id", "p_partkey", "p_name")


# --- chain --------------------------------------------------------------

_EDGES = """
SELECT case_id, date, seller, buyer, transaction_type, document_number, notes, source FROM (
  SELECT l_partkey AS case_id, CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS seller, CAST(l_orderkey AS VARCHAR) AS buyer, CASE WHEN l_returnflag = 'R' THEN 'RELEASE' ELSE 'SALE' END AS transaction_type,
    CAST(l_orderkey AS VARCHAR) AS document_number, l_linestatus || l_linenumber AS notes, l_linestatus AS source FROM lineitem
)
"""
_ONE_EDGE = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, document_number || '|' || transaction_type || '|' || lower(buyer) ORDER BY date IS NULL, length(notes) DESC, source, date, seller) AS n FROM ({_EDGES})) WHERE n = 1
"""


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "release").otherwise("sale")
    s = lambda c: F.col(c).cast("string")
    return chain.links(li, F.col("l_partkey"), _date("l_shipdate"), s("l_suppkey"), s("l_orderkey"), kind, s("l_orderkey"), F.concat("l_linestatus", "l_linenumber"), F.col("l_linestatus"))


@query(f"SELECT transaction_type, source, count(*) AS n_links, count(DISTINCT case_id) AS n_cases FROM ({_ONE_EDGE}) GROUP BY ALL")
def chain_union_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return chain.dedup(_edges(spark, sf)).groupBy("transaction_type", "source").agg(F.count("*").alias("n_links"), F.countDistinct("case_id").alias("n_cases"))


@query(f"""
SELECT case_id, seller, buyer, transaction_type, CAST(row_number() OVER (PARTITION BY case_id ORDER BY date NULLS LAST, document_number, seller, buyer, transaction_type) AS INTEGER) AS sequence FROM ({_ONE_EDGE})
""")
def chain_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return chain.number(chain.dedup(_edges(spark, sf))).select("case_id", "seller", "buyer", "transaction_type", "sequence")


@query("""
SELECT user_id, event_type, event_id, first_pos FROM (
  SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY length(props) DESC, event_id) AS r, min(event_id) OVER (PARTITION BY user_id, event_type) AS first_pos FROM events
) WHERE r = 1
""")
def txn_dedup_richest(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.richest(load(spark, sf, "events"), ["user_id", "event_type"], F.length("props"), "event_id").select("user_id", "event_type", "event_id", "first_pos")


@query("""
SELECT o_orderkey, b || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS transaction_id FROM (SELECT o_orderkey, b, row_number() OVER (PARTITION BY b ORDER BY o_orderkey) AS n FROM (SELECT o_orderkey, o_custkey || '/' || year(o_orderdate) AS b FROM orders))
""")
def txn_id_collision(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select("o_orderkey", F.concat_ws("/", "o_custkey", F.year("o_orderdate")).alias("b"))
    return sequences.numbered_ids(o, "b", "o_orderkey").select("o_orderkey", "transaction_id")


# --- scoring ------------------------------------------------------------

_CHECKS = f"""
SELECT o_custkey AS case_id, o_orderkey AS pos, 'DET_RAPID_FLIPPING' AS rule_code, 'HIGH' AS severity, status, 'gap ' || gap_days AS evidence, 'deterministic' AS source FROM ({_FLIP})
UNION ALL
SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'RAPID_FLIPPING' ELSE 'PRICE' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'CRITICAL' ELSE 'MEDIUM' END,
  CASE WHEN o_totalprice > 300000 THEN 'FAIL' WHEN o_totalprice > 200000 THEN 'WARNING' ELSE 'PASS' END, o_orderpriority, 'llm' FROM orders
"""


def _checks(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["case_id", "pos", "rule_code", "severity", "status", "evidence", "source"]
    det = rapid_flip(spark, sf).select("o_custkey", "o_orderkey", F.lit("DET_RAPID_FLIPPING"), F.lit("HIGH"), "status", F.concat(F.lit("gap "), "gap_days"), F.lit("deterministic"))
    first = F.col("o_orderpriority").startswith("1")
    status = F.when(F.col("o_totalprice") > 300_000, "FAIL").when(F.col("o_totalprice") > 200_000, "WARNING").otherwise("PASS")
    judged = load(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.when(first, "RAPID_FLIPPING").otherwise("PRICE"), F.when(first, "CRITICAL").otherwise("MEDIUM"), status, "o_orderpriority", F.lit("llm")
    )
    return det.toDF(*cols).unionByName(judged.toDF(*cols))


_DEDUPED = f"SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY case_id, rule_code ORDER BY length(evidence) DESC, pos) AS n FROM ({_CHECKS})) WHERE n = 1"


def _deduped(spark: SparkSession, sf: str) -> DataFrame:
    rows = _checks(spark, sf).withColumns({"guardrail_warnings": F.array().cast("array<string>"), "verified": F.lit(False)})
    return scoring.dedup(rows, ["case_id"]).drop("guardrail_warnings", "verified")


@query(_DEDUPED)
def check_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _deduped(spark, sf)


_SUPERSEDED = f"""
SELECT c.case_id, c.rule_code, c.severity, CASE WHEN c.source <> 'deterministic' AND c.rule_code = 'RAPID_FLIPPING' AND c.status = 'FAIL' AND d.case_id IS NOT NULL THEN 'SUPERSEDED' ELSE c.status END AS status, c.source
FROM ({_DEDUPED}) c LEFT JOIN (SELECT case_id FROM ({_DEDUPED}) WHERE source = 'deterministic' AND status IN ('FAIL', 'PASS')) d ON c.case_id = d.case_id
"""


@query(_SUPERSEDED)
def supersede(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.supersede(_deduped(spark, sf), ["case_id"]).select("case_id", "rule_code", "severity", "status", "source")


_POINTS = "CASE WHEN status = 'FAIL' THEN CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 8 WHEN 'MEDIUM' THEN 3 ELSE 1 END WHEN status = 'WARNING' THEN 1 ELSE 0 END"


@query(f"""
SELECT case_id, d AS deduction, 100 - d AS score, CASE WHEN 100 - d >= 80 THEN 'LOW' WHEN 100 - d >= 50 THEN 'MEDIUM' WHEN 100 - d >= 20 THEN 'HIGH' ELSE 'CRITICAL' END AS band FROM (
  SELECT case_id, CAST(least(100, greatest(sum({_POINTS}), CASE WHEN count(*) FILTER (status = 'FAIL' AND severity = 'CRITICAL') >= 2 THEN 81 WHEN count(*) FILTER (status = 'FAIL' AND severity = 'CRITICAL') = 1 THEN 51 ELSE 0 END)) AS BIGINT) AS d
  FROM ({_SUPERSEDED}) GROUP BY case_id
)
""")
def score_bands(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: rules, deduplication, superseding, score and band of every case."""
    return scoring.score(supersede(spark, sf), ["case_id"])


@query(f"""
SELECT source, rule_code, count(*) AS n_checks, count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'WARNING') AS n_warning, count(*) FILTER (status = 'PASS') AS n_pass, CAST(sum({_POINTS}) AS BIGINT) AS deduction
FROM ({_SUPERSEDED}) GROUP BY ROLLUP (source, rule_code)
""")
def group_summary(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.group_summary(supersede(spark, sf), ["source", "rule_code"])


_REGISTRY = [("R1", [["en"]]), ("R2", [["de", "fr"], ["es", "en"]]), ("R3", [["it"], ["en", "pt"]]), ("R4", [])]
_AVAILABLE = "SELECT source, list_sort(list(DISTINCT lang)) AS available FROM documents GROUP BY source"
_REGISTRY_SQL = "(VALUES ('R1', [['en']]), ('R2', [['de', 'fr'], ['es', 'en']]), ('R3', [['it'], ['en', 'pt']]), ('R4', CAST([] AS VARCHAR[][]))) r(rule_code, requires)"
_GATE_SQL = f"""
SELECT source, rule_code, len(requires) = 0 OR len(list_filter(requires, lambda g: list_has_all(available, g))) > 0 AS runnable FROM ({_AVAILABLE}) JOIN {_REGISTRY_SQL} ON true
"""


def _gate(spark: SparkSession, sf: str) -> DataFrame:
    registry = spark.createDataFrame(_REGISTRY, "rule_code string, requires array<array<string>>")
    cases = load(spark, sf, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("available"))
    return classify.gate(registry, cases)


@query(_GATE_SQL)
def registry_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _gate(spark, sf).select("source", "rule_code", "runnable")


@query(f"SELECT source, rule_code, 'NOT_APPLICABLE' AS status FROM ({_GATE_SQL}) WHERE NOT runnable")
def na_stubs(spark: SparkSession, sf: str) -> DataFrame:
    return _gate(spark, sf).where("not runnable").select("source", "rule_code", F.lit("NOT_APPLICABLE").alias("status"))


@query("""
WITH c AS (SELECT DISTINCT source, 'LANG_' || upper(lang) AS rule_code, 'PASS' AS status FROM documents WHERE lang IS NOT NULL), e AS (SELECT * FROM (SELECT DISTINCT source FROM documents) JOIN (VALUES ('LANG_EN'), ('LANG_IT')) v(rule_code) ON true)
SELECT * FROM c UNION ALL SELECT source, rule_code, 'NOT_APPLICABLE' FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.source = e.source AND c.rule_code = e.rule_code)
""")
def expected_padding(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    checks = d.where("lang is not null").select("source", F.concat(F.lit("LANG_"), F.upper("lang")).alias("rule_code"), F.lit("PASS").alias("status")).distinct()
    expected = d.select("source").distinct().withColumn("rule_code", F.explode(F.array(F.lit("LANG_EN"), F.lit("LANG_IT"))))
    return scoring.pad_expected(checks, expected, ["source"]).select("source", "rule_code", "status")


@query("""
SELECT item_id, count(*) AS n_docs FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id
""")
def gt_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Which passages stand, whole, in the documents."""
    return retrieval.passage_counts(load(spark, sf, "documents"), load(spark, sf, "benchmark"))


# --- conversations, events ---------------------------------------------


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def chat_tail(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.tail(load(spark, sf, "conversations"), ["conv_id"], "turn", 4).select("conv_id", "turn")


_FOLD = "SELECT user_id, event_type, count(*) AS n_events, round(sum(value), 4) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY ALL"


@query(_FOLD)
def progress_fold(spark: SparkSession, sf: str) -> DataFrame:
    return progress.fold(load(spark, sf, "events"), ["user_id", "event_type"]).withColumn("total", F.round("total", 4))


@query("""
SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS run, ts AS started FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events
) WHERE p IS NULL OR p <> event_type
""")
def stage_timings(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    return progress.stage_timings(e, "user_id", "event_type", "ts", "event_id").select("user_id", "event_type", "run", "started")


@query("SELECT user_id, arg_max(event_type, ts) AS last_type, max(ts) AS last_ts FROM events GROUP BY user_id")
def last_event(spark: SparkSession, sf: str) -> DataFrame:
    return progress.last_event(load(spark, sf, "events"), ["user_id"])


def _stream_folder(spark: SparkSession, name: str) -> str:
    """A folder for a stream's offsets and results: under the shared folder; a temporary one only on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster has to name spark.checkpoint.dir")
    return f"{shared.rstrip('/')}/{name}-{os.urandom(6).hex()}" if shared else "file://" + tempfile.mkdtemp(prefix=name)


def _streamed(spark: SparkSession, sf: str) -> DataFrame:
    schema = load(spark, sf, "events").schema
    return progress.stream(spark, sf, schema, "events.parquet")


@query(_FOLD)
def stream_progress_fold(spark: SparkSession, sf: str) -> DataFrame:
    folded = progress.fold(_streamed(spark, sf), ["user_id", "event_type"])
    return progress.run_to_end(folded, _stream_folder(spark, "fold")).withColumn("total", F.round("total", 4))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    return progress.run_to_end(progress.windows(_streamed(spark, sf)), _stream_folder(spark, "windows")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n_events", F.round("total", 4).alias("total"))


# --- patterns -----------------------------------------------------------


#: A number with digit groups (Indian or western), or plain; with decimals or without.
_AMOUNT = r"\b(?:[0-9]{1,3}(?:,[0-9]{2,3})*,[0-9]{3}|[0-9]+)(?:\.[0-9]+)?\b"


@query(rf"""
SELECT doc_id, list_max(list_transform(regexp_extract_all(text, '{_AMOUNT}'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE))) AS largest FROM documents
""")
def amount_extract_max(spark: SparkSession, sf: str) -> DataFrame:
    """Whole numbers of any length, digit groups included."""
    found = F.regexp_extract_all("text", F.lit(_AMOUNT), F.lit(0))
    return load(spark, sf, "documents").select("doc_id", F.array_max(F.transform(found, lambda x: parse_amount(x))).alias("largest"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed FROM orders")
def date_parse_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Dates written in five layouts, read back by the first that fits."""
    layouts = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "d MMM yyyy")
    k = F.pmod("o_orderkey", F.lit(len(layouts)))
    text = F.coalesce(*(F.when(k == i, F.date_format("o_orderdate", p)) for i, p in enumerate(layouts)))
    return load(spark, sf, "orders").select("o_orderkey", parse_date(text).alias("parsed"))
