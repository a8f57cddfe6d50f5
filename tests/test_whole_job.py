"""Queries that do more than their SQL states, against brute force on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from titleforge.llm import quality_classifier, secret_scan, toxicity
from titleforge.operators import retrieval
from titleforge.plans.driver_queries import QUERIES


def test_gt_verdict_looks_for_whole_passages(spark, tmp_path):
    long = "start " + "of a long passage with some words in it " * 3
    passages = [(3, long + "that ends so"), (41, "late item, whole"), (50, "two words"), (60, "not anywhere at all"), (70, None)]
    texts = ["x" + long + "that ends so, and on", long + "that ends otherwise", "a late item, wholesome", "late  item, whole", "two words and two words", None, "two words"]
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(i, sum(t in d for d in texts if d)) for i, t in passages if t}
    got = {tuple(r) for r in QUERIES["gt_verdict"](spark, str(tmp_path)).collect()}
    assert got == {w for w in want if w[1]} and {w[0] for w in got} == {3, 41, 50}


def test_keyword_score_takes_every_passage(spark, tmp_path):
    passages = [(1, "Survey 311/1 of the Owner"), (7, "ten men; AB-12 x"), (205, "வீடுகளின் owner"), (206, "? !"), (207, None)]
    texts = ["the OWNER often mentions survey\u00a0311/12", "(ab-12)", "வீடு", None, "", "the owner " * 300, "the owner"]
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i or None, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = spark.read.parquet(f"{tmp_path}/benchmark.parquet").select("item_id", retrieval.keywords(F.col("text")).alias("kw"))
    pairs = asked.crossJoin(spark.read.parquet(f"{tmp_path}/documents.parquet").withColumnRenamed("text", "t"))
    want = pairs.select("item_id", "doc_id", F.round(retrieval.keyword_score(F.col("kw"), F.col("t")), 6).alias("score")).collect()
    got = QUERIES["keyword_score"](spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 35 and len({r.score for r in got}) == 4


def test_amounts_are_read_whole(spark, tmp_path):
    texts = {"paid 45000 and 12": 45000.0, "Rs 1,23,456.75 of 999": 123456.75, "1,234,567 or 1234568": 1234568.0, "items 1,2,3": 3.0, "3.14159": 3.14159, "on 1,23,4567": 4567.0, "AB1234 only": None, "": None, "12, 500": 500.0, "card 4111111111111111.": 4111111111111111.0}
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.largest for r in QUERIES["amount_extract_max"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(texts.values()))


def test_hybrid_rerank_asks_with_the_whole_text(spark, tmp_path):
    texts = {100: "common words " * 30 + "latecomer", 1: "common words", 2: "a Latecomer", 3: "nothing", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vecs = [(i, [1.0, 1.0 * k], "x") for k, i in enumerate(texts)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.chunk_id: r.hybrid for r in QUERIES["hybrid_rerank"](spark, str(tmp_path)).collect()}
    share = {1: 2 / 3, 2: 1 / 3, 3: 0.0, 4: 0.0}
    want = {i: max(0.0, 1 - 1 / (1 + k**2) ** 0.5 - 0.15 * share[i]) for k, i in enumerate(texts) if k}
    assert got == pytest.approx(want, abs=2e-6)


def test_fact_conflicts_of_every_key(spark, tmp_path):
    spark.createDataFrame([(1, "Ann", "A", 5), (2, "Bob", "A", 5), (3, "Eve", "B", 6)], "c_custkey long, c_name string, c_mktsegment string, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(9, "bob ", 5), (8, "Sue", 6)], "s_suppkey long, s_name string, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r.nation, r.category, r.key, r.n_values, r.conflicting_values) for r in QUERIES["fact_conflicts"](spark, str(tmp_path)).collect()}
    assert got == {(5, "party", "name", 2, "ann=1;bob=2"), (6, "party", "name", 2, "eve=1;sue=1")}


def test_only_checked_copies_of_the_same_label_go(spark):
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))
    passage, a, b = text(200), text(300), text(300)
    rows = [(1, a, 0), (2, a + " end", 0), (3, a + " vile end", 1), (4, a, 1), (5, passage + " " + text(60), 0), (6, passage + " " + text(60), 1), (7, passage + " " + text(60), 0), (8, b, 1), (9, b, 1), (10, "", 0), (11, None, 0), (12, "", 1)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, _label int")
    left = {r.doc_id for r in toxicity.distinct_documents(sample).collect()}
    assert left == {1, 3, 5, 6, 7, 8, 10, 12}


def test_secret_parts_link_by_the_gap_between_them(spark):
    rng, weak, texts = random.Random(2), "AKIA" + "Q" * 12, []
    for _ in range(60):
        strong, gap = "secret=" + "x" * rng.choice([12, 150, 193, 300, 1500]), rng.choice([1, 50, 199, 200, 201, 202, 350])
        parts = [strong, weak] if rng.random() < 0.5 else [weak, strong]
        texts.append(((" " * gap).join(["." * rng.randrange(400) + " " + parts[0], parts[1]]), gap <= 200))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: "weak_access" in r.spans for r in secret_scan.scan_report(df).collect()}
    assert got == {i: near for i, (_, near) in enumerate(texts)}


@pytest.mark.parametrize("n", [1, 99, 100, 101, 200, 350])
def test_distinct_words_are_measured_over_the_whole_text(n):
    at = quality_classifier.FEATURES.index("distinct_words_window")
    words = [f"w{i}" for i in range(n)]
    assert quality_classifier.features(" ".join(words))[at] == 1.0
    assert quality_classifier.features(" ".join(words + ["same"] * 300))[at] < 0.8
    assert quality_classifier.features(" ".join(words + ["same"] * 300))[at] != quality_classifier.features(" ".join(words + ["same", "other"] * 150))[at]


def test_levenshtein_pairs_compare_each_name_once(spark, tmp_path):
    names = ["hot bolt"] * 40 + ["hot gear", "cold plate", "large old ring", "", None, "hot bolt"]
    parts = [(i, n, "B1" if i % 9 else None, 7) for i, n in enumerate(names)] + [(100, "hot bolts", "B1", 7), (101, "hot bolt", "B2", 7), (102, "hot belt", "B1", 7), (102, "hot belt", "B1", 7)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["levenshtein_pairs"](spark, str(tmp_path))
    p = spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int")
    x, y = p.alias("x"), p.alias("y")
    met = x.join(y, F.expr("x.p_brand = y.p_brand and x.p_size = y.p_size and x.p_partkey < y.p_partkey and levenshtein(x.p_name, y.p_name) <= 6"))
    want = met.selectExpr("x.p_partkey", "y.p_partkey", "levenshtein(x.p_name, y.p_name)").collect()
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want)) and len(want) > 600
    # the distance is of distinct names: an aggregate lies below it, whatever the number of copies
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" in plan and plan.index("Aggregate") > plan.index("levenshtein")


@pytest.mark.parametrize("name", ["ground_truth", "typed_conflicts"])
def test_records_are_read_once(spark, name):
    from titleforge.plans.registry import QUERIES as every

    plan = every[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "variant" not in plan and "to_json" not in plan
