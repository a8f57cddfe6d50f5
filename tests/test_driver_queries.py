"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from titleforge.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)):
            return repr(round(float(x), 6))
        return str(x)[:19].replace(" 00:00:00", "")

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_fact_store_lookup(spark):
    from titleforge.operators import facts

    df = spark.createDataFrame([("property", "village", "A", "f1"), ("party", "name", "B", "f2")], "category string, key string, value string, source_file string")
    assert facts.lookup(df, category="party").count() == 1
    assert facts.lookup(df, category="party", source_file="f1").first().value == "A"
    assert facts.lookup(df, key=" Village ").count() == 1


def test_packing_keeps_the_budget(spark):
    from titleforge.operators import chunking

    rows = spark.createDataFrame([("d", i, n) for i, n in enumerate([5, 5, 5, 12, 1])], "doc string, at int, n int")
    assert [r.bin for r in chunking.pack(rows, "doc", "at", "n", 10).orderBy("at").collect()] == [0, 0, 1, 2, 3]
