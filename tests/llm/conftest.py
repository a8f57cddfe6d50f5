import pytest


@pytest.fixture
def docs(spark):
    """Documents with nulls, an empty text, repeated rows, a long text and an extra column."""
    from pyspark.sql import Row

    rows = [
        Row(doc_id=1, text="the quick brown fox jumps over the lazy dog", lang="en", source="a", n_chars=43, label="x"),
        Row(doc_id=2, text="the quick brown fox jumps over the lazy dog", lang="en", source="a", n_chars=43, label="x"),
        Row(doc_id=2, text="the quick brown fox jumps over the lazy dog", lang="en", source="a", n_chars=43, label="x"),
        Row(doc_id=3, text=None, lang=None, source=None, n_chars=None, label=None),
        Row(doc_id=4, text="", lang="en", source="b", n_chars=0, label="x"),
        Row(doc_id=None, text="password = hunter2hunter2 and a word", lang="en", source="b", n_chars=30, label="x"),
        Row(doc_id=5, text="long words here " * 5000, lang="en", source="c", n_chars=80000, label="x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string")
