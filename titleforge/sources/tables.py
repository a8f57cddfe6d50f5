"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: States of a session that a restart turns into failures.
UNFINISHED = ("processing", "queued")
SESSION = "session_id string, status string, stage string, created_at timestamp, updated_at timestamp, risk_score int, error string"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(app: str = "titleforge") -> SparkSession:
    """A session with the settings that results rely on."""
    return SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Binary files with the first bytes; the content itself is read only where used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def valid_pdf(content: Column, length: Column, most: int = 50 << 20) -> Column:
    """Starts with the PDF mark, isn't empty, isn't over the upload limit."""
    return (length > 0) & (length <= most) & (F.substring(content, 1, 4) == F.lit(b"%PDF"))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"[^\w.\- ]", "_")


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """Saved sessions, newest first."""
    return spark.read.schema(SESSION).json(path).orderBy(F.desc("updated_at"))


def save_sessions(rows: DataFrame, path: str) -> None:
    """One folder per session; only the sessions in ``rows`` are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").json(path)


def repair(rows: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Sessions younger than the limit; unfinished ones become failed."""
    fresh = rows.where(F.col("updated_at") >= now - F.expr(f"INTERVAL {hours} HOURS"))
    return fresh.withColumn("error", F.when(F.col("status").isin(*UNFINISHED), "interrupted").otherwise(F.col("error"))).withColumn("status", F.when(F.col("status").isin(*UNFINISHED), "failed").otherwise(F.col("status")))


def elements_to_pages(rows: DataFrame, key: str, json: str) -> DataFrame:
    """A structured result (elements with page and text) -> key, page_number, text."""
    schema = "elements array<struct<Page:int,Text:string,Path:string>>"
    each = rows.select(key, F.posexplode(F.from_json(F.col(json), schema)["elements"]).alias("at", "e")).where("e.Text is not null")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("e.Text").alias("text")))), lambda s: s["text"])
    return each.groupBy(key, (F.coalesce(F.col("e.Page"), F.lit(0)) + 1).alias("page_number")).agg(F.array_join(ordered, "\n").alias("text"))
