"""Folding progress events into state, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Failures that open a breaker, and seconds until it closes.
FAILURES, OPEN_SECONDS = 3, 300


def fold(events: DataFrame, by: list[str]) -> DataFrame:
    """Number, sum, first and last time of each key: the same for batch and stream."""
    return events.groupBy(*by).agg(F.count("*").alias("n_events"), F.sum("value").alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def last_event(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("ts").alias("last_ts"))


def stage_timings(events: DataFrame, by: str, stage: str, ts: str, order: str) -> DataFrame:
    """Runs of the same stage: number, start, and seconds until the next run starts."""
    w = Window.partitionBy(by).orderBy(ts, order)
    changed = (F.col(stage) != F.lag(stage).over(w)) | F.lag(stage).over(w).isNull()
    starts = events.withColumn("_c", changed).where("_c")
    return starts.select(by, stage, F.row_number().over(w).alias("run"), F.col(ts).alias("started"), (F.unix_micros(F.lead(ts).over(w).cast("timestamp")) / 1e6 - F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("seconds"))


def stream(spark: SparkSession, path: str, schema: str, name: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; ``name``: only files with that name."""
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", name) if name else reader).parquet(path)


def windows(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per tumbling window and kind; late ones within the watermark count."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n_events", "total")


def idle_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions of a user that end after a pause."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n_events")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")


def run_to_end(df: DataFrame, folder: str) -> DataFrame:
    """Run a streaming aggregation over what is there; its result is written to files and read back.

    Every micro-batch replaces the state's rows as one table, so that the last table is
    the result and nothing of it passes through the driver.
    """
    written: list[str] = []

    def put(rows: DataFrame, batch: int) -> None:
        path = f"{folder}/result-{batch}"
        rows.write.mode("overwrite").parquet(path)
        written.append(path)

    query = df.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(written[-1]) if written else spark.createDataFrame([], df.schema)


def terminal(events: DataFrame, states: tuple[str, ...] = ("completed", "failed")) -> DataFrame:
    """Events that end a session."""
    return events.where(F.col("event_type").isin(*states))


def after(events: DataFrame, seen: int) -> DataFrame:
    """Events that a reader hasn't had yet, by their number."""
    return events.where(F.col("event_id") >= seen).orderBy("event_id")


def flushes(tokens: DataFrame, by: list[str], size: int = 500, seconds: float = 2.0) -> DataFrame:
    """by, at, text of a model's stream -> the texts that are passed on: a flush whenever ``size``
    characters have come and ``seconds`` have gone by since the last one, and the rest at the end."""
    schema = ", ".join(f"{k} {tokens.schema[k].dataType.simpleString()}" for k in by)

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        out, held, last = [], "", pdf["at"].iloc[0]
        for at, text in zip(pdf["at"], pdf["text"]):
            held += text or ""
            if len(held) >= size and (at - last).total_seconds() >= seconds:
                out.append((at, held))
                held, last = "", at
        if held:
            out.append((pdf["at"].iloc[-1], held))
        keys = {k: pdf[k].iloc[0] for k in by}
        return pd.DataFrame([{**keys, "n": i, "at": at, "text": text} for i, (at, text) in enumerate(out)], columns=[*by, "n", "at", "text"])

    return tokens.select(*by, "at", "text").groupBy(*by).applyInPandas(gather, f"{schema}, n int, at timestamp, text string")


def breaker(outcomes: DataFrame) -> DataFrame:
    """service, ts, ok (stream) -> a row whenever a service's breaker opens.

    ``FAILURES`` failures in a row open it for ``OPEN_SECONDS``; calls meanwhile don't count.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failed, until = state.get if state.exists else (0, 0.0)
        out = []
        for pdf in batches:
            for ts, ok in sorted(zip(pdf["ts"], pdf["ok"])):
                at = ts.timestamp()
                if at < until:
                    continue
                failed = 0 if ok else failed + 1
                if failed >= FAILURES:
                    failed, until = 0, at + OPEN_SECONDS
                    out.append((key[0], ts, pd.Timestamp(until, unit="s")))
        state.update((failed, until))
        yield pd.DataFrame(out, columns=["service", "opened", "until"])

    return outcomes.groupBy("service").applyInPandasWithState(step, "service string, opened timestamp, until timestamp", "failed int, until double", "append", GroupStateTimeout.NoTimeout)
