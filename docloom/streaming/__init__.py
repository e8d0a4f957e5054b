"""Structured Streaming over event folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def progress(events: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events and their values by type and window of event time; late rows within ``delay`` count (an extension of the engine)."""
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows as Parquet, exactly once; ends when the folder's files are read."""
    return stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def reassembled(tokens: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(job, text, n) so far, from a stream of (job, seq, token, ts): a job's tokens in their order, whatever order they came in.

    Write it in update mode. Rows later than ``delay`` are dropped with their job's state,
    which holds that job's tokens.
    """
    grouped = tokens.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "job").agg(F.array_sort(F.collect_set(F.struct("seq", "token"))).alias("x"))
    return grouped.select("job", F.array_join(F.transform("x", lambda v: v["token"]), "").alias("text"), F.size("x").alias("n"))


def forward(stream: DataFrame, sink, checkpoint: str) -> StreamingQuery:
    """Each micro-batch in order of ``seq`` to ``sink(rows, batch_id)``; ends when what is there has been read."""
    return stream.writeStream.foreachBatch(lambda rows, n: sink(rows.orderBy("seq"), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_alive(events: DataFrame, key: str, seconds: int = 1) -> DataFrame:
    """(key, event_id, ping): a ping for each ``seconds`` of silence between two events (key, event_id, ts) of a key."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    gap = F.unix_micros(F.lead("ts").over(w)) - F.unix_micros("ts")
    rows = events.select(key, "event_id", F.ceil(gap / (seconds * 1_000_000)).cast("int").alias("n")).where("n > 1")
    return rows.select(key, "event_id", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("ping"))
