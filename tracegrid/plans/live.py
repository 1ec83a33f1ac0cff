"""Registered queries of the streaming forms: a table read as a stream to its end."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.runtime import scratch_dir
from tracegrid.sources.tables import table
from tracegrid.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The event table as a stream of samples: file, channel, at, value."""
    path = f"{d.rstrip('/')}/events.parquet"
    schema = table(spark, d, "events").schema
    local = path.removeprefix("file://")
    # A table is a file or a folder of files.
    reader = spark.readStream.schema(schema)
    stream = reader.option("pathGlobFilter", "events.parquet").parquet(d) if os.path.isfile(local) else reader.parquet(path)
    return stream.select(F.concat(F.lit("user_"), "user_id").alias("file"), F.col("event_type").alias("channel"), F.col("ts").cast("timestamp").alias("at"), "value", "event_id")


def _to_end(stream: DataFrame, name: str) -> DataFrame:
    """What a stream in append mode has written when all its input is read."""
    out = scratch_dir(stream.sparkSession, name)
    q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", scratch_dir(stream.sparkSession, f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def stream_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of closed windows of a day; windows that late rows may still reach are not written yet."""
    w = _to_end(live.windowed_stats(_events(spark, d), "1 day", "1 hour"), "stream-stats")
    return w.select("file", "channel", F.col("start").cast("timestamp_ntz").alias("start"), "n", "low", "high", F.round("mean", 6).alias("mean"))


def stream_first(spark: SparkSession, d: str) -> DataFrame:
    """Each event once."""
    s = _events(spark, d).select("file", F.col("channel").alias("kind"), F.lit(0).alias("channel_id"), F.col("event_id").alias("sample_index"), "at", "value")
    return _to_end(live.first_deliveries(s, "1 hour"), "stream-first").select("file", "kind", "sample_index", "value")


QUERIES |= {"stream_stats": stream_stats, "stream_first": stream_first}
SQL |= {
    "stream_stats": """
WITH w AS (SELECT 'user_' || user_id AS file, event_type AS channel, time_bucket(INTERVAL '1 day', ts) AS start, count(value) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2, 3)
SELECT * FROM w WHERE start + INTERVAL '1 day' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'""",
    "stream_first": "SELECT 'user_' || user_id AS file, event_type AS kind, event_id AS sample_index, value FROM events",
}
