"""The event stream seen as logger recordings: one file per user, one channel per event type.

The 30 days of a stream are compressed by 3600, so that an hour becomes a second
and a grid of a few ticks a second stays small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegrid.sources.tables import table

UNITS = {"view": "km/h", "click": "rpm", "purchase": "bar", "error": "C", "signup": "count"}
SECOND = 1_000_000_000

#: The same recordings for the SQL side: ``smp`` has one row per sample.
SQL = """
ev AS (SELECT event_id, 'user_' || user_id AS file, event_type AS channel, value, epoch_us(ts) * 1000 // 3600 AS t FROM events),
smp AS (
  SELECT file, channel, value, t - min(t) OVER (PARTITION BY file) AS time_ns,
         row_number() OVER (PARTITION BY file, channel ORDER BY t, event_id) - 1 AS sample_index,
         CASE channel WHEN 'view' THEN 'km/h' WHEN 'click' THEN 'rpm' WHEN 'purchase' THEN 'bar' WHEN 'error' THEN 'C' ELSE 'count' END AS unit
  FROM ev)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    """file, channel, unit, sample_index, time_ns, value."""
    e = table(spark, d, "events")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    s = e.select("event_id", F.concat(F.lit("user_"), "user_id").alias("file"), F.col("event_type").alias("channel"), "value", micros.alias("us"))
    s = s.withColumn("t", F.expr("us * 1000 div 3600"))
    # Windows are per file: a user's events, not the whole stream.
    return s.select(
        "file", "channel", F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v)])[F.col("channel")].alias("unit"),
        (F.row_number().over(Window.partitionBy("file", "channel").orderBy("t", "event_id")) - 1).cast("bigint").alias("sample_index"),
        (F.col("t") - F.min("t").over(Window.partitionBy("file"))).alias("time_ns"), "value",
    )


#: The stream cut into one file per user and day, which make up sessions; an hour is a second here too.
DAYS = """
ev AS (SELECT event_id, 'user_' || user_id || '#' || CAST(ts AS DATE) AS file, 'key:' || user_id AS session_key, event_type AS channel, value, epoch_us(ts) * 1000 // 3600 AS t FROM events),
fl AS (SELECT file, session_key, min(t) AS absolute_start_ns, max(t) AS absolute_end_ns FROM ev GROUP BY 1, 2),
smp AS (SELECT file, channel, value, t - min(t) OVER (PARTITION BY file) AS time_ns, row_number() OVER (PARTITION BY file, channel ORDER BY t, event_id) - 1 AS sample_index FROM ev),
o AS (SELECT *, CASE WHEN absolute_start_ns <= lag(absolute_end_ns) OVER w + 10000000000 THEN 0 ELSE 1 END AS fresh FROM fl WINDOW w AS (PARTITION BY session_key ORDER BY absolute_start_ns, file)),
g AS (SELECT *, session_key || ':' || CAST(sum(fresh) OVER (ORDER BY session_key, absolute_start_ns, file) - 1 AS BIGINT) AS session FROM o)"""
#: Seconds between files of one session.
DAY_GAP = 10


def day_files(spark: SparkSession, d: str) -> DataFrame:
    """file, session_key, absolute_start_ns, absolute_end_ns of the recordings per user and day."""
    e = _days(spark, d)
    return e.groupBy("file", "session_key").agg(F.min("t").alias("absolute_start_ns"), F.max("t").alias("absolute_end_ns"))


def day_samples(spark: SparkSession, d: str) -> DataFrame:
    """file, channel, sample_index, time_ns, value of the recordings per user and day."""
    return _days(spark, d).select(
        "file", "channel", (F.row_number().over(Window.partitionBy("file", "channel").orderBy("t", "event_id")) - 1).cast("bigint").alias("sample_index"),
        (F.col("t") - F.min("t").over(Window.partitionBy("file"))).alias("time_ns"), "value",
    )


def _days(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    e = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("channel"), "value", micros.alias("us"), ts.cast("date").cast("string").alias("day"))
    return e.select("event_id", F.concat(F.lit("user_"), "user_id", F.lit("#"), "day").alias("file"), F.concat(F.lit("key:"), "user_id").alias("session_key"), "channel", "value", F.expr("us * 1000 div 3600").alias("t"))


def with_duration(s: DataFrame, data_type: str = "float64") -> DataFrame:
    """Samples plus the channel's duration (one second past its last sample) and storage type."""
    last = s.groupBy("file", "channel").agg((F.max("time_ns") + SECOND).alias("duration_ns"))
    return s.join(last, ["file", "channel"]).withColumn("data_type", F.lit(data_type))
