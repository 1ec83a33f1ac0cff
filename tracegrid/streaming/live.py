"""Structured Streaming forms of the engine, for samples that arrive while they are recorded.

``samples`` streams have file, channel, value and an event-time column ``at``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracegrid.runtime import columns_named


def watch(spark: SparkSession, directory: str, schema: str, files_a_trigger: int = 100) -> DataFrame:
    """New Parquet files of a directory as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(directory)


def windowed_stats(samples: DataFrame, width: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """(file, channel, start, n, low, high, mean): tumbling statistics; rows later than ``late`` are dropped."""
    w = columns_named(samples, "file", "channel", "at", "value").withWatermark("at", late).groupBy("file", "channel", F.window("at", width))
    return w.agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean")).select("file", "channel", F.col("window.start").alias("start"), "n", "low", "high", "mean")


def live_sessions(samples: DataFrame, gap: str = "60 seconds", late: str = "5 minutes") -> DataFrame:
    """(file, start, end, samples): stretches of a source without a pause longer than ``gap``."""
    s = columns_named(samples, "file", "at").withWatermark("at", late).groupBy("file", F.session_window("at", gap))
    return s.agg(F.count(F.lit(1)).alias("samples")).select("file", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "samples")


def first_deliveries(samples: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each stored sample once, though delivered again within the watermark."""
    return samples.withWatermark("at", late).dropDuplicatesWithinWatermark(["file", "channel_id", "sample_index"])


def live_runs(samples: DataFrame) -> DataFrame:
    """(file, channel, value, start, end): finished runs of one rounded value, kept in state between batches.

    Samples of a batch are put in order of time; a run is reported when another
    value follows it.
    """
    schema = "file string, channel string, value bigint, start timestamp, end timestamp"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, start = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(batches).dropna(subset=["value"]).sort_values("at")
        for at, x in zip(rows["at"], rows["value"], strict=True):
            v = int(x + 0.5) if x >= 0 else -int(-x + 0.5)
            if value is None:
                value, start = v, at
            elif v != value:
                out.append((*key, value, start, at))
                value, start = v, at
        if value is not None:
            state.update((value, start))
        yield pd.DataFrame(out, columns=["file", "channel", "value", "start", "end"])

    s = columns_named(samples, "file", "channel", "at", "value").groupBy("file", "channel")
    return s.applyInPandasWithState(step, schema, "value bigint, start timestamp", "append", GroupStateTimeout.NoTimeout)
