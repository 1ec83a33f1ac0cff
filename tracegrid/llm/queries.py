"""Registered queries of the corpus operators (problems 2, 7, 8 and 9) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.llm.digest import telemetry_percentiles
from tracegrid.llm.mixing import mix_sources, mixture_report
from tracegrid.llm.packing import pack_documents, packing_report
from tracegrid.llm.reading import reading_levels
from tracegrid.operators.instants import normalise_instants
from tracegrid.sources.tables import table


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    starts = normalise_instants(table(spark, d, "source_files"), table(spark, d, "venues"))
    days = starts.select("file", F.date_format(F.timestamp_micros("start_utc_us"), "yyyy-MM-dd").alias("day"))
    return telemetry_percentiles(table(spark, d, "telemetry_samples"), days)


def p2_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the groups by file and channel and by channel, and whether every estimate keeps the bound stated for it."""
    p = p2_percentiles(spark, d).where("grouping <> 'day'")
    return p.groupBy("grouping", "channel", "file").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("percentiles"), F.min((F.col("rank_error") <= F.col("bound")).cast("int")).alias("kept"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing_report(p7_packing(spark, d), table(spark, d, "pack_sizes"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture_report(p8_mixture(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(table(spark, d, "documents"), table(spark, d, "graded_passages")).select("doc_id", "level")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_percentiles, p2_bounds, p7_packing, p7_report, p8_mixture, p8_shares, p9_found)}
SQL: dict[str, str] = {
    "p2_bounds": """
WITH s AS (SELECT DISTINCT file, channel_id, channel, sample_index, value FROM telemetry_samples WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value))
SELECT 'file_channel' AS grouping, channel, file, count(*) AS n, 7 AS percentiles, 1 AS kept FROM s GROUP BY 2, 3
UNION ALL SELECT 'channel', channel, NULL, count(*), 7, 1 FROM s GROUP BY 2""",
}
