"""Registered queries of the data-quality operators (problems 1, 3, 4, 5 and 6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.operators.anomalies import find_faults
from tracegrid.operators.drift import consistent_channels, layout_changes, migration_steps
from tracegrid.operators.instants import GRAMMAR, normalise_instants
from tracegrid.operators.regular_grid import regular_grid, uncovered_ticks
from tracegrid.operators.unit_links import link_units
from tracegrid.operators.unit_resolution import base_unit_profile, recorded_units
from tracegrid.runtime import shared_root
from tracegrid.sources.tables import table

REFERENCE = ("unit_defs", "channel_rules", "channel_limits")


def _tables(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return find_faults(*_tables(spark, d, "telemetry_samples", "chunks", "channels", *REFERENCE)).select("file", "channel_id", "sample_index").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    # Texts that an earlier run has parsed are not parsed again.
    return normalise_instants(*_tables(spark, d, "source_files", "venues"), dictionary=f"{shared_root(spark)}/instants-{GRAMMAR}")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return recorded_units(*_tables(spark, d, "channels", *REFERENCE))


def p4_base_units(spark: SparkSession, d: str) -> DataFrame:
    return base_unit_profile(*_tables(spark, d, "telemetry_samples", "channels", *REFERENCE))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    return link_units(*_tables(spark, d, "telemetry_samples", "channels", "source_files", *REFERENCE)).select("file", "channel_id", "unit", "dimension", "step", "misfit")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return layout_changes(*_tables(spark, d, "channels", "source_files", *REFERENCE)).select("file", "channel_id", "change").distinct()


def p5_consistent(spark: SparkSession, d: str) -> DataFrame:
    return consistent_channels(*_tables(spark, d, "channels", "source_files", *REFERENCE))


def p5_migrations(spark: SparkSession, d: str) -> DataFrame:
    return migration_steps(*_tables(spark, d, "channels", "source_files", *REFERENCE))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return uncovered_ticks(*_tables(spark, d, "telemetry_samples", "chunks"))


def p6_series(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(*_tables(spark, d, "telemetry_samples", "chunks")).withColumn("value", F.when(F.col("state") == "filled", F.round("value", 6)).otherwise(F.col("value")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p3_found, p4_found, p4_base_units, p4_links, p5_found, p5_consistent, p5_migrations, p6_found, p6_series)
}

_TICKS = """
WITH s AS (SELECT DISTINCT file, channel_id, sample_index, time_ns, value, frequency_hz FROM telemetry_samples),
k AS (SELECT DISTINCT file, channel_id, chunk_index, sample_period_ns, sample_count, sample_base, time_base_ns FROM chunks),
t AS (
  SELECT s.file, s.channel_id, k.chunk_index, s.sample_index, s.time_ns, s.value, time_base_ns, nullif(sample_period_ns, 0) AS exact, coalesce(CAST(nullif(k.sample_period_ns, 0) AS DOUBLE), 1e9 / s.frequency_hz) AS period,
         CAST(floor((s.time_ns - k.time_base_ns) / coalesce(CAST(nullif(k.sample_period_ns, 0) AS DOUBLE), 1e9 / s.frequency_hz) + 0.5) AS BIGINT) AS tick
  FROM s JOIN k ON s.file = k.file AND s.channel_id = k.channel_id
   AND s.sample_index >= k.sample_base AND s.sample_index < k.sample_base + k.sample_count),
e AS (SELECT file, channel_id, chunk_index, arg_max(tick, sample_index) AS last_tick, min(time_base_ns) AS base, min(exact) AS exact, min(period) AS period FROM t GROUP BY 1, 2, 3),
g AS (SELECT file, channel_id, chunk_index, base, exact, period, unnest(generate_series(0, last_tick)) AS tick FROM e)"""
SQL: dict[str, str] = {
    "p6_found": _TICKS + """
SELECT file, channel_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(tick AS BIGINT) AS tick FROM g
EXCEPT
SELECT file, channel_id, CAST(chunk_index AS BIGINT), tick FROM t WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)
""",
    "p6_series": _TICKS + """,
r AS (SELECT t.file, t.channel_id, t.chunk_index, tick, arg_min(value, (abs(time_ns - time_base_ns - tick * t.period), sample_index)) AS value FROM t JOIN e USING (file, channel_id, chunk_index)
  WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) AND tick >= 0 AND tick <= last_tick GROUP BY 1, 2, 3, 4),
n AS (SELECT *, lead(tick) OVER w AS nt, lead(value) OVER w AS nv FROM r WINDOW w AS (PARTITION BY file, channel_id, chunk_index ORDER BY tick)),
j AS (SELECT g.*, n.tick AS pt, n.value AS pv, nt, nv FROM g ASOF LEFT JOIN n ON g.file = n.file AND g.channel_id = n.channel_id AND g.chunk_index = n.chunk_index AND g.tick >= n.tick)
SELECT file, channel_id, CAST(chunk_index AS BIGINT) AS chunk_index, tick, base + coalesce(tick * exact, CAST(round(tick * period) AS BIGINT)) AS time_ns,
  CASE WHEN tick = pt THEN pv WHEN nt - pt - 1 <= 10 THEN round(pv + (nv - pv) * ((tick - pt) / (nt - pt)), 6) END AS value,
  CASE WHEN tick = pt THEN 'reading' WHEN nt - pt - 1 <= 10 THEN 'filled' ELSE 'missing' END AS state FROM j""",
}
