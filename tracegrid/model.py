"""Shared vocabulary of the telemetry model: schemas, storage types, name rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLES = (
    "file string, format string, channel_id bigint, channel string, unit string, unit_source string, frequency_hz double, sample_index bigint, time_ns bigint, value double"
)
CHANNELS = (
    "file string, format string, channel_id bigint, name string, unit string, unit_source string, canonical_unit string, dimension string, type_code bigint, data_type string,"
    " frequency_hz double, sample_period_ns bigint, sample_count bigint, chunk_count bigint, duration_ns bigint"
)
CHUNKS = "file string, channel_id bigint, chunk_index int, sample_period_ns bigint, sample_count bigint, data_ptr bigint, sample_base bigint, time_base_ns bigint"
FILES = (
    "file string, format string, duration_ns bigint, channel_count bigint, sampled_channel_count bigint, sample_count bigint, driver string, vehicle string, venue string,"
    " event string, session string, date string, time string, absolute_clock string, absolute_start_ns bigint, session_hint string, video_frame_count bigint"
)

#: Storage code -> (name, little-endian dtype).  Fixed values of the file formats.
STORAGE = {1: ("uint8", "<u1"), 2: ("int16", "<i2"), 3: ("uint16", "<u2"), 4: ("int32", "<i4"), 5: ("uint32", "<u4"), 6: ("float32", "<f4"), 7: ("float64", "<f8")}
FLOATING = ("float32", "float64")

DECLARED, SPEC_DEFAULT, UNKNOWN = "declared", "spec_default", "unknown"

#: A channel whose normalised name contains one of these holds steps, never slopes.
STEP_NAMES = ("gear", "lapnumber", "lapbeacon", "laptrigger", "switch", "status", "state", "flag", "alarm", "satellites", "solutiontype")


def normalised(name: Column) -> Column:
    """A channel name in lower-case ASCII letters and digits."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def is_step(name: Column, data_type: Column) -> Column:
    """Whether a channel keeps its value until the next sample instead of sloping towards it."""
    return ~data_type.isin(*FLOATING) | normalised(name).rlike("|".join(STEP_NAMES))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def round_half_away(x: Column) -> Column:
    """Nearest integer, halves away from zero, as bigint; NULL for values that are not finite."""
    return F.when(finite(x), F.round(x, 0).try_cast("bigint"))
