"""Writing recordings: lossless logger files with sidecar, and Parquet that keeps units."""

from __future__ import annotations

import os
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tracegrid import units
from tracegrid.model import STORAGE
from tracegrid.operators import events
from tracegrid.runtime import bounded_rows
from tracegrid.sources.formats import ld, ldx
from tracegrid.sources.formats.common import Channel, Chunk, FormatError, Recording
from tracegrid.sources.paths import find_files
from tracegrid.sources.recordings import open_recording
from tracegrid.sources.summary import plain_name, readings

#: Samples of one logger file at most: the format itself ends at 4 GiB.
MOST_SAMPLES = 1 << 30
#: Lap markers of one sidecar at most.
MOST_MARKERS = 1_000_000
_CODES = {name: code for code, (name, _) in STORAGE.items()}
SUMMARY = "source string, output string, format string, channels bigint, samples bigint, bytes bigint, sidecar string, sidecar_bytes bigint"


def _put(path: str, data: bytes) -> None:
    """Written under another name and renamed when complete."""
    with open(path + ".part", "wb") as f:
        f.write(data)
    os.replace(path + ".part", path)


def _write(channels: list[Channel], output: str, identity: dict[str, str], markers: list[int] | None, beacon_source: str = "") -> tuple:
    """The recording and its sidecar; (channels, samples, bytes, sidecar, bytes of it)."""
    if not output.lower().endswith(".ld"):
        raise ValueError("only .ld recordings can be written")
    extra = {k: identity.get(k) or "" for k in ("team", "vehicle_number", "long_comment")}
    who = ld.Identity(**{k: v or "" for k, v in identity.items() if k not in extra})
    body = ld.encode(channels, who)
    details = {"Event": who.event, "Venue": who.venue, "Driver": who.driver, "Team": extra["team"], "Vehicle Id": who.vehicle, "Vehicle Number": extra["vehicle_number"], "Session": who.session, "Short Comment": who.comment, "Long Comment": extra["long_comment"]}
    text = ldx.sidecar(markers, details, who.date, who.time, beacon_source).encode()
    side = ldx.sidecar_path(output)
    _put(output, body), _put(side, text)
    return len(channels), sum(c.sample_count for c in channels), len(body), side, len(text)


def write_recording(samples: DataFrame, output: str, source: str = "", data_types: dict[str, str] | None = None, markers: DataFrame | None = None, **identity: str) -> DataFrame:
    """Writes the samples of one file to ``output`` and its sidecar; returns one summary row.

    A logger file is one object made by one process: the samples of a single
    recording come to the driver, sorted by Spark.
    """
    if not output.lower().endswith(".ld"):
        raise ValueError("only .ld recordings can be written")
    rows = samples.select("channel", "unit", "frequency_hz", "sample_index", "time_ns", "value").orderBy("channel", "sample_index").limit(MOST_SAMPLES + 1).toArrow().to_pandas()
    if len(rows) > MOST_SAMPLES:
        raise FormatError(f"more than {MOST_SAMPLES} samples")
    if rows.empty:
        raise FormatError("nothing to write")
    channels = []
    for i, (name, g) in enumerate(rows.groupby("channel", sort=True)):
        period = int(round(1e9 / g.frequency_hz.iloc[0]))
        t = g.time_ns.to_numpy()
        if (np.diff(t) != period).any():
            raise FormatError(f"{name}: its samples do not follow each other on one clock")
        code = _CODES[(data_types or {}).get(name, "float64")]
        channels.append(Channel(i, name, g.unit.iloc[0] or "", "declared", code, [Chunk(period, len(g), 0, 0, int(t[0]))], None, g.value.to_numpy()))
    beacons = [r[0] for r in bounded_rows(markers.select("time_ns").orderBy("time_ns"), MOST_MARKERS, "lap markers")] if markers is not None else None
    n, m, size, side, side_size = _write(channels, output, identity, beacons)
    return samples.sparkSession.createDataFrame([(source, output, "motec", n, m, size, side, side_size)], SUMMARY)


def _rescaled(c: Channel, name: str, unit: str, values: np.ndarray, declared: bool) -> Channel:
    """A channel under another name and unit; converted values are stored as float64."""
    a, b = units.lookup(c.unit), units.lookup(unit)
    out = replace(c, name=name, unit=unit, unit_source="declared" if declared else c.unit_source, values=values)
    if c.unit == unit or (a and b and a.unit == b.unit):
        return out
    if not a or not b:
        raise units.UnknownUnit(f"{c.name}: {c.unit!r} does not convert to {unit!r}")
    return replace(out, type_code=_CODES["float64"], values=np.array([units.convert_value(0.0, c.unit, unit)]) + values * (units.convert_value(1.0, c.unit, unit) - units.convert_value(0.0, c.unit, unit)))


def projected(rec: Recording, channel_mapping: list[list[str]] = (), include_unmapped: bool = True, exclude_channels: list[str] = (), sum_channels: list[list[str]] = ()) -> list[Channel]:
    """The channels of an export: mapped ones [source, target, unit], the rest, and sums [left, right, target, unit].

    An empty unit keeps that of the source.  Both channels of a sum need one clock
    and one unit; any fault in the request raises.
    """
    have = {c.name.lower(): c for c in reversed(rec.channels)}

    def find(name: str) -> Channel:
        if name.lower() not in have:
            raise ValueError(f"channel {name!r} not found")
        return have[name.lower()]

    for rows, width, what in ((channel_mapping, 3, "channel_mapping"), (sum_channels, 4, "sum_channels")):
        if any(len(r) != width for r in rows):
            raise ValueError(f"{what}: each row needs {width} texts")
    out: list[Channel] = []
    for source, target, unit in channel_mapping:
        c = find(source)
        out.append(_rescaled(c, target.strip(), unit.strip() or c.unit, c.values, bool(unit.strip())))
    gone = {x.lower() for x in exclude_channels} | {r[0].lower() for r in channel_mapping}
    if include_unmapped:
        out += [c for c in rec.channels if c.name.lower() not in gone]
    for left, right, target, unit in sum_channels:
        a, b = find(left), find(right)
        clocks = [[(k.period_ns, k.count, k.time_base_ns) for k in c.chunks] for c in (a, b)]
        if clocks[0] != clocks[1] or (a.times is not None and not np.array_equal(a.times, b.times)):
            raise ValueError(f"cannot sum {left} and {right}: their clocks differ")
        if a.unit != b.unit and (units.normalise(a.unit) is None or units.normalise(a.unit) != units.normalise(b.unit)):
            raise ValueError(f"cannot sum {left} [{a.unit}] and {right} [{b.unit}]: their units differ")
        if not unit.strip():
            raise ValueError("a sum needs a unit")
        out.append(replace(_rescaled(a, target.strip(), unit.strip(), np.asarray(a.values, float) + np.asarray(b.values, float), True), type_code=_CODES["float64"]))
    names = [c.name.lower() for c in out]
    if not all(names) or len(set(names)) != len(names):
        raise ValueError("empty or repeated target channel")
    return out


def markers_of(rec: Recording) -> tuple[list[int], str] | None:
    """(lap markers, channel) of the first pulse channel that has any, else of the first counter."""
    for names, pulse in ((events.PULSE_NAMES, True), (events.COUNTER_NAMES, False)):
        for name in names:
            c = next((c for c in rec.channels if c.sample_count and plain_name(c.name) == name), None)
            t, x = readings(c)
            edge = (x[1:] > 0) & (x[:-1] <= 0) if pulse else x[1:] > x[:-1]
            kept: list[int] = []
            for at in t[1:][edge].tolist():
                if at > 0 and (not kept or at - kept[-1] >= 5_000_000_000):
                    kept.append(at)
            if kept:
                return kept, c.name
    return None


def export_file(source: str, output: str, format: str | None = None, channel_mapping: list[list[str]] = (), include_unmapped: bool = True, exclude_channels: list[str] = (), sum_channels: list[list[str]] = (), **identity: str) -> tuple:
    """Exactly one recording to ``output`` and its sidecar, in this process; the values of ``SUMMARY``."""
    form = (format or "motec").lower()
    if form not in ("motec", "ld") or not output.lower().endswith(".ld"):
        raise ValueError(f"only motec recordings (.ld) can be written, not {format or output!r}")
    files = find_files(source)
    if len(files) != 1:
        raise ValueError(f"one file is written at a time, {len(files)} match {source!r}")
    rec = open_recording(files[0])
    given = {k: v for k, v in identity.items() if v}
    kept = {k: getattr(rec, k) for k in ("driver", "vehicle", "venue", "event", "session", "date", "time")}
    found = markers_of(rec)
    channels = [c for c in projected(rec, channel_mapping, include_unmapped, exclude_channels, sum_channels) if c.sample_count]
    n, m, size, side, side_size = _write(channels, output, kept | given, found and found[0], found[1] if found else "")
    return files[0], output, "motec", n, m, size, side, side_size


def write_telemetry(spark: SparkSession, source: str, output: str, **options) -> DataFrame:
    """``export_file`` with its summary row as a DataFrame."""
    return spark.createDataFrame([export_file(source, output, **options)], SUMMARY)


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", mode: str = "errorifexists") -> None:
    """Parquet with the column metadata, so that units tagged with ``units.tag_unit`` come back."""
    df.write.mode(mode).option("compression", compression).parquet(path)


def write_parquet_footer(path: str, pairs: dict[str, str]) -> int:
    """Key-value pairs added to the footer of every Parquet file of a local folder; returns the number of files.

    Spark writes no footer keys of its own choosing.  Each file is copied row group
    by row group under another name, which then replaces it.
    """
    import pyarrow.parquet as pq

    names = [os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith(".parquet")]
    for name in names:
        with pq.ParquetFile(name) as f:
            schema = f.schema_arrow.with_metadata({**(f.schema_arrow.metadata or {}), **{k.encode(): v.encode() for k, v in pairs.items()}})
            with pq.ParquetWriter(name + ".part", schema, compression="zstd") as w:
                for i in range(f.num_row_groups):
                    w.write_table(f.read_row_group(i).replace_schema_metadata(schema.metadata))
        os.replace(name + ".part", name)
        crc = os.path.join(path, f".{os.path.basename(name)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    return len(names)


def parquet_footer(path: str) -> dict[str, str]:
    """The key-value pairs of the footer of the first Parquet file of a local folder."""
    import pyarrow.parquet as pq

    first = next(os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith(".parquet"))
    return {k.decode(): v.decode() for k, v in (pq.read_schema(first).metadata or {}).items()}


def parquet_units(spark: SparkSession, path: str) -> dict[str, str]:
    """Unit by column of a Parquet folder."""
    return {f.name: f.metadata[units.TAG] for f in spark.read.parquet(path).schema if units.TAG in f.metadata}
