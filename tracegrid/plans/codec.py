"""Registered queries that send recordings through a file format and back, in memory or as files read by the data source."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.plans.engine import _merged
from tracegrid.plans.recordings import SQL as REC
from tracegrid.plans.recordings import samples
from tracegrid.runtime import scratch_dir
from tracegrid.sources.formats import aim, ld, pds, vbo
from tracegrid.sources.formats.common import Channel, Chunk
from tracegrid.sources.library import Library
from tracegrid.sources.recordings import open_recording, read, read_wide
from tracegrid.sources.sinks import export_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_OUT = "file string, channel string, unit string, sample_index bigint, time_ns bigint, value double"
_SECOND = 1_000_000_000


def _channels(pdf: pd.DataFrame) -> list[Channel]:
    out = []
    for i, (name, g) in enumerate(pdf.sort_values(["channel", "sample_index"]).groupby("channel", sort=True)):
        out.append(Channel(i, name, g.unit.iloc[0], "declared", 7, [Chunk(_SECOND, len(g), 0, 0, 0)], None, g.value.to_numpy(np.float64)))
    return out


def _through(encode: Callable[[list[Channel]], bytes], decode: Callable[[bytes], object]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        sent = _channels(pdf)
        names = {c.name for c in sent}
        got = [c for c in decode(encode(sent)).channels if c.name in names]
        parts = [pd.DataFrame({"file": pdf.file.iloc[0], "channel": c.name, "unit": c.unit, "sample_index": np.arange(c.sample_count), "time_ns": c.time_ns(), "value": c.values}) for c in got]
        return pd.concat(parts, ignore_index=True)

    return one


def _aim(channels: list[Channel]) -> bytes:
    return aim.encode([(i + 1, c.name, [(1000 * k, float(v)) for k, v in enumerate(c.values)]) for i, c in enumerate(channels)])


def ld_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy("file").applyInPandas(_through(ld.encode, ld.decode), _OUT)


def pds_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy("file").applyInPandas(_through(pds.encode, pds.decode), _OUT)


def vbo_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    # All columns of this format share one clock, so each channel is a file of its own.
    return samples(spark, d).groupBy("file", "channel").applyInPandas(_through(vbo.encode, vbo.decode), _OUT)


def aim_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    # Scalars are float32 and carry no unit.
    s = samples(spark, d).withColumn("value", F.col("value").cast("float").cast("double"))
    return s.groupBy("file").applyInPandas(_through(_aim, aim.decode), _OUT).drop("unit")


QUERIES |= {f.__name__: f for f in (ld_roundtrip, pds_roundtrip, vbo_roundtrip, aim_roundtrip)}
_SAME = "WITH " + REC + " SELECT file, channel, unit, sample_index, sample_index * 1000000000 AS time_ns, value FROM smp"
SQL: dict[str, str] = {
    "ld_roundtrip": _SAME,
    "pds_roundtrip": _SAME,
    "vbo_roundtrip": _SAME,
    "aim_roundtrip": "WITH " + REC + " SELECT file, channel, sample_index, sample_index * 1000000000 AS time_ns, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM smp",
}


# ---- files on disk, read by the data source

#: Channel, unit, storage code and divisor by which each kind of event is recorded.
_RECORDED = {"view": ("Lap Number", "", 7, 50.0), "click": ("Driver ID", "", 7, 50.0), "purchase": ("Speed", "km/h", 7, 1.0), "error": ("Oil Temp", "C", 7, 1.0), "signup": ("Gear", "", 4, 1.0)}


def _stored(pdf: pd.DataFrame) -> list[Channel]:
    out = []
    for i, (event, g) in enumerate(pdf.sort_values(["channel", "sample_index"]).groupby("channel", sort=True)):
        name, unit, code, by = _RECORDED[event]
        x = g.value.to_numpy(np.float64) / by
        out.append(Channel(i, name, unit, "declared", code, [Chunk(_SECOND, len(g), 0, 0, 0)], None, np.floor(x) if code == 4 else x))
    return out


def _write_files(spark: SparkSession, d: str) -> str:
    """One LD file per user in the shared folder, written where its samples lie; the pattern that names them all."""
    folder = scratch_dir(spark, "recordings").removeprefix("file://")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        os.makedirs(folder, exist_ok=True)
        user = int(pdf.file.iloc[0].rsplit("_", 1)[1])
        who = ld.Identity(driver=f"D{user % 9}", vehicle=f"car {user % 7}", venue="Test Track", date="01/02/2024", time=f"10:{user // 60 % 60:02d}:{user % 60:02d}")
        path = os.path.join(folder, f"{pdf.file.iloc[0]}.ld")
        with open(path + ".part", "wb") as f:
            f.write(ld.encode(_stored(pdf), who))
        os.replace(path + ".part", path)
        return pd.DataFrame({"path": [path]})

    samples(spark, d).groupBy("file").applyInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    return f"{folder}/*.ld"


def _base(column: str = "file"):
    return F.regexp_extract(column, r"([^/]+)\.ld$", 1)


def reader_samples(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, _write_files(spark, d)).select(_base().alias("file"), "format", "channel_id", "channel", "unit", "unit_source", "frequency_hz", "sample_index", "time_ns", "value")


def reader_metadata(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, _write_files(spark, d), "channels")
    return c.select(_base().alias("file"), "channel_id", "name", "unit", "unit_source", "canonical_unit", "dimension", "data_type", "frequency_hz", "sample_period_ns", "sample_count", "chunk_count", "duration_ns")


def reader_wide(spark: SparkSession, d: str) -> DataFrame:
    w = read_wide(spark, _write_files(spark, d), rate=2, channels="speed, Gear", channel_map="Speed -> V [m/s] * 0.5 + 1", filename=True)
    return w.select(_base("filename").alias("file"), "time_ns", F.round("V", 6).alias("V"), "Gear")


def reader_files(spark: SparkSession, d: str) -> DataFrame:
    f = Library(spark, _write_files(spark, d)).file_metadata()
    return f.select(_base().alias("file"), *[c for c in f.columns if c not in ("file", "schema_hash", "session_key")])


def reader_export(spark: SparkSession, d: str) -> DataFrame:
    """Every file exported with a channel converted, one left out, a sum and an identity told from its path; the exports read back."""
    folder = scratch_dir(spark, "exports").removeprefix("file://")
    files = read(spark, _write_files(spark, d), "files").select("file", F.regexp_extract("file", r"user_(\d+)\.ld$", 1).alias("number"))

    def export(batches):
        for pdf in batches:
            os.makedirs(folder, exist_ok=True)
            done = [export_file(p, os.path.join(folder, os.path.basename(p)), channel_mapping=[["Oil Temp", "Temperature", "K"]], exclude_channels=["gear"], vehicle_number=n, session=f"run {n}") for p, n in zip(pdf.file, pdf.number, strict=True) if _has(p)]
            yield pd.DataFrame({"output": [r[1] for r in done]})

    files.mapInPandas(export, "output string").write.format("noop").mode("overwrite").save()
    return read(spark, f"{folder}/*.ld").select(_base().alias("file"), "channel", "unit", "sample_index", F.round("value", 6).alias("value"))


def _has(path: str) -> bool:
    return any(c.name == "Oil Temp" for c in open_recording(path, False).channels)


def reader_sessions(spark: SparkSession, d: str) -> DataFrame:
    return Library(spark, _write_files(spark, d)).session_metadata(60)


QUERIES |= {"reader_export": reader_export, "reader_sessions": reader_sessions}
QUERIES |= {f.__name__: f for f in (reader_samples, reader_metadata, reader_wide, reader_files)}
_KIND = "".join(f" WHEN '{event}' THEN {{{k}}}" for k, event in enumerate(_RECORDED))


def _case(*values: str) -> str:
    return "CASE channel" + _KIND.format(*values) + " END"


_NAME, _UNIT = _case(*(f"'{n}'" for n, *_ in _RECORDED.values())), _case(*(f"'{u}'" for _, u, *_ in _RECORDED.values()))
_FILES = "WITH " + REC + f""", rec AS (
  SELECT file, channel AS event, {_NAME} AS channel, {_UNIT} AS unit, sample_index, sample_index * 1000000000 AS time_ns, CASE channel WHEN 'view' THEN value / 50 WHEN 'click' THEN value / 50 WHEN 'signup' THEN floor(value) ELSE value END AS value FROM smp),
ch AS (SELECT file, channel AS name, unit, count(*) AS n, row_number() OVER (PARTITION BY file ORDER BY min(event)) - 1 AS channel_id FROM rec GROUP BY file, channel, unit)"""
_LAP = ", CASE WHEN v IS DISTINCT FROM lag(v) OVER w OR lag(time_ns) OVER w IS NULL THEN 1 ELSE 0 END AS fresh"


def _runs(name: str, channel: str) -> str:
    return f"""{name}v AS (SELECT file, time_ns, CAST(round(value) AS BIGINT) AS v FROM rec WHERE channel = '{channel}'),
{name}f AS (SELECT *{_LAP} FROM {name}v WINDOW w AS (PARTITION BY file ORDER BY time_ns)),
{name} AS (SELECT f.file, v, time_ns AS s, coalesce(lead(time_ns) OVER w, ch.n * 1000000000) AS e, row_number() OVER w AS i, count(*) OVER (PARTITION BY f.file) AS n
  FROM {name}f f JOIN ch ON ch.file = f.file AND ch.name = '{channel}' WHERE fresh = 1 WINDOW w AS (PARTITION BY f.file ORDER BY time_ns))"""


_SUMMARY = _FILES + ", " + _runs("lr", "Lap Number") + ", " + _runs("dr", "Driver ID") + """,
lap AS (SELECT file, v AS number, s, e - s AS d, i > 1 AND i < n AS complete FROM lr WHERE v > 0),
bst AS (SELECT file, arg_min(number, (d, s, number)) AS number, min(d) AS d FROM lap WHERE complete AND d >= 10000000000 GROUP BY 1),
fi AS (SELECT file, CAST(split_part(file, '_', 2) AS BIGINT) AS u, max(n) * 1000000000 AS duration_ns, count(*) AS channel_count, CAST(sum(n) AS BIGINT) AS sample_count FROM ch GROUP BY 1),
st AS (SELECT *, (1706781600 + u // 60 % 60 * 60 + u % 60) * 1000000000 AS t0 FROM fi)"""
_SESSIONS = (
    _SUMMARY + """,
hx AS (SELECT file, string_agg(hex(encode(lower(name || unit))) || CASE name WHEN 'Gear' THEN '04' ELSE '07' END, '' ORDER BY channel_id) AS t FROM ch GROUP BY 1),
hb AS (SELECT file, list_transform(generate_series(1, length(t) // 2), lambda i: CAST(('0x' || substr(t, 2 * i - 1, 2)) AS UHUGEINT)) AS b FROM hx),
hs AS (SELECT file, lpad(lower(hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), b), lambda h, x: (xor(h, x) * CAST(1099511628211 AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT)) AS UBIGINT))), 16, '0') AS h FROM hb),
ke AS (SELECT file, 'motec:01/02/2024:car ' || u % 7 || ':test track:' || h AS k, t0 AS a, t0 + duration_ns AS b FROM st JOIN hs USING (file)),
so AS (SELECT *, CASE WHEN a <= lag(b) OVER w + 60000000000 THEN 0 ELSE 1 END AS fresh FROM ke WINDOW w AS (PARTITION BY k ORDER BY a, file)),
g AS (SELECT *, k || ':' || CAST(sum(fresh) OVER (ORDER BY k, a, file) - 1 AS BIGINT) AS session FROM so),
sti AS (SELECT session, v AS driver_id, a + s AS start_ns, a + e AS end_ns FROM dr JOIN g USING (file) WHERE (n = 1 OR e - s >= 1000000000) AND v >= 0),
lpi AS (SELECT session, number, a + s AS start_ns, a + s + d AS end_ns FROM lap JOIN g USING (file)),"""
    + _merged("sti", "session", "driver_id", 60 * _SECOND, "ms") + "," + _merged("lpi", "session", "number", 60 * _SECOND, "ml") + """,
sb AS (SELECT session, min(d) AS d, arg_min(number, (d, file)) AS number FROM bst JOIN g USING (file) GROUP BY 1),
tl AS (SELECT session, count(*) AS lap_count, min(d) FILTER (inside) AS d, arg_min(number, (d, start_ns, number)) FILTER (inside) AS number FROM (
  SELECT *, end_ns - start_ns AS d, lag(number) OVER w IS NOT NULL AND lead(number) OVER w IS NOT NULL AND end_ns - start_ns >= 10000000000 AS inside FROM ml WINDOW w AS (PARTITION BY session ORDER BY start_ns)) GROUP BY 1),
ids AS (SELECT session, string_agg(CAST(driver_id AS VARCHAR), ',' ORDER BY driver_id) AS driver_ids FROM (SELECT DISTINCT session, driver_id FROM sti) GROUP BY 1),
ns AS (SELECT session, count(*) AS stint_count FROM ms GROUP BY 1),
bs AS (SELECT session, count(*) AS file_count, min(a) AS absolute_start_ns, max(b) AS absolute_end_ns FROM g GROUP BY 1)
SELECT session AS session_key, file_count, absolute_start_ns, absolute_end_ns, absolute_end_ns - absolute_start_ns AS duration_ns, coalesce(driver_ids, '') AS driver_ids, coalesce(stint_count, 0) AS stint_count,
  coalesce(lap_count, 0) AS lap_count, coalesce(sb.number, tl.number) AS fastest_lap_number, coalesce(sb.d, tl.d) AS fastest_lap_time_ns
FROM bs LEFT JOIN ids USING (session) LEFT JOIN ns USING (session) LEFT JOIN tl USING (session) LEFT JOIN sb USING (session)"""
)
SQL |= {
    "reader_sessions": _SESSIONS,
    "reader_export": _FILES + """ SELECT file, CASE channel WHEN 'Oil Temp' THEN 'Temperature' ELSE channel END AS channel, CASE channel WHEN 'Oil Temp' THEN 'K' ELSE unit END AS unit, sample_index, round(CASE channel WHEN 'Oil Temp' THEN value + 273.15 ELSE value END, 6) AS value
FROM rec WHERE channel <> 'Gear' AND file IN (SELECT file FROM ch WHERE name = 'Oil Temp')""",
    "reader_samples": _FILES + " SELECT rec.file, 'motec' AS format, channel_id, channel, rec.unit, CASE WHEN rec.unit = '' THEN 'unknown' ELSE 'declared' END AS unit_source, 1.0 AS frequency_hz, sample_index, time_ns, value FROM rec JOIN ch ON ch.file = rec.file AND ch.name = rec.channel",
    "reader_metadata": _FILES + """ SELECT file, channel_id, name, unit, CASE WHEN unit = '' THEN 'unknown' ELSE 'declared' END AS unit_source, nullif(unit, '') AS canonical_unit, CASE unit WHEN 'km/h' THEN 'speed' WHEN 'C' THEN 'temperature' END AS dimension,
CASE name WHEN 'Gear' THEN 'int32' ELSE 'float64' END AS data_type, 1.0 AS frequency_hz, 1000000000 AS sample_period_ns, n AS sample_count, 1 AS chunk_count, n * 1000000000 AS duration_ns FROM ch""",
    "reader_wide": _FILES + """,
g AS (SELECT file, unnest(generate_series(0, 2 * max(n) - 1)) AS r FROM ch WHERE name IN ('Speed', 'Gear') GROUP BY 1),
t AS (SELECT g.file, r * 500000000 AS time_ns, r, a.channel, CASE WHEN r % 2 = 0 OR a.channel = 'Gear' OR b.value IS NULL THEN a.value ELSE a.value + (b.value - a.value) * 0.5 END AS x
  FROM g LEFT JOIN rec a ON a.file = g.file AND a.sample_index = r // 2 AND a.channel IN ('Speed', 'Gear') LEFT JOIN rec b ON b.file = g.file AND b.channel = a.channel AND b.sample_index = r // 2 + 1)
SELECT file, time_ns, round(max(x) FILTER (channel = 'Speed') * 0.5 + 1, 6) AS V, max(x) FILTER (channel = 'Gear') AS "Gear" FROM t GROUP BY 1, 2""",
    "reader_files": _SUMMARY + """,
dri AS (SELECT file, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS driver_ids FROM (SELECT DISTINCT file, v FROM dr WHERE v >= 0 AND (n = 1 OR e - s >= 1000000000)) GROUP BY 1),
cnt AS (SELECT file, count(*) AS lap_count FROM lap GROUP BY 1)
SELECT file, 'motec' AS format, t0 AS absolute_start_ns, t0 + duration_ns AS absolute_end_ns, duration_ns, channel_count, channel_count AS sampled_channel_count, sample_count, coalesce(driver_ids, '') AS driver_ids, coalesce(lap_count, 0) AS lap_count,
  bst.number AS fastest_lap_number, bst.d AS fastest_lap_time_ns, CAST(NULL AS BIGINT) AS video_frame_count, 'D' || u % 9 AS driver, 'car ' || u % 7 AS vehicle, 'Test Track' AS venue, '' AS event, '' AS session, '01/02/2024' AS date,
  printf('10:%02d:%02d', u // 60 % 60, u % 60) AS time, 'utc' AS absolute_clock FROM st LEFT JOIN dri USING (file) LEFT JOIN cnt USING (file) LEFT JOIN bst USING (file)""",
}
