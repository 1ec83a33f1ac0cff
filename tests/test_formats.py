import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.sources import recordings as R
from tracegrid.sources import sinks
from tracegrid.sources.formats import aim, ld, ldx, pds, vbo
from tracegrid.sources.formats.common import Channel, Chunk, FormatError
from tracegrid.sources.paths import find_files, parse_stamp

SEC = 1_000_000_000
VBO = b"""[column names]
sats time lat long velocity heading height vert-vel Tsample solution_type avifileindex avitime throttle gforce
[channel units]
%
(null)
[data]
9 235959.5 43.7978 -87.9899 10.0 90 291.74 0 0.5 3 0 0 0.0 0.1
9 000000.0 43.7979 -87.9898 20.0 90 291.74 0 0.5 3 0 0 50.0 oops
9
9 000001.0 43.798 -87.9897 30.0 90 291.74 0 0.5 3 0 0 100.0
"""


def channels():
    two = [Chunk(SEC, 2, 0, 0, 0), Chunk(SEC, 2, 0, 2, 2 * SEC)]
    data = [("Speed", "m/s", [10, 11, 12, 13]), ("Throttle Pos", "%", [0, 50, 100, 25]), ("Gear", "", [1, 2, 2, 3])]
    return [Channel(i + 1, n, u, "declared", 7, list(two), None, np.array(v, float)) for i, (n, u, v) in enumerate(data)]


def test_vbo():
    r = vbo.decode(VBO)
    by = {c.name: c for c in r.channels}
    assert by["velocity kmh"].values.tolist() == [10, 20, 30] and by["velocity kmh"].unit == "km/h"
    assert by["time"].values.tolist() == [0, 0.5, 1.5] and by["time"].times.tolist() == [0, SEC // 2, 3 * SEC // 2]
    assert by["throttle"].unit == "%" and by["gforce"].unit == "" and np.isnan(by["gforce"].values[1:]).all()
    assert by["throttle"].duration_ns == 2 * SEC and r.session_hint == "vbo:time_of_day"
    for bad in (b"", b"[column names]\nsats\n[data]\n1 2", b"[column names]\nsats time\n[data]\n1", b"[column names]\nsats time\n[data]\n1 x"):
        with pytest.raises(FormatError):
            vbo.decode(bad)


def test_pds_round_trip():
    r = pds.decode(pds.encode(channels()))
    assert [(c.name, c.unit, c.values.tolist(), len(c.chunks)) for c in r.channels] == [(c.name, c.unit, c.values.tolist(), 2) for c in channels()]
    assert r.channels[0].time_ns().tolist() == [0, SEC, 2 * SEC, 3 * SEC]
    for bad in (b"", b"\0" * 300):
        with pytest.raises(FormatError):
            pds.decode(bad)


@pytest.mark.parametrize("code", range(1, 8))
def test_ld_keeps_every_bit(code):
    name, dtype = {1: ("uint8", "u1"), 2: ("int16", "i2"), 3: ("uint16", "u2"), 4: ("int32", "i4"), 5: ("uint32", "u4"), 6: ("float32", "f4"), 7: ("float64", "f8")}[code]
    t = np.dtype(dtype)
    x = np.array([np.finfo(t).min, -0.1, 0, 1 / 3, np.finfo(t).max], t) if t.kind == "f" else np.array([np.iinfo(t).min, 0, 1, np.iinfo(t).max], t)
    c = Channel(0, "x", "bar", "declared", code, [Chunk(10_000_000, len(x), 0, 0, 0)], None, x.astype(float))
    back = ld.decode(ld.encode([c])).channels[0]
    assert back.values.tobytes() == x.astype(float).tobytes() and back.chunks[0].period_ns == 10_000_000


def test_ld_scaled_integers_and_identity():
    raw = bytearray(ld.encode([Channel(0, "x", "", "", 2, [Chunk(SEC, 1, 0, 0, 0)], None, np.array([423.0]))], ld.Identity(driver="Ann", date="01/02/2024", time="10:00:01", venue="Ring", event="Cup")))
    at = struct.unpack_from("<I", raw, 8)[0]
    struct.pack_into("<hhhh", raw, at + 0x18, 0, 1, 1, 1)
    r = ld.decode(bytes(raw))
    assert r.channels[0].values[0] == pytest.approx(42.3) and r.driver == "Ann" and r.event == "Cup" and r.start_ns == 1706781601 * SEC and r.session_hint == "motec:01/02/2024::ring"


@pytest.mark.parametrize(
    ("chunks", "name", "message"),
    [([Chunk(0, 2, 0, 0, 0)], "x", "period"), ([Chunk(SEC, 1, 0, 0, 0), Chunk(2 * SEC, 1, 0, 1, SEC)], "x", "period"), ([Chunk(3 * SEC, 2, 0, 0, 0)], "x", "whole number"), ([Chunk(10_000, 2, 0, 0, 0)], "x", "too fast"), ([Chunk(SEC, 1, 0, 0, 0), Chunk(SEC, 1, 0, 1, 5 * SEC)], "x", "belongs to none"), ([Chunk(SEC, 2, 0, 0, 0)], "x" * 40, "longer"), ([Chunk(SEC, 2, 0, 0, 0)], "温", "characters"), ([], "x", "nothing")],
)
def test_ld_refuses(chunks, name, message):
    with pytest.raises(FormatError, match=message):
        ld.encode([Channel(0, name, "", "", 7, chunks, None, np.zeros(2))])


def test_ld_rejects_other_bytes():
    for bad in (b"", b"\x40" + b"\0" * 0x200, b"x" * 0x300):
        with pytest.raises(FormatError):
            ld.decode(bad)


def gps():
    g = np.zeros(1, aim.GPS_RECORD)
    g["stamp"], g["itow"], g["week"], g["packed"], g["position_accuracy"], g["speed_accuracy"], g["flags"] = 100, 573634560, 2429, 0x090000F8, 783, 6, 4096
    g["position"], g["velocity"] = (16174352, -460842617, 439210627), (5, -10, 8)
    return g.tobytes()


def test_aim():
    r = aim.decode(aim.encode([(42, "RPM", [(100, 5000.0), (140, 5100.0)]), (43, "DRIVER_ID", [(100, 3.0)])], [gps()]))
    by = {c.name: c for c in r.channels}
    assert len(r.channels) == 17 and by["RPM"].values.tolist() == [5000, 5100] and by["RPM"].time_ns().tolist() == [0, 40_000_000]
    assert by["GPS Latitude"].values[0] == pytest.approx(43.797816, abs=1e-6) and by["GPS Longitude"].values[0] == pytest.approx(-87.989895, abs=1e-6)
    assert by["GPS Speed"].values[0] == pytest.approx(0.137477, abs=1e-6) and by["GPS Satellites"].values[0] == 9 and by["GPS DOP"].values[0] == 2.48
    assert r.frames.tolist() == [0, 40_000_000, 80_000_000]
    assert [(k.count, k.base, k.time_base_ns, k.period_ns) for k in aim.period_chunks(np.array([0, 10, 20, 31, 90, 100]))] == [(4, 0, 0, 10), (2, 4, 90, 10)]
    for bad in (b"", b"\0\0\0\x08ftyp", aim.encode([(1, "x", [(0, 1.0)])])[:-40]):
        with pytest.raises(FormatError):
            aim.decode(bad)


def test_sidecar():
    text = ldx.sidecar([1 * SEC, 7 * SEC, 13 * SEC], {"Driver": 'A "B"'})
    assert 'Total Laps" Value="4"' in text and 'Fastest Time" Value="0:06.000"' in text and 'Fastest Lap" Value="2"' in text
    import xml.etree.ElementTree as E

    assert len(E.fromstring(text).findall(".//Marker")) == 3 and ldx.sidecar_path("a.ld") == "a.ldx"


@pytest.fixture()
def logs(tmp_path):
    (tmp_path / "a.pds").write_bytes(pds.encode(channels()))
    (tmp_path / "b.ld").write_bytes(ld.encode(channels()))
    (tmp_path / "c.vbo").write_bytes(VBO)
    (tmp_path / "d.mp4").write_bytes(aim.encode([(42, "RPM", [(100, 5000.0)])], [gps()]))
    (tmp_path / "e.txt").write_text("no")
    return tmp_path


def test_paths(logs):
    assert [f[-1] for f in find_files(f"{logs}/*")] == ["s", "d", "o", "4"] and len(find_files(f"{logs}/{{a.pds,b.ld}}")) == 2 and len(find_files(str(logs), only="motec")) == 1
    for bad, kw in ((f"{logs}/*.xyz", {}), (f"{logs}/e.txt", {}), (f"{logs}/*", {"created_to": "1999-01-01"}), (f"{logs}/*", {"created_from": "2020-01-02", "created_to": "2020-01-01"}), (f"{logs}/*", {"created_from": "soon"})):
        with pytest.raises(ValueError):
            find_files(bad, **kw)
    assert parse_stamp("2024-01-01 10:00:00.5") == parse_stamp("2024-01-01T10:00:00.5Z")


def test_data_source(spark, logs):
    s = R.read(spark, f"{logs}/*")
    assert {(r.format, r["count"]) for r in s.groupBy("format").count().collect()} == {("pds", 12), ("motec", 12), ("vbo", 42), ("aimd", 16)}
    assert [r.value for r in R.read(spark, f"{logs}/a.pds", channels="SPEED", start_ns=SEC, end_ns=3 * SEC).orderBy("time_ns").collect()] == [11, 12]
    assert s.where("channel = 'Speed' and time_ns >= 1000000000").count() == 6
    assert R.read(spark, f"{logs}/a.pds", splits=3).count() == 12
    ch = {r.name: r for r in R.read(spark, f"{logs}/b.ld", "channels").collect()}
    assert ch["Speed"].dimension == "speed" and ch["Gear"].canonical_unit is None and ch["Speed"].duration_ns == 4 * SEC
    assert R.read(spark, f"{logs}/d.mp4", "files").first().video_frame_count == 3 and R.read(spark, f"{logs}/a.pds", "chunks").count() == 6
    assert R.read_bytes(spark, f"{logs}/b.ld").count() == 12
    for kw in ({"channels": "nope"}, {"start_ns": 5, "end_ns": 1}):
        with pytest.raises(Exception, match="not found|lies before"):
            R.read(spark, f"{logs}/a.pds", **kw).count()


def test_wide(spark, logs):
    w = R.read_wide(spark, f"{logs}/a.pds", rate=2, end_ns=3 * SEC).orderBy("time_ns").collect()
    assert [r.Speed for r in w] == [10, 10.5, 11, 11.5, 12, 12.5] and [r.Gear for r in w] == [1, 1, 2, 2, 2, 2]
    p = R.read_cosworth(spark, f"{logs}/*", rate=2, interpolate="previous", channels="speed")
    assert [r.Speed for r in p.orderBy("time_ns").collect()] == [10, 10, 11, 11, 12, 12, 13, 13]
    m = R.read_wide(spark, f"{logs}/{{a.pds,b.ld}}", rate=1, channels="Speed", channel_map="speed -> v [km/h] * 3.6", unit_tags=True, filename=True)
    assert m.schema["v"].metadata == {"telemetry_unit": "km/h"} and [round(r.v, 6) for r in m.where(F.col("filename").endswith("ld")).orderBy("time_ns").collect()] == [36, 39.6, 43.2, 46.8]
    v = R.read_vbo(spark, f"{logs}/*", rate=1, channels="velocity kmh").orderBy("time_ns").collect()
    assert [r["velocity kmh"] for r in v] == [10, 25]
    for kw in ({"rate": 0}, {"interpolate": "cubic"}, {"channels": "nope"}, {"channel_map": "nope -> x"}):
        with pytest.raises(ValueError):
            R.read_wide(spark, f"{logs}/a.pds", **kw)


def test_no_channel_is_dropped_unseen(spark, logs, tmp_path, monkeypatch):
    from tracegrid.sources import library

    late = [Channel(9, "SPEED", "km/h", "declared", 7, [Chunk(SEC, 2, 0, 0, 0)], None, np.array([36.0, 72.0])), Channel(2, "Lap", "", "declared", 7, [Chunk(SEC, 2, 0, 0, 0)], None, np.array([1.0, 2.0]))]
    (logs / "z.pds").write_bytes(pds.encode(late))
    path = f"{logs}/{{a.pds,b.ld,z.pds}}"
    # Eight definitions, five names and units: the bound counts the latter.
    monkeypatch.setattr(R, "MOST_NAMES", 5)
    w = R.read_wide(spark, path, rate=1, unit_tags=True)
    assert w.columns == ["time_ns", "Speed", "Throttle Pos", "Gear", "Lap"] and w.schema["Speed"].metadata == {}
    assert sorted(r.Lap for r in w.where("Lap is not null").collect()) == [1, 2]
    monkeypatch.setattr(R, "MOST_NAMES", 4)
    with pytest.raises(ValueError, match="more than 4 rows"):
        R.read_wide(spark, path, rate=1)
    monkeypatch.setattr(R, "MOST_NAMES", 1)
    assert R.read(spark, path, channels="Gear").count() == 8
    with pytest.raises(ValueError, match="more than 1 rows"):
        R.read(spark, path, channels="Speed")
    monkeypatch.setattr(library, "MOST_NAMES", 0)
    with pytest.raises(ValueError, match="more than 0 rows"):
        library.Library(spark, path).role("lap")
    monkeypatch.setattr(sinks, "MOST_MARKERS", 2)
    with pytest.raises(ValueError, match="more than 2 rows"):
        sinks.write_recording(R.read(spark, f"{logs}/a.pds"), str(tmp_path / "o.ld"), markers=spark.range(3).withColumnRenamed("id", "time_ns"))
    monkeypatch.setattr(sinks, "MOST_SAMPLES", 11)
    with pytest.raises(FormatError, match="more than 11"):
        sinks.write_recording(R.read(spark, f"{logs}/a.pds"), str(tmp_path / "o.ld"))


def test_export(spark, logs, tmp_path):
    out = str(tmp_path / "out.ld")
    row = sinks.write_recording(R.read(spark, f"{logs}/a.pds"), out, "a.pds", driver="Ann").first()
    assert (row.channels, row.samples) == (3, 12)
    a = {(r.channel, r.sample_index): r.value for r in R.read(spark, f"{logs}/a.pds").collect()}
    assert {(r.channel, r.sample_index): r.value for r in R.read(spark, out).collect()} == a and 'Value="Ann"' in open(row.sidecar).read()
    with pytest.raises(ValueError):
        sinks.write_recording(R.read(spark, f"{logs}/a.pds"), "x.vbo")


def test_sql_surface(spark, logs, tmp_path):
    from tracegrid import sql

    sql.install(spark)
    q = lambda text: spark.sql(text).collect()
    assert spark.sql(f"select * from telemetry_samples('{logs}/a.pds', channel => 'speed')").count() == 4
    assert q(f"select distinct channel, unit from telemetry_samples('{logs}/a.pds', channel => 'speed', start_ns => 1000000000, end_ns => 3000000000, channel_map => 'Speed -> V [km/h] * 3.6')")[0][:] == ("V", "km/h")
    assert spark.sql(f"select s.* from telemetry_files('{logs}/*.{{pds,ld}}') f, lateral telemetry_samples(f.file) s").count() == spark.sql(f"select * from telemetry_samples('{logs}/*.{{pds,ld}}')").count()
    assert q(f"select name, unit, canonical_unit from telemetry_metadata('{logs}/a.pds', channels => 'speed', channel_map => 'Speed -> V [kph]')")[0][:] == ("V", "kph", "km/h")
    assert [r.Speed for r in q(f"select Speed from read_telemetry('{logs}/a.pds', rate => 2, channels => 'Speed') order by time_ns limit 3")] == [10, 10.5, 11]
    w = spark.sql(f"select * from read_telemetry('{logs}/a.pds', rate => 1, channels => 'Speed', start_ns => 1000000000, end_ns => 3000000000, filename => true, timestamps => true, unit_tags => true, channel_map => 'Speed -> V [km/h] * 3.6')")
    assert w.columns == ["filename", "create_date", "modified_at", "time_ns", "V"] and [round(r.V, 6) for r in w.orderBy("time_ns").collect()] == [39.6, 43.2]
    w.createOrReplaceTempView("tagged")
    back = spark.sql("select * from telemetry_convert_column(table(tagged), 'V', 'm/s')")
    assert [round(r.V, 6) for r in back.orderBy("time_ns").collect()] == [11, 12] and back.schema["V"].metadata["telemetry_unit"] == "m/s"
    with pytest.raises(Exception, match="carries no unit"):
        spark.sql("select * from telemetry_convert_column(table(select V * 2 as V from tagged), 'V', 'm/s')").collect()
    assert q("select telemetry_convert(36D, 'km/h', 'm/s'), telemetry_can_convert('bar', 's'), telemetry_convert(null, 'bar', 's'), isnan(telemetry_convert(double('nan'), 'C', 'K'))")[0][:] == (10.0, False, None, True)
    assert "Python" not in spark.sql("select telemetry_convert(id, 'km/h', 'm/s') from range(3)")._jdf.queryExecution().executedPlan().toString()
    assert spark.sql(f"select * from read_vbo('{logs}/*', rate => 1)").count() == 2 and spark.sql(f"select * from read_motec('{logs}/*', rate => 1)").count() == 4
    assert q("select count(*) from telemetry_units()")[0][0] == 249
    assert q(f"select kv_metadata from telemetry_column_comments('{logs}/a.pds', 'lap', channels => 'Speed')")[0][0] == "unit=m/s; native_frequency_hz=1; native_sample_period_ns=1000000000"
    rule = q(f"select column_name, channel_map_rule from telemetry_column_comments('{logs}/a.pds', 'lap', channels => 'v', channel_map => 'Speed -> V')")[0]
    assert rule[:] == ("V", "Speed -> V [m/s]")
    out = q(f"select * from write_telemetry('{logs}/a.pds', '{tmp_path}/o.ld', channel_mapping => array(array('Speed', 'Ground Speed', 'km/h')), exclude_channels => array('Gear'), sum_channels => array(array('Speed', 'Speed', 'Twice', 'm/s')), driver => 'Ann', vehicle_number => '7', team => 'T')")[0]
    assert (out.channels, out.samples) == (3, 12) and 'Id="Vehicle Number" Value="7"' in open(out.sidecar).read()
    got = {r.channel: r.unit for r in q(f"select distinct channel, unit from telemetry_samples('{tmp_path}/o.ld')")}
    assert got["Ground Speed"] == "km/h" and got["Twice"] == "m/s" and "Gear" not in got
    assert [round(r.value, 5) for r in q(f"select value from telemetry_samples('{tmp_path}/o.ld', channel => 'Ground Speed') order by time_ns")] == [36, 39.6, 43.2, 46.8]
    for bad in (f"telemetry_samples('{logs}/a.pds', channel => 'nope')", f"read_telemetry('{logs}/a.pds', rate => 0)", f"read_telemetry('{logs}/a.pds', colour => 1)", f"read_telemetry_session('{logs}/*')", f"telemetry_session_metadata('{logs}/*', max_gap_seconds => 90000)", f"write_telemetry('{logs}/a.pds', '{tmp_path}/o.vbo')"):
        with pytest.raises(Exception):  # noqa: B017
            spark.sql(f"select * from {bad}").collect()
    with pytest.raises(Exception, match="unknown unit"):
        spark.sql("select telemetry_convert(36D, 'x', 'm/s')").collect()
    assert {"telemetry_convert", "telemetry_can_convert"} <= {r[0] for r in q("show user functions")}


def test_library(spark, tmp_path):
    from tracegrid.sources.library import Library

    for k, itow in enumerate((573634560, 573634760)):
        g = np.frombuffer(gps(), aim.GPS_RECORD).copy()
        g["itow"] = itow
        (tmp_path / f"part{k}.mp4").write_bytes(aim.encode([(42, "RPM", [(100, 5000.0 + k)]), (43, "DRIVER_ID", [(100, 3.0)]), (44, "Lap_Number", [(100, 1.0)])], [g.tobytes()]))
    lib = Library(spark, f"{tmp_path}/*.mp4")
    f = lib.file_metadata().orderBy("file").collect()
    assert [r.absolute_start_ns for r in f] == [(2429 * 604_800_000 + i) * 1_000_000 for i in (573634560, 573634760)] and f[0].driver_ids == "3" and f[0].absolute_clock == "gps" and f[0].video_frame_count == 3
    assert f[0].session_key == f[1].session_key and f[0].session_key.startswith("gps:2429:") and f[0].channel_count == 18
    m = lib.session_metadata(1).collect()
    assert len(m) == 1 and (m[0].file_count, m[0].driver_ids, m[0].lap_count) == (2, "3", 1)
    s = lib.read_session(rate=20, channels="RPM", max_gap_seconds=1).orderBy("source_file", "time_ns").collect()
    assert len({r.source_file for r in s}) == 2 and (s[0].video_frame_index, s[0].driver_id, s[0].lap_number, s[0].RPM) == (0, 3, 1, 5000.0)
    assert {r.time_ns - r.file_time_ns for r in s if r.source_file.endswith("part1.mp4")} == {200_000_000}
    # The table functions say the same without a cluster.
    from tracegrid import sql

    sql.install(spark)
    local = spark.sql(f"select * from telemetry_file_metadata('{tmp_path}/*.mp4')")
    assert local.columns == lib.file_metadata().columns and [tuple(r) for r in local.orderBy("file").collect()] == [tuple(r) for r in f]
    assert [tuple(r) for r in spark.sql(f"select * from telemetry_session_metadata('{tmp_path}/*.mp4', max_gap_seconds => 1)").collect()] == [tuple(r) for r in m]
    t = spark.sql(f"select * from read_telemetry_session('{tmp_path}/*.mp4', rate => 20, channels => 'RPM', max_gap_seconds => 1)")
    assert t.columns == s[0].__fields__ and [tuple(r) for r in t.orderBy("source_file", "time_ns").collect()] == [tuple(r) for r in s]
    with pytest.raises(ValueError, match="unknown options"):
        Library(spark, str(tmp_path), format="x")
