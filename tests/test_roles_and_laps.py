"""Roles, layouts, laps of the browser kind, progress and deltas, drift steps and links on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from tests import tables as T
from tracegrid.channelmap import parse_map, recovered_map
from tracegrid.operators import drift, roles
from tracegrid.operators import events as ev

SEC = 1_000_000_000
DEFS = "file string, channel_id int, name string, sample_count bigint, unit string, data_type string"


def defs(spark, rows):
    return spark.createDataFrame([(f, i, n, k, u, "float64") for f, i, n, k, u in rows], DEFS)


def samples(spark, series):
    return spark.createDataFrame([(f, c, k, t * SEC, None if v is None else float(v)) for (f, c), tv in series.items() for k, (t, v) in enumerate(tv)], "file string, channel_id int, sample_index bigint, time_ns bigint, value double")


def test_signal_roles(spark):
    c = defs(spark, [("f", 1, "Wheel Speed FL", 5, ""), ("f", 2, "GPS Speed", 5, ""), ("f", 3, "Ground Speed", 5, ""), ("f", 4, "Brake Temp", 5, ""), ("f", 5, "Throttle", 0, ""), ("f", 6, None, 5, None), ("g", 1, "my velocity", 1, ""), ("g", 2, "G Force Lat", 1, "g")])
    got = {(r.file, r.role): r.name for r in roles.signal_roles(c).collect()}
    assert got == {("f", "speed"): "Ground Speed", ("f", "brake"): "Brake Temp", ("g", "speed"): "my velocity", ("g", "gLat"): "G Force Lat"}
    assert roles.signal_roles(c.limit(0)).count() == 0


def test_common_channels_and_signature(spark):
    c = defs(spark, [("f", 1, "RPM", 5, ""), ("f", 2, "Engine Speed", 5, ""), ("f", 3, "x", 5, ""), *[("g", i, f"odd {i}", 1, "") for i in range(9, 0, -1)]])
    got = sorted((r.file, r.part, r.name) for r in roles.common_channels(c).collect())
    assert got == [("f", "rpm", "Engine Speed"), *[("g", "other", f"odd {i}") for i in range(1, 5)]]
    h = 5381
    for ch in "enginespeed|rpm|x":
        h = (h * 33 % 2**32) ^ ord(ch)
    assert {r.file: r.signature for r in roles.layout_signature(c).collect()}["f"] == h


def test_helpers_by_unit_text(spark):
    d = spark.createDataFrame([(10.0, "m/s"), (10.0, "MPH"), (10.0, "km/h"), (10.0, None), (9.80665, "m/s^2"), (1.5, "G")], "v double, u string")
    got = d.select(F.round(roles.speed_to_kmh(F.col("v"), F.col("u")), 4).alias("s"), F.round(roles.acceleration_to_g(F.col("v"), F.col("u")), 4).alias("g")).collect()
    assert [r.s for r in got[:4]] == [36.0, 16.0934, 10.0, 10.0] and [r.g for r in got[4:]] == [1.0, 1.5]


def test_gps_track(spark):
    c = defs(spark, [("f", 1, "GPS Latitude", 9, ""), ("f", 2, "GPS_Longitude", 9, ""), ("g", 1, "lat", 9, "")])
    s = samples(spark, {("f", 1): [(0, 1), (1, 0), (2, 95), (3, 4), (4, None)], ("f", 2): [(0, 2), (1, 0), (3, 181), (4, 5)], ("g", 1): [(0, 1)]})
    assert [r[:] for r in roles.gps_track(s, c).orderBy("time_ns").collect()] == [("f", 0, 1.0, 2.0)]


def test_laps_by_the_first_of_four_signs(spark):
    c = defs(spark, [("a", 1, "Lap Number", 9, ""), ("b", 1, "Lap Time", 9, ""), ("c", 1, "Lap Distance", 9, ""), ("d", 1, "Lap Number", 9, ""), ("e", 1, "Lap Distance", 9, "")])
    s = samples(spark, {
        ("a", 1): [(0, 1), (5, 1), (10, 2), (20, 3)], ("b", 1): [(0, 0), (10, 90), (11, 1), (13, 9), (14, 1), (30, 80), (31, 2)], ("c", 1): [(0, 0), (10, 500), (11, 490), (12, 3)], ("d", 1): [(0, 4), (5, 4)], ("e", 1): [(0, 9), (1, 5)],
    })
    ends = spark.createDataFrame([(f, 40 * SEC) for f in "abcde"], "file string, duration_ns bigint")
    gates = spark.createDataFrame([("e", 7 * SEC), ("a", 3 * SEC)], "file string, time_ns bigint")
    got = sorted((r.file, r.number, r.start_ns // SEC, r.end_ns // SEC, r.complete) for r in ev.laps_browser(s, c, ends, gates).collect())
    assert got == [
        ("a", 1, 0, 10, False), ("a", 2, 10, 20, True), ("a", 3, 20, 40, False),
        ("b", 1, 0, 11, False), ("b", 2, 11, 31, True), ("b", 3, 31, 40, False),
        ("c", 1, 0, 12, False), ("c", 2, 12, 40, False), ("d", 1, 0, 40, True), ("e", 1, 0, 7, False), ("e", 2, 7, 40, False),
    ]


def test_trace_rate(spark):
    d = spark.createDataFrame([(0,), (10 * SEC,), (90 * SEC,), (7000 * SEC,)], "d bigint")
    assert [r[0] for r in d.select(ev.trace_rate(F.col("d"))).collect()] == [100, 100, 56, 10]


def test_progress_and_delta_by_distance(spark):
    laps = spark.createDataFrame([("f", 1, 0, 10 * SEC), ("f", 2, 10 * SEC, 22 * SEC), ("g", 1, 0, 10 * SEC)], "file string, number bigint, start_ns bigint, end_ns bigint")
    s = samples(spark, {("f", 1): [(0, 0), (5, 50), (9, 100), (10, 0), (16, 50), (20, 100)], ("g", 1): [(0, 7), (4, 7), (8, None)]})
    p = ev.distance_progress(s, laps)
    got = sorted((r.file, r.number, r.time_ns // SEC, r.progress) for r in p.collect())
    assert got == [("f", 1, 0, 0.0), ("f", 1, 5, 0.5), ("f", 1, 9, 1.0), ("f", 2, 10, 0.0), ("f", 2, 16, 0.5), ("f", 2, 20, 1.0), ("g", 1, 0, 0.0), ("g", 1, 4, 0.5), ("g", 1, 8, 1.0)]
    d = ev.lap_deltas(p, laps.where("number = 1 and file = 'f'"))
    assert sorted((r.number, r.time_ns // SEC, r.delta_ns // SEC) for r in d.collect()) == [(1, 0, 0), (1, 5, 0), (1, 9, 0), (2, 10, 0), (2, 16, 1), (2, 20, 1)]


def test_lap_markers_per_file(spark):
    rows = [("a", "Lap Trigger", t, v) for t, v in ((0, 0), (1, 1), (2, 0), (9, 1))] + [("b", "Lap Trigger", 0, 0), ("b", "lap_number", 0, 1), ("b", "lap_number", 8, 2)] + [("a", "lap_number", 0, 1), ("a", "lap_number", 3, 2)]
    s = spark.createDataFrame([(f, c, t * SEC, float(v)) for f, c, t, v in rows], "file string, channel string, time_ns bigint, value double")
    assert sorted((r.file, r.time_ns // SEC) for r in ev.lap_markers(s).collect()) == [("a", 1), ("a", 9), ("b", 8)]


def test_greedy_spacing_by_brute_force(spark):
    r = np.random.default_rng(6)
    t = {k: np.unique(r.integers(0, 2000, 300)) for k in "ab"}
    df = spark.createDataFrame([(k, int(x) * SEC) for k, v in t.items() for x in v], "file string, time_ns bigint")
    expected = []
    for k, v in t.items():
        last = None
        for x in v.tolist():
            if last is None or x - last >= 9:
                expected.append((k, x))
                last = x
    assert sorted((x.file, x.time_ns // SEC) for x in ev.spaced(df, ["file"], 9 * SEC).collect()) == sorted(expected)


def test_reported_laps_are_held_against_the_reference(spark):
    laps = spark.createDataFrame([("f", 1, 0, 60 * SEC, 60 * SEC, True), ("f", 2, 60 * SEC, 100 * SEC, 40 * SEC, True)], "file string, number bigint, start_ns bigint, end_ns bigint, duration_ns bigint, complete boolean")
    s = lambda tv: spark.createDataFrame([("f", t * SEC, float(v)) for t, v in tv], "file string, time_ns bigint, value double")
    reference = ev.reference_lap(s([(0, 0.0), (1, 90.0004), (2, 70.0)]))
    assert reference.first().reference_ns == 90_000_400_000
    reported = ev.lap_at(s([(70, 44.0), (110, 58.0), (120, 58.0)]), s([(0, 1), (60, 2), (100, 3)])).withColumnRenamed("lap", "number")
    assert ev.fastest_lap(laps, reference).first()[:] == ("f", 1, 60 * SEC)
    # 44 s is less than half the reference; the first of two equal times counts, whose lap is the one before.
    assert ev.fastest_lap(laps, reference, reported).first()[:] == ("f", 2, 58 * SEC)
    assert ev.fastest_lap(laps, None, reported).first()[:] == ("f", 1, 44 * SEC)


def test_common_types():
    c = drift.common_type
    assert c(["int16", "uint16"]) == "int32" and c(["int32", "uint32"]) == "float64" and c(["uint8", "int16"]) == "int16" and c(["uint8", "uint16"]) == "uint16"
    assert c(["float32", "int16"]) == "float32" and c(["float32", "int32"]) == "float64" and c(["float32"]) == "float32" and c(["strange", "int16"]) == "float64"
    bits = {t: (-(2 ** (int(t[3:]) - 1)), 2 ** (int(t[3:]) - 1) - 1) if t.startswith("int") else (0, 2 ** int(t[4:]) - 1) for t in drift.TYPES if "int" in t}
    for a in bits:
        for b in bits:
            k = c(sorted({a, b}))
            if k in bits:
                assert bits[k][0] <= min(bits[a][0], bits[b][0]) and bits[k][1] >= max(bits[a][1], bits[b][1])


def test_migrations_and_cast_samples(spark):
    rows = [("f1", 1, "DMP_F1", "", "declared", "int16"), ("f2", 1, "FDamp", "", "declared", "uint16"), ("f2", 2, "Gear", "", "", "int16"), ("f3", 1, "FDamp", "", "declared", "uint16"), ("f3", 2, "Gear", "", "x", "int16")]
    c = T.channels(spark, rows)
    g = spark.createDataFrame([(f, "L", i, None, None, None, None, None, "a", "b", "c") for i, f in enumerate(("f1", "f2", "f3"))], T.FILES)
    t = drift.consistent_channels(c, g, *T.reference(spark))
    got = {(r.file, r.channel_id): (r.column_name, r.common_type, r.unit_source, r.version) for r in t.collect()}
    assert {got[f, 1] for f in ("f1", "f2", "f3")} == {("dmpf1", "int32", "declared", v) for v in (1, 2, 3)} and got["f2", 2] == ("gear", "int16", "unknown", 2)
    steps = sorted((r.from_version, r.to_version, r.column_name, r.step, r.files) for r in drift.migration_steps(c, g, *T.reference(spark)).collect())
    assert steps == [(1, 2, "dmpf1", "cast", 1), (1, 2, "dmpf1", "rename", 1), (1, 2, "gear", "add", 1), (2, 3, "gear", "default", 1)]
    s = T.samples(spark, {("f1", 1): ("DMP_F1", "", [1.4, 2.6, 1e12, None], None), ("f2", 2): ("Gear", "", [3.0], None), ("f9", 9): ("x", "", [1.0], None)})
    cast = sorted((r.file, r.column_name, r.sample_index, r.value) for r in drift.consistent_samples(s, t).collect())
    assert cast[:3] == [("f1", "dmpf1", 0, 1.0), ("f1", "dmpf1", 1, 3.0), ("f1", "dmpf1", 2, None)] and cast[3][3] is None and cast[4] == ("f2", "gear", 0, 3.0)
    assert drift.migration_steps(c.limit(0), g, *T.reference(spark)).count() == 0


def test_recovered_map_reads_back(spark):
    c = defs(spark, [("f", 2, "b", 1, "km/h"), ("f", 1, "a c", 1, None)])
    text = recovered_map(c).first().map
    assert text == "a c -> a c; b -> b [km/h]" and [(r.source, r.target, r.unit) for r in parse_map(text)] == [("a c", "a c", None), ("b", "b", "km/h")]


def test_parquet_footer_keys(spark, tmp_path):
    from tracegrid import units
    from tracegrid.sources import sinks

    path = str(tmp_path / "p")
    sinks.write_parquet(units.tag_unit(spark.createDataFrame([(1.0,), (2.0,)], "v double").repartition(2), "v", "km/h"), path)
    assert sinks.write_parquet_footer(path, {"v": "unit=km/h; native_frequency_hz=10"}) == 2
    assert sinks.parquet_footer(path)["v"] == "unit=km/h; native_frequency_hz=10" and sinks.parquet_units(spark, path) == {"v": "km/h"}
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 2]
    got = spark.createDataFrame([(sinks.parquet_footer(path)["v"],)], "t string").select(units.can_convert(F.regexp_extract("t", "unit=([^;]*)", 1), F.lit("m/s"))).first()[0]
    assert got is True
    # The same through a table's column comment.
    spark.sql("create or replace temporary view q as select 1")
    spark.range(1).withColumnRenamed("id", "v").write.mode("overwrite").option("path", str(tmp_path / "t")).saveAsTable("commented")
    spark.sql("alter table commented alter column v comment 'unit=bar'")
    assert [c.description for c in spark.catalog.listColumns("commented")] == ["unit=bar"]
    spark.sql("drop table commented")


def test_control_forms(spark):
    # Variables, version and a raised error stand for those of the host.
    spark.sql("declare or replace variable from_file string default 'a.ld'")
    assert spark.sql("select from_file, length(version()) > 0").first()[:] == ("a.ld", True)
    try:
        spark.sql("select if(from_file = '', '', raise_error('set the input'))").collect()
    except Exception as e:
        assert "set the input" in str(e)
    spark.sql("drop temporary variable from_file")


def test_inspector(tmp_path):
    from tracegrid.inspect import describe
    from tracegrid.sources.formats import ld
    from tracegrid.sources.formats.common import Channel, Chunk

    path = tmp_path / "a.ld"
    path.write_bytes(ld.encode([Channel(0, "Lap", "", "declared", 7, [Chunk(SEC, 3, 0, 0, 0)], None, np.array([1.0, 1, 2])), Channel(1, "Speed", "km/h", "declared", 6, [Chunk(SEC, 3, 0, 0, 0)], None, np.zeros(3))]))
    text = describe(str(path))
    assert "lap_count: 2" in text and "Speed" in text and "float32" in text


def test_headers_alone_tell_the_definitions(tmp_path, monkeypatch):
    from tracegrid.sources import recordings as R
    from tracegrid.sources.formats import ld, pds, vbo
    from tracegrid.sources.formats.common import Channel, Chunk

    ch = [Channel(i, n, "m", "declared", 7, [Chunk(SEC, 4, 0, 0, 0)], None, np.arange(4.0)) for i, n in enumerate(("a", "b"))]
    for name, codec in (("x.ld", ld), ("x.pds", pds), ("x.vbo", vbo)):
        p = tmp_path / name
        p.write_bytes(codec.encode(ch))
        heads, whole, one = R.open_recording(str(p), False), R.open_recording(str(p)), R.open_recording(str(p), lambda n: n == "b")
        assert R._channel_rows("p", heads) == R._channel_rows("p", whole)
        assert all(c.values is None for c in heads.channels) and [c.values is not None for c in one.channels] == [c.name == "b" for c in one.channels]
