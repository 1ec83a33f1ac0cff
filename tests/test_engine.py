import pytest
from pyspark.sql import functions as F

from tracegrid.operators import events as ev
from tracegrid.operators import resample as rs
from tracegrid.operators import sessions as se

SEC = 1_000_000_000


def series(spark, values, name="x", step=SEC, data_type="float64", times=None, file="f"):
    rows = [(file, name, i, (times or [k * step for k in range(len(values))])[i], None if v is None else float(v), len(values) * step if times is None else times[-1] + step, data_type, "m") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "file string, channel string, sample_index bigint, time_ns bigint, value double, duration_ns bigint, data_type string, unit string")


def ticks(df):
    return [r.value for r in df.orderBy("channel", "tick").collect()]


def test_interpolation_by_kind(spark):
    assert ticks(rs.resample(series(spark, [10, 20]), rate=2)) == [10, 15, 20, 20]
    assert ticks(rs.resample(series(spark, [10, 20], data_type="int32"), rate=2)) == [10, 10, 20, 20]
    assert ticks(rs.resample(series(spark, [10, 20], name="Lap Number"), rate=2)) == [10, 10, 20, 20]
    assert ticks(rs.resample(series(spark, [10, 20]), rate=2, interpolate="previous")) == [10, 10, 20, 20]
    assert ticks(rs.resample(series(spark, [10, 20, 40], times=[0, SEC // 2, 3 * SEC // 2]), rate=1)) == [10, 30, 40]
    assert ticks(rs.resample(series(spark, [10, 20, 30, 40]), rate=1, start_ns=SEC, end_ns=3 * SEC)) == [20, 30]
    assert rs.resample(series(spark, [1.0]).limit(0)).count() == 0
    for kw in ({"rate": 0}, {"rate": 5001}, {"interpolate": "x"}, {"start_ns": 5, "end_ns": 1}):
        with pytest.raises(ValueError):
            rs.resample(series(spark, [1]), **kw)


def test_gap_between_chunks_takes_the_sample_that_follows(spark):
    s = series(spark, [1, 2, 9], times=[2 * SEC, 3 * SEC, 8 * SEC])
    k = spark.createDataFrame([("f", "x", 0, 2, 2 * SEC, SEC), ("f", "x", 2, 1, 8 * SEC, SEC)], "file string, channel string, sample_base bigint, sample_count bigint, time_base_ns bigint, sample_period_ns bigint")
    assert ticks(rs.resample(rs.chunk_extents(s, k), rate=1)) == [1, 1, 1, 2, 9, 9, 9, 9, 9]


def test_pairs_across_blocks(spark, monkeypatch):
    s = series(spark, range(50))
    whole = ticks(rs.resample(s, rate=2))
    monkeypatch.setattr(rs, "BLOCK", 7)
    assert ticks(rs.resample(s, rate=2)) == whole


def test_wide_has_null_for_what_a_file_lacks(spark):
    long = rs.resample(series(spark, [1, 2], name="Speed").unionByName(series(spark, [5], name="RPM", file="g")), rate=1)
    rows = rs.wide(long, ["speed", "rpm"]).orderBy("file", "time_ns").collect()
    assert [(r.file, r.speed, r.rpm) for r in rows] == [("f", 1, None), ("f", 2, None), ("g", None, 5)]


def test_wide_without_moving_ticks(spark, monkeypatch):
    s = series(spark, [1, 2, 3], name="Speed").unionByName(series(spark, [5, 9], name="RPM", step=700_000_000)).unionByName(series(spark, [4], name="RPM", file="g", step=20 * SEC))
    monkeypatch.setattr(rs, "BUCKET", 3)
    for kw in ({}, {"interpolate": "previous"}, {"start_ns": SEC, "end_ns": 3 * SEC}):
        a, b = rs.wide(rs.resample(s, 4, **kw), ["speed", "rpm"]), rs.resample_wide(s, ["speed", "rpm"], 4, **kw)
        assert a.count() and sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_tick_arithmetic_has_no_overflow(spark):
    day = 40 * 86_400 * SEC
    assert spark.range(1).select(rs.first_tick(F.lit(day + 1), 5000), rs.tick_time(F.lit(day // SEC * 5000), 5000)).first()[:] == (day // SEC * 5000 + 1, day)


def test_sum_channels(spark):
    a, b = series(spark, [1, 2], name="a"), series(spark, [10, 20, 30], name="b")
    assert [r.value for r in rs.sum_channels(a.unionByName(b), ["A", "b"], "c").orderBy("sample_index").collect()] == [11, 22]
    with pytest.raises(Exception, match="one clock and one unit"):
        rs.sum_channels(a.unionByName(b.withColumn("time_ns", F.col("time_ns") + 1)), ["a", "b"], "c").collect()


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(cols[0], cols[-1]).collect()]


def test_runs_laps_and_stints(spark):
    s = series(spark, [0, 1, 1, float("nan"), 2, 2, None, 2, 3, -1], step=20 * SEC)
    assert rows(ev.integer_runs(s), "run", "value", "start_ns", "end_ns") == [(0, 0, 0, 20 * SEC), (1, 1, 20 * SEC, 80 * SEC), (2, 2, 80 * SEC, 160 * SEC), (3, 3, 160 * SEC, 180 * SEC), (4, -1, 180 * SEC, 200 * SEC)]
    assert rows(ev.laps_from_counter(s), "number", "duration_ns", "complete") == [(1, 60 * SEC, True), (2, 80 * SEC, True), (3, 20 * SEC, True)]
    assert rows(ev.driver_stints(s), "driver_id", "start_ns") == [(0, 0), (1, 20 * SEC), (2, 80 * SEC), (3, 160 * SEC)]
    assert rows(ev.fastest_lap(ev.laps_from_counter(s)), "number", "duration_ns") == [(3, 20 * SEC)]
    assert rows(ev.laps_report(ev.laps_from_counter(s)), "best_number", "best_ns") == [(3, 20 * SEC)]
    assert rows(ev.integer_runs(series(spark, [0.5, -0.5, 1.5])), "run", "value") == [(0, 1), (1, -1), (2, 2)]


def test_laps_from_a_timer(spark):
    s = series(spark, [3, 13, 23, 1, 11, 21, 31, 2, 12], step=10 * SEC)
    assert rows(ev.laps_from_timer(s), "number", "start_ns", "end_ns", "complete") == [(1, 0, 30 * SEC, False), (2, 30 * SEC, 70 * SEC, True), (3, 70 * SEC, 90 * SEC, False)]
    counter = series(spark, [7, 8, 9], times=[0, 30 * SEC, 70 * SEC])
    assert rows(ev.laps_from_timer(s, counter), "number", "complete") == [(7, False), (8, True), (9, False)]
    assert ev.laps_from_timer(series(spark, [3, 13, 1], step=10 * SEC)).count() == 0
    ref = ev.reference_lap(series(spark, [0, 38]))
    assert rows(ev.fastest_lap(ev.laps_from_timer(s), ref), "number", "duration_ns") == [(2, 40 * SEC)]
    assert ev.fastest_lap(ev.laps_from_timer(s), ev.reference_lap(series(spark, [0, 10]))).count() == 0
    reported = series(spark, [0, 18, 25], step=50 * SEC).withColumn("number", F.lit(4))
    assert rows(ev.fastest_lap(ev.laps_from_timer(s), reported=reported), "number", "duration_ns") == [(3, 18 * SEC)]


def test_beacons(spark):
    pulse = series(spark, [0, 1, 0, 1, 0, 0, 0, 1, 1, 0, 0, 0, 0, 1])
    found = ev.beacons(pulse)
    assert rows(found, "time_ns") == [(1 * SEC,), (7 * SEC,), (13 * SEC,)]
    assert rows(ev.lap_summary(found), "total_laps", "fastest_lap", "fastest_time") == [(4, 2, "0:06.000")]
    assert rows(ev.beacons(series(spark, [1, 1, 2, 2, 2, 2, 2, 2, 3]), pulse=False), "time_ns") == [(2 * SEC,), (8 * SEC,)]


def test_gate_and_track(spark):
    t = spark.createDataFrame([("f", i * SEC, la, lo) for i, (la, lo) in enumerate([(1.0, -1.0), (1.0, 1.0), (1.0, -1.0), (None, 0.0), (0.0, 0.0), (95.0, 0.0), *[(1.0, 2.0)] * 8, (1.0, -2.0)])], "file string, time_ns bigint, latitude double, longitude double")
    assert rows(ev.gate_crossings(t, (0.5, 0.0, 1.5, 0.0)), "time_ns") == [(1 * SEC,), (14 * SEC,)]
    p = ev.project_track(t)
    assert p.count() == 12 and abs(p.agg(F.sum("x_m")).first()[0]) < 1e-3


def test_nearest_and_merge(spark):
    a = series(spark, [0, 0, 0], times=[0, 5, 100]).select("file", "time_ns", "sample_index")
    b = series(spark, [1, 2], times=[4, 6]).select("file", "time_ns", "value")
    assert rows(ev.nearest(a, b, ["file"], "time_ns", "value", "v"), "sample_index", "v") == [(0, 1), (1, 1), (2, 2)]
    i = spark.createDataFrame([("f", 1, 0, 10), ("f", 1, 12, 20), ("f", 2, 20, 30), ("f", 1, 31, 40), ("f", 1, 60, 70)], "file string, id bigint, start_ns bigint, end_ns bigint")
    assert rows(ev.merge_intervals(i, ["file"], "id", 5), "start_ns", "id", "end_ns") == [(0, 1, 20), (20, 2, 30), (31, 1, 40), (60, 1, 70)]


def test_sessions(spark):
    f = spark.createDataFrame([("a", "k", 0, 40 * SEC), ("b", "k", 45 * SEC, 90 * SEC), ("c", "k", 200 * SEC, 210 * SEC), ("d", None, 0, 1), ("e", None, 0, 1)], "file string, session_key string, absolute_start_ns bigint, absolute_end_ns bigint")
    got = dict(rows(se.group_sessions(f, 10), "file", "session"))
    assert got == {"d": "unkeyed:0:0", "e": "unkeyed:1:1", "a": "k:2", "b": "k:2", "c": "k:3"}
    stints = spark.createDataFrame([("a", 3, 0, 40 * SEC), ("b", 3, 0, 45 * SEC)], "file string, driver_id bigint, start_ns bigint, end_ns bigint")
    m = {r.session_key: r for r in se.session_metadata(f, stints, stints.withColumnRenamed("driver_id", "number"), 10).collect()}
    assert (m["k:2"].file_count, m["k:2"].stint_count, m["k:2"].driver_ids, m["k:2"].duration_ns) == (2, 1, "3", 90 * SEC)
    own = spark.createDataFrame([("a", 7, 30 * SEC), ("b", 8, 20 * SEC)], "file string, number bigint, duration_ns bigint")
    m = {r.session_key: r for r in se.session_metadata(f, stints, stints.withColumnRenamed("driver_id", "number"), 10, own).collect()}
    assert (m["k:2"].fastest_lap_number, m["k:2"].fastest_lap_time_ns, m["k:3"].fastest_lap_number) == (8, 20 * SEC, None)
    wide = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0)], "file string, time_ns bigint, `Speed 1` double")
    ab = f.where("file in ('a', 'b')")
    assert rows(se.stitch(wide, ab, 10), "time_ns", "file_time_ns", "source_file", "Speed 1") == [(0, 0, "a", 1.0), (45 * SEC, 0, "b", 2.0)]
    with pytest.raises(ValueError, match="more than one"):
        se.stitch(wide, ab, 1)
    with pytest.raises(ValueError):
        se.group_sessions(f, 86_401)


def fnv(data: bytes) -> int:
    h = se.FNV_BASIS
    for b in data:
        h = (h ^ b) * se.FNV_PRIME % 2**64
    return h


def test_schema_hash(spark):
    words = [b"a", b"foobar", bytes(range(256)), b""]
    df = spark.createDataFrame([(w,) for w in words], "__fnv_data binary").withColumn("schema_hash", se.fnv1a(F.col("__fnv_data")))
    got = df.select("schema_hash", se.hash_hex(F.col("schema_hash")).alias("x")).collect()
    assert [(int(r.schema_hash), r.x) for r in got] == [(fnv(w), f"{fnv(w):016x}") for w in words]
    # Name, unit and one byte of code, A to Z in lower case only, nothing between.
    c = spark.createDataFrame([("f", 2, "Speed", "KM/h", 7), ("f", 1, "ÄB", None, 2), ("g", 1, None, "", None)], "file string, channel_id int, name string, unit string, type_code bigint")
    plain = {r.file: int(r.schema_hash) for r in se.schema_hash(c).collect()}
    assert plain == {"f": fnv("Äb".encode() + b"\x02" + b"speedkm/h\x07"), "g": fnv(b"\x00")}


def test_gps_clock(spark):
    w, i = series(spark, [None, 2429]), series(spark, [573634560, 573634660], step=100_000_000)
    assert se.gps_clock(w, i).first().absolute_start_ns == (2429 * 604_800_000 + 573634560) * 1_000_000


def test_streams(spark, tmp_path):
    from tracegrid.streaming import live

    src = str(tmp_path / "in")
    rows_ = [("f", "g", 1, i, f"2024-01-01 00:00:{s:02d}", float(v)) for i, (s, v) in enumerate([(1, 1), (2, 1), (12, 2), (13, 2), (40, 3)])]
    df = spark.createDataFrame(rows_ + rows_[:2], "file string, channel string, channel_id int, sample_index int, t string, value double").select("file", "channel", "channel_id", "sample_index", F.col("t").cast("timestamp").alias("at"), "value")
    df.coalesce(1).write.parquet(src)
    ddl = "file string, channel string, channel_id int, sample_index int, at timestamp, value double"

    def run(stream, name, mode):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    s = live.watch(spark, src, ddl)
    assert run(live.first_deliveries(s), "once", "append").count() == 5
    assert {r.n for r in run(live.windowed_stats(s), "stats", "complete").collect()} == {4, 2, 1}
    assert run(live.live_sessions(s, "15 seconds"), "sess", "complete").count() == 2
    assert rows(run(live.live_runs(s), "runs", "append"), "start", "value") and {r.value for r in spark.table("runs").collect()} == {1, 2}
