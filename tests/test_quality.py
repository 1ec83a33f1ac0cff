import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import tables as T
from tracegrid.operators import anomalies
from tracegrid.operators import drift as drift_module
from tracegrid.operators.anomalies import find_faults
from tracegrid.operators.drift import consistent_channels, layout_changes
from tracegrid.operators.instants import normalise_instants
from tracegrid.operators.regular_grid import regular_grid, uncovered_ticks

SEC = 1_000_000_000


def wave(n, seed=0, level=50.0, noise=0.1):
    r = np.random.default_rng(seed)
    return (level + 10 * np.sin(np.arange(n) / 9) + r.normal(0, noise, n)).round(3)


def faults(spark, s, k, c, ref=None):
    return {(r.file, r.channel_id, r.sample_index, r.fault) for r in find_faults(s, k, c, *(ref or T.reference(spark))).collect()}


def test_faults_of_each_kind(spark):
    spike, stuck, limit, pedal, gear, gap = wave(200, 1), wave(200, 2), wave(200, 3), np.clip(100 * np.sin(np.arange(200) / 9), 0, 100).round(2), np.repeat([3.0, 4.0, 5.0, 4.0], 50), wave(200, 4)
    spike[50:52] += 9
    stuck[100:110] = stuck[99]
    limit[20:26] = -7.0
    gap[100:] += 30
    times = [i * 100_000_000 + (5 * SEC if i >= 100 else 0) for i in range(200)]
    s = T.samples(spark, {
        ("f", 1): ("mystery", "", spike, None), ("f", 2): ("Oil Temp", "C", stuck, None), ("f", 3): ("Vehicle Speed", "m/s", limit, None),
        ("f", 4): ("TPS_1", "", pedal, None), ("f", 5): ("Gear", "cnt", gear, None), ("f", 6): ("other", "", gap, times),
    }, repeat=(50, 100, 199))
    c = T.channels(spark, [("f", i, n, u, "d", "float32") for i, n, u in ((1, "mystery", ""), (2, "Oil Temp", "C"), (3, "Vehicle Speed", "m/s"), (4, "TPS_1", ""), (5, "Gear", "cnt"), (6, "other", ""))])
    k = T.chunks(spark, [("f", i, 0, 100_000_000, 200, 0, 0) for i in range(1, 7)] * 2)
    got = faults(spark, s, k, c)
    assert {(i, kind) for _, ch, i, kind in got if ch == 1} == {(50, "spike"), (51, "spike")}
    assert {(i, kind) for _, ch, i, kind in got if ch == 2} == {(i, "stuck") for i in range(99, 110)}
    assert {i for _, ch, i, kind in got if ch == 3 and kind == "limit"} == set(range(20, 26))
    assert not {x for x in got if x[1] in (4, 5, 6)}


def test_faults_do_not_depend_on_blocks(spark, monkeypatch):
    x = wave(900, 5)
    for at in (63, 64, 127, 128, 300, 511):
        x[at] += 8
    x[250:262] = x[250]
    s, c = T.samples(spark, {("f", 1): ("m", "", x, None)}), T.channels(spark, [("f", 1, "m", "", "d", "float32")])
    k = T.chunks(spark, [("f", 1, 0, 100_000_000, 400, 0, 0), ("f", 1, 1, 100_000_000, 500, 400, 40 * SEC)])
    whole = faults(spark, s, k, c)
    assert {i for *_, i, kind in whole if kind == "spike"} == {63, 64, 127, 128, 300, 511}
    monkeypatch.setattr(anomalies, "BLOCK", 64)
    assert faults(spark, s, k, c) == whole


def test_faults_edges(spark):
    x = [None, float("nan"), float("inf"), 1.0, 2.0, *[3.0] * 9]
    s, c = T.samples(spark, {("f", 1): (None, None, x, None)}), T.channels(spark, [("f", 1, None, None, None, None), (None, None, None, None, None, None)])
    k = T.chunks(spark, [])
    assert faults(spark, s, k, c) == set()  # a channel of little else than one value is not lively
    assert faults(spark, s, k, c.limit(0), T.empty_reference(spark)) == set()
    assert faults(spark, s.limit(0), k, c) == set()
    assert faults(spark, s.withColumn("file", F.lit(None).cast("string")), k, c) == set()


def test_contexts_count_by_their_samples(spark):
    # One long quiet hour and eight short noisy ones: the fence is that of the quiet samples.
    n = [900] + [20] * 8
    x = np.concatenate([wave(m, i, noise=5.0 if i else 0.1) for i, m in enumerate(n)])
    x[300] += 9
    at = [k * 3600 * SEC + i * 100_000_000 for k, m in enumerate(n) for i in range(m)]
    base = np.r_[0, np.cumsum(n)]
    s, c = T.samples(spark, {("f", 1): ("m", "", x, at)}), T.channels(spark, [("f", 1, "m", "", "d", "float32")])
    k = T.chunks(spark, [("f", 1, i, 100_000_000, m, int(base[i]), i * 3600 * SEC) for i, m in enumerate(n)])
    assert 300 in {i for *_, i, kind in faults(spark, s, k, c) if kind == "spike"}


def test_stuck_for_most_of_the_time(spark):
    x = wave(1000, 7)
    x[100:500], x[550:950] = x[100], x[550]
    s, c = T.samples(spark, {("f", 1): ("m", "", x, None)}), T.channels(spark, [("f", 1, "m", "", "d", "float32")])
    got = faults(spark, s, T.chunks(spark, [("f", 1, 0, 100_000_000, 1000, 0, 0)]), c)
    assert {i for *_, i, kind in got if kind == "stuck"} == {*range(100, 500), *range(550, 950)}


def test_missing_value_inside_a_run(spark):
    x = wave(120, 6).tolist()
    x[40:50] = [5.5] * 10
    x[45] = None
    s, c = T.samples(spark, {("f", 1): ("m", "", x, None)}), T.channels(spark, [("f", 1, "m", "", "d", "float32")])
    got = faults(spark, s, T.chunks(spark, [("f", 1, 0, 100_000_000, 120, 0, 0)]), c)
    assert {i for *_, i, kind in got if kind == "stuck"} == set(range(40, 50)) - {45}


def instants(spark, rows, venues=(("Ring", "Europe/Berlin"), ("NYC", "America/New_York"), (None, "UTC"), ("x", None)), **kw):
    """rows: (logger, venue, date, time, clock) -> {file: utc text}"""
    f = spark.createDataFrame([(f"f{i:02d}", g, i, v, d, t, c, dt.datetime(2024, 8, 5), "x", "y", "z") for i, (g, v, d, t, c) in enumerate(rows)], T.FILES)
    out = normalise_instants(f.unionByName(f.limit(3)), spark.createDataFrame(list(venues), T.VENUES), **kw)
    return {r.file: dt.datetime.fromtimestamp(r.start_utc_us / 1e6, dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")[:-3] for r in out.collect()}


def test_instants(spark):
    rows = [
        ("a", "Ring", "15/07/2022", "10:00:00", "utc"), ("a", "Ring", "03/04/2022", "10:00", "local"), ("b", "NYC", "07/15/2022", "1:05:06.5 PM", "Local "), ("b", "nyc ", "03/04/2022", "12:00:00 AM", None),
        ("c", "Ring", "31.03.24", "02:30:00", "local"), ("c", "Ring", "27.10.24", "02:30:00", ""), ("c", None, "1.2.2024", "10:00:00", "local"), ("c", None, "1.2.2024", "10:00:00+0530", "local"),
        ("d", "NYC", "2023-01-05", "10:00:00 JST", "utc"), ("d", "NYC", "", "2023-01-05T10:00:00.123456789Z", "local"), ("d", "NYC", "2210", "11855000", "GPS"), ("d", "NYC", "1690320450", None, "local"),
        ("d", None, None, "1690320450123456789", None), ("d", "NYC", "31/02/2024", "10:15:00", "utc"), ("d", "NYC", None, "012345.678", "time_of_day"), ("d", "NYC", "20240105", "012345.678", "time_of_day"),
        ("e", "NYC", "04-Jul-2023", "23:59", "utc"), ("e", "NYC", "2023-13-40", "10:00:00", "utc"), ("e", "NYC", "2023-01-05", "25:00:00", "utc"), ("e", "NYC", "n/a", "n/a", None), (None, None, None, None, None), ("e", "NYC", "2023-01-05", "10:00:00", "sundial"),
        ("e", "NYC", "2210", "700000000", "gps"), ("g", "Ring", "02/08/2024", "10:00:00", "utc"), ("e", "NYC", "4 July 2023", "10:00:00", "utc"),
    ]
    got = instants(spark, rows)
    assert got == {
        "f00": "2022-07-15 10:00:00.000", "f01": "2022-04-03 08:00:00.000", "f02": "2022-07-15 17:05:06.500", "f03": "2022-03-04 05:00:00.000", "f04": "2024-03-31 01:30:00.000", "f05": "2024-10-27 00:30:00.000",
        "f07": "2024-02-01 04:30:00.000", "f08": "2023-01-05 01:00:00.000", "f09": "2023-01-05 10:00:00.123", "f10": "2022-05-15 03:17:17.000", "f11": "2023-07-25 21:27:30.000", "f12": "2023-07-25 21:27:30.123",
        "f15": "2024-01-05 01:23:45.678", "f16": "2023-07-04 23:59:00.000", "f23": "2024-08-02 10:00:00.000", "f24": "2023-07-04 10:00:00.000",
    }


def test_instant_dictionary_grows(spark, tmp_path):
    book = f"file://{tmp_path}/book"
    first = instants(spark, [("a", "Ring", "2024-01-01", "10:00:00", "utc")], dictionary=book)
    assert spark.read.parquet(book).count() == 1
    second = instants(spark, [("a", "Ring", "2024-01-01", "10:00:00", "utc"), ("a", "Ring", "2024-01-02", "10:00:00", "utc")], dictionary=book)
    assert spark.read.parquet(book).count() == 2 and first["f00"] == second["f00"] and len(second) == 2
    assert instants(spark, [(None, None, None, None, None)][:0] or [(None, None, "", "", "")]) == {}


def drift(spark, files, defs):
    """files: [(logger, seq, file)]; defs: {file: [(id, name, unit, source, type)]}"""
    f = spark.createDataFrame([(n, g, q, None, None, None, None, None, "a", "b", "c") for g, q, n in files], T.FILES)
    c = T.channels(spark, [(n, i, name, u, s, t) for n, ds in defs.items() for i, name, u, s, t in ds] * 2)
    return c, f


def test_layout_changes(spark):
    a = [(1, "Oil Temp", "C", "declared", "float32"), (2, "Vehicle Speed", "km/h", "declared", "float32"), (3, "Gear", "cnt", None, "uint8"), (4, "DMP_F1", "N", "d", "int16"), (9, "xx", "bar", "d", "int16")]
    b = [(7, "OIL_TEMP [C]", "", "spec_default", "float32"), (2, "Vehicle Speed", "km/h", "declared", "float64"), (4, "FDamp", "kN", "d", "int16"), (9, "yy", "K", "d", "int16"), (5, None, None, None, None)]
    c, f = drift(spark, [("L", 10, "f2"), ("L", 3, "f1"), ("L", 12, "f3"), ("M", 1, "f4"), (None, 1, "f5"), ("M", None, "f6")], {"f1": a, "f2": b, "f3": b, "f5": a})
    got = {(r.file, r.channel_id, r.change) for r in layout_changes(c, f, *T.reference(spark)).collect()}
    assert got == {("f2", 7, "renamed"), ("f2", 7, "unit_source"), ("f2", 2, "retyped"), ("f2", 3, "removed"), ("f2", 4, "renamed"), ("f2", 9, "added"), ("f2", 9, "removed"), ("f2", 5, "added")}
    assert layout_changes(c.limit(0), f, *T.empty_reference(spark)).count() == 0 == layout_changes(c, f.limit(0), *T.reference(spark)).count()
    table = {(r.file, r.channel_id): r for r in consistent_channels(c, f, *T.reference(spark)).collect()}
    assert table["f1", 1].column_name == table["f2", 7].column_name == "oiltemp" and table["f2", 2].common_type == "float64"
    assert table["f1", 1].version == 1 and table["f2", 7].version == table["f3", 7].version == 2


def columns_of(spark, files, defs):
    c, f = drift(spark, files, defs)
    return {(r.file, r.channel_id): (r.column_name, r.common_type) for r in consistent_channels(c, f, *T.reference(spark)).collect()}


def test_renames_are_carried_along_the_files(spark, monkeypatch):
    d = lambda i, name, kind="int16", unit="": (i, name, unit, "d", kind)
    defs = {
        "f1": [d(1, "A1"), d(4, "DMP_F1"), d(8, "twin"), d(9, "Twin"), d(6, "xx", unit="bar")],
        "f2": [d(1, "A2"), d(4, "FDamp"), d(8, "twin"), d(9, "Twin"), d(6, "yy", unit="K")],
        "f3": [d(1, "A3"), d(8, "twin")],
        "f4": [d(1, "A4"), d(7, "A1", "uint8"), d(5, "F-Damp", "int32"), d(8, "twin"), d(9, "Twin")],
        "f5": [d(1, "A5"), d(7, "A1", "uint8"), d(5, "FDamp")],
        "f6": [d(1, "A6", "float64"), d(7, "A7", "uint8")],
        "g1": [d(4, "FDamp")],
    }
    files = [("L", 5 * i, f"f{i}") for i in range(1, 7)] + [("M", 1, "g1")]
    got = columns_of(spark, files, defs)
    assert {got[f"f{i}", 1] for i in range(1, 7)} == {("a1", "float64")}
    assert {got["f4", 7], got["f5", 7], got["f6", 7]} == {("a1_2", "uint8")}  # another channel under a name that was given up
    assert {got[x] for x in (("f1", 4), ("f2", 4), ("f4", 5), ("f5", 5))} == {("dmpf1", "int32")}  # renamed, absent, back again
    assert got["g1", 4] == ("fdamp", "int16")
    assert {got[f, 8][0] for f in ("f1", "f2", "f3", "f4")} == {"twin"} and {got[f, 9][0] for f in ("f1", "f2", "f4")} == {"twin_2"}
    assert got["f1", 6][0] == "xx" and got["f2", 6][0] == "yy"  # one id, two dimensions
    assert len(got) == sum(map(len, defs.values())) and len({(f, n) for (f, _), (n, _) in got.items()}) == len(got)
    monkeypatch.setattr(drift_module, "SEQ_BLOCK", 7)
    assert columns_of(spark, files, defs) == got


def grid(spark, s, k, **kw):
    return {(r.chunk_index, r.tick): (r.state, r.value) for r in regular_grid(s, k, **kw).collect()}


def test_regular_grid(spark):
    t = [0, 95, 210, 300, 640, 705, 3000, 3090]
    s = T.samples(spark, {("f", 1): ("m", "", [0.0, 1.0, 2.0, 3.0, 6.0, None, 30.0, float("nan")], [x * 1_000_000 + 500 * 1_000_000 for x in t])}, repeat=(1, 3))
    k = T.chunks(spark, [("f", 1, 0, None, 8, 0, 500_000_000), ("f", 1, 0, None, 8, 0, 500_000_000), ("g", 1, 0, 10, 5, 0, 0), (None, None, None, None, None, None, None)])
    got = grid(spark, s, k)
    assert {t for (_, t), v in got.items() if v[0] == "reading"} == {0, 1, 2, 3, 6, 30}
    assert got[0, 4] == ("filled", 4.0) and got[0, 5] == ("filled", 5.0) and got[0, 7] == ("missing", None) and got[0, 31] == ("missing", None) and len(got) == 32
    assert uncovered_ticks(s, k).count() == 26 and uncovered_ticks(s.limit(0), k).count() == 0 == uncovered_ticks(s, k.limit(0)).count()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 400), st.booleans()), min_size=1, max_size=60), st.integers(3, 20))
def test_uncovered_ticks_by_brute_force(spark, steps, block):
    from tracegrid.operators import regular_grid as rg

    times = np.cumsum([s for s, _ in steps]).tolist()
    values = [1.0 if ok else None for _, ok in steps]
    s = T.samples(spark, {("f", 1): ("m", "", values, times)})
    cut = len(steps) // 2
    rows = [("f", 1, 0, 100, cut, 0, 0), ("f", 1, 1, 70, len(steps) - cut, cut, times[cut] if cut < len(times) else 0)]
    expected = set()
    for _, _, k, p, n, b, t0 in rows:
        tick = {i: (2 * (times[i] - t0) + p) // (2 * p) for i in range(b, b + n)}
        if n:
            expected |= {(k, x) for x in range(tick[b + n - 1] + 1)} - {(k, tick[i]) for i in tick if values[i] is not None}
    old = rg.BLOCK
    rg.BLOCK = block
    try:
        got = {(r.chunk_index, r.tick) for r in uncovered_ticks(s, T.chunks(spark, [r for r in rows if r[4]])).collect()}
    finally:
        rg.BLOCK = old
    assert got == expected


def test_reference_tables_are_bounded(spark):
    from tracegrid.runtime import bounded_rows

    with pytest.raises(ValueError, match="more than 3 rows"):
        bounded_rows(spark.range(5), 3, "t")


def test_units_told_from_values(spark):
    from tracegrid.operators.unit_links import link_units

    r = np.random.default_rng(8)
    speed = lambda f: (50 + 12 * np.sin(np.arange(60) / 5 + r.uniform(0, 6)) + r.normal(0, 0.2, 60)) * f
    series, defs, files = {}, [], []
    for k in range(12):
        f, factor, unit, name = f"f{k:02d}", 1.0, "m/s", "Vehicle Speed"
        if k >= 6:
            factor, unit = 3.6, "" if k % 2 else "km/h"
        if k >= 10:
            name, unit = "SPD_1", ""  # renamed under the same id: linked through the logger
        series[f, 1], files = (name, unit, speed(factor), None), [*files, (f, "L" if k >= 8 else f"G{k}", k, None, None, None, None, None, "a", "b", "c")]
        defs.append((f, 1, name, unit, "d", "float32"))
    series["f00", 2], series["f01", 2] = ("flat", "", [1.0] * 60, None), ("few", "", [1.0, 2.0], None)
    defs += [("f00", 2, "flat", "", "d", "float32"), ("f01", 2, "few", "", "d", "float32"), (None, 1, None, None, None, None)]
    s, c, g = T.samples(spark, series), T.channels(spark, defs), spark.createDataFrame(files, T.FILES)
    got = {(x.file, x.channel_id): x.unit for x in link_units(s, c, g, *T.reference(spark)).collect()}
    assert got == {(f"f{k:02d}", 1): "km/h" for k in (7, 9, 10, 11)}
    assert link_units(s.limit(0), c, g, *T.reference(spark)).count() == 0 == link_units(s, c, g.limit(0), *T.empty_reference(spark)).count()


def test_units_spread_along_long_chains(spark):
    from tracegrid.operators.unit_links import link_units

    names, series, defs, files = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "omega"], {}, [], []
    x = 50 + 12 * np.sin(np.arange(60) / 5)
    for k in range(6):
        for j in (k, k + 1):  # logger k renames names[k] to names[k + 1] under one id
            f, unit = f"g{k}{j}", "" if j else "m/s"
            series[f, 1] = (names[j], unit, x * (3.6 if j else 1.0), None)
            defs.append((f, 1, names[j], unit, "d", "float32"))
            files.append((f, f"G{k}", j, None, None, None, None, None, "a", "b", "c"))
    s, c, g = T.samples(spark, series), T.channels(spark, defs), spark.createDataFrame(files, T.FILES)
    got = {x.file: x.unit for x in link_units(s, c, g, *T.reference(spark)).collect()}
    assert got == {f: "km/h" for f, _, name, *_ in defs if name != "alpha"}


def test_sketches_weigh_what_they_stand_for(spark):
    # A large calm context and a small wild one: the quartiles are those of all deviations together.
    r = np.random.default_rng(11)
    calm, wild = r.normal(0, 1, 20_000), r.normal(0, 50, 300)
    ranks = (np.arange(anomalies.POINTS) + 0.5) / anomalies.POINTS
    sketch = lambda x: np.quantile(x, ranks).tolist()
    rows = [("f", 1, 0, 10_000, sketch(calm[:10_000])), ("f", 1, 0, 10_000, sketch(calm[10_000:])), ("f", 1, 1, 300, sketch(wild)), ("f", 2, 0, 300, sketch(wild)), ("f", 3, 0, 0, None)]
    got = {(x.channel_id, x.hour): (x.hour_spread, x.channel_spread) for x in anomalies.merged_spreads(spark.createDataFrame(rows, "file string, channel_id int, hour bigint, weight bigint, points array<double>")).collect()}
    half = lambda x: (np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 2
    assert set(got) == {(1, 0), (1, 1), (2, 0)} and got[1, 0][1] == got[1, 1][1]
    # Points stand a twenty-fifth of the ranks apart, classes are 2 % wide.
    assert got[1, 0][0] == pytest.approx(half(calm), rel=0.1) and got[1, 0][1] == pytest.approx(half(np.r_[calm, wild]), rel=0.1)
    assert got[1, 1][0] == got[2, 0][0] == got[2, 0][1] == pytest.approx(half(wild), rel=0.2)


def test_one_rule_for_channels_of_any_size(spark):
    # The same course, once within a block and once over three: the same spikes are found.
    n = 2 * anomalies.BLOCK + 500
    x = wave(n, 5)
    spikes = [700, 5000, anomalies.BLOCK - 1, anomalies.BLOCK + 3, n - 40]
    for i in spikes:
        x[i] += 25
    long = {("f", 1): ("m", "", list(x), None)}
    short = {("f", 2): ("m", "", list(x[:6000]), None)}
    s = T.samples(spark, long | short)
    k = T.chunks(spark, [("f", 1, 0, 100_000_000, n, 0, 0), ("f", 2, 0, 100_000_000, 6000, 0, 0)])
    got = find_faults(s, k, T.channels(spark, [("f", 1, "m", "", "d", "float32"), ("f", 2, "m", "", "d", "float32")]), *T.reference(spark)).where("fault = 'spike'").collect()
    assert sorted(r.sample_index for r in got if r.channel_id == 1) == spikes and sorted(r.sample_index for r in got if r.channel_id == 2) == [700, 5000]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 250), st.booleans()), min_size=2, max_size=60), st.integers(3, 20))
def test_whole_series_by_brute_force(spark, steps, block):
    from tracegrid.operators import regular_grid as rg

    times = np.cumsum([s for s, _ in steps]).tolist()
    values = [float(i) if ok else None for i, (_, ok) in enumerate(steps)]
    s, k = T.samples(spark, {("f", 1): ("m", "", values, times)}), T.chunks(spark, [("f", 1, 0, 100, len(steps), 0, 0)])
    tick = [(2 * t + 100) // 200 for t in times]
    covered = {}
    for i in sorted((i for i in range(len(steps)) if values[i] is not None), key=lambda i: (abs(times[i] - 100 * tick[i]), i)):
        if tick[i] <= tick[-1]:
            covered.setdefault(tick[i], values[i])
    old = rg.BLOCK
    rg.BLOCK = block
    try:
        got = {r.tick: r for r in regular_grid(s, k, fill_limit=3).collect()}
    finally:
        rg.BLOCK = old
    assert sorted(got) == list(range(tick[-1] + 1)) and all(r.time_ns == 100 * t for t, r in got.items())
    have = sorted(covered)
    for t, r in got.items():
        before, after = [h for h in have if h < t], [h for h in have if h > t]
        if t in covered:
            assert (r.state, r.value) == ("reading", covered[t])
        elif before and after and after[0] - before[-1] - 1 <= 3:
            assert r.state == "filled"
        else:
            assert (r.state, r.value) == ("missing", None)
