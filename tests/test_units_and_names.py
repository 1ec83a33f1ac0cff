import pytest
from pyspark.sql import functions as F
from tests.tables import empty_reference, reference

from tests import tables as T
from tracegrid import channelmap, units
from tracegrid.functions.unit_text import clean_unit_text
from tracegrid.operators.unit_resolution import base_unit_profile, in_base_units, recorded_units, resolve_units


@pytest.mark.parametrize(
    ("value", "source", "target", "expected"),
    [(36, "km/h", "m/s", 10), (1, "bar", "kPa", 100), (0, "C", "K", 273.15), (212, "F", "C", 100), (60, "rpm", "rad/s", 6.283185307), (1, "g", "m/s^2", 9.80665), (180, "deg", "rad", 3.14159265), (1, "psi", "Pa", 6894.757293), (50, "%", "ratio", 0.5), (1, "h", "min", 60), (1, "gal", "L", 3.785411784), (1, "hp", "W", 745.69987), (1, "lbf", "N", 4.448221615), (1, "mi", "km", 1.609344)],
)
def test_reference_conversions(value, source, target, expected):
    assert units.convert_value(value, source, target) == pytest.approx(expected, rel=1e-7)


def test_registry_is_complete_and_unambiguous():
    spellings = [s for u in units.UNITS for s in u.spellings]
    assert len(units.UNITS) == 88 and len(spellings) == len(set(spellings)) == 249
    assert units.lookup(" KN ").unit == "kn" and units.lookup("kN").unit == "kN" and units.lookup("nope") is None
    for a in units.UNITS:
        for b in units.UNITS:
            if a.dimension == b.dimension and a.convertible:
                there = units.convert_value(3.7, a.unit, b.unit)
                assert units.convert_value(there, b.unit, a.unit) == pytest.approx(3.7, rel=1e-9)


def test_impossible_conversions(spark):
    with pytest.raises(units.UnknownUnit):
        units.convert(F.lit(1.0), "furlong", "m")
    with pytest.raises(units.DimensionMismatch):
        units.convert(F.lit(1.0), "m", "s")
    with pytest.raises(units.NotConvertible):
        units.convert(F.lit(1.0), "count", "laps")
    assert units.convert_value(3, "count", "cnt") == 3
    df = spark.createDataFrame([(1.0, "km/h", "m/s"), (None, "bar", "s"), (2.0, None, "m")], "v double, a string, b string")
    got = [r[0] for r in df.select(units.convert_units(F.col("v"), F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(1 / 3.6) and got[1:] == [None, None]
    with pytest.raises(Exception, match="different dimensions"):
        spark.sql("select 1D v, 'bar' a, 's' b").select(units.convert_units(F.col("v"), F.col("a"), F.col("b"))).collect()


def test_unit_tags_survive_parquet(spark, tmp_path):
    from tracegrid.sources.sinks import parquet_units, write_parquet

    df = units.tag_unit(spark.createDataFrame([(36.0,)], "v double"), "v", "kph")
    assert df.select(units.convert_column(df, "v", "m/s")).first()[0] == pytest.approx(10)
    write_parquet(df, str(tmp_path / "t"))
    assert parquet_units(spark, str(tmp_path / "t")) == {"v": "km/h"}
    with pytest.raises(ValueError, match="carries no unit"):
        units.convert_column(df.select((F.col("v") * 2).alias("v")), "v", "m/s")


def test_channel_map():
    rules = channelmap.parse_map("a b -> C [kPa] * 2 + 3 # x\n q -> z * 0.5; w -> y\n e -> f - 2")
    assert [(r.source, r.target, r.unit, r.scale, r.offset) for r in rules] == [("a b", "C", "kPa", 2, 3), ("q", "z", None, 0.5, 0), ("w", "y", None, 1, 0), ("e", "f", None, 1, -2)]
    assert channelmap.parse_map(channelmap.rule_text("a", "b", "bar", 2.0, -1.0)) == [channelmap.ChannelRule("a", "b", "bar", 2.0, -1.0)]
    for bad in ("a -> b * 0", "a -> b [x", "a -> b\nA -> c", "a -> b\nc -> B", "nothing", "a -> b * inf", "a -> b * x", "-> b"):
        with pytest.raises(channelmap.MapError, match="line"):
            channelmap.parse_map(bad)
    with pytest.raises(channelmap.MapError, match="not found"):
        channelmap.validate_map(rules, ["A B"])


CASES = [
    # name, unit, recorded unit or None, evidence
    ("AN_P", "adc", "bar", "rule"), ("an_p", "", "bar", "rule"), ("vCar", "none", "km/h", "rule"), ("FDamp", "KN", "kN", "unit"), ("Vehicle Speed", "KN", "kn", "unit"), ("mystery", "KN", None, None),
    ("GPS Latitude", "min", "arcmin", "unit"), ("lap_time", "min", None, None), ("OilTemp", "Â°C", "C", "unit"), ("Oil Temp", "[deg C]", "C", "unit"), ("Oil Temp", " 1/10 K ", "K", "unit"), ("nEngine", "1/min", "rpm", "unit"),
    ("x", "100 rpm", "rpm", "unit"), ("x", "0.01kph", "km/h", "unit"), ("OIL_TEMP [°C]", "(null)", "C", "name"), ("oil.temp_deg C", "-", "C", "name"), ("OIL TEMP in degC", "n/a", "C", "name"), ("LAP_N", "", None, None),
    ("Vehicle Speed", "m/s", "m/s", "unit"), ("Gear", "cnt", "count", "unit"), ("Oil Temp", None, None, None), (None, "km/h", "km/h", "unit"), (None, None, None, None), ("x", "furlong", None, None), ("x", "0 bar", None, None),
]


def test_unit_evidence(spark):
    ch = T.channels(spark, [("f", i, n, u, "declared", "float32") for i, (n, u, _, _) in enumerate(CASES)])
    got = {r.channel_id: r.resolved for r in resolve_units(ch.drop("resolved"), *reference(spark)).collect()}
    for i, (name, unit, expected, evidence) in enumerate(CASES):
        assert (got[i].unit, got[i].evidence) == (expected, evidence), (name, unit)
    assert got[0].to_base_scale == pytest.approx(1250) and got[0].to_base_offset == pytest.approx(-5e5)
    assert clean_unit_text(" [( km/h )] ") == "km/h"


def test_recorded_units_edges(spark):
    rows = [("f", i, n, u, "declared", "float32") for i, (n, u, _, _) in enumerate(CASES)]
    ch = T.channels(spark, [*rows, *rows[:3], (None, 1, "vCar", "", None, None), ("f", None, "vCar", "", None, None)])
    got = {r.channel_id: r.unit for r in recorded_units(ch, *reference(spark)).collect()}
    assert got == {i: u for i, (n, t, u, _) in enumerate(CASES) if u and u not in ("m/s", "count")}
    assert recorded_units(ch.limit(0), *reference(spark)).count() == 0
    assert recorded_units(ch, *empty_reference(spark)).count() == 0


def test_base_values(spark):
    ch = T.channels(spark, [("f", 1, "vCar", "", "d", "float32"), ("f", 2, "?", "?", "d", "float32")])
    s = T.samples(spark, {("f", 1): ("vCar", "", [36.0, None, float("nan"), 72.0], None), ("f", 2): ("?", "?", [1.0], None)}, repeat=(0,))
    out = {(r.channel_id, r.sample_index): r.base_value for r in in_base_units(s, ch, *reference(spark)).collect()}
    assert out[1, 0] == pytest.approx(10) and out[1, 1] is None and out[2, 0] is None
    p = base_unit_profile(s, ch, *reference(spark)).collect()
    assert [(r.n, round(r.low, 6), round(r.high, 6), round(r["mean"], 6), r.base_unit) for r in p] == [(2, 10.0, 20.0, 15.0, "m/s")]
