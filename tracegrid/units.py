"""The unit registry: spellings, dimensions and exact affine conversions."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DEG = 180 / math.pi

#: Per dimension (base unit), each unit with base = value * factor + offset and its other spellings.
_REGISTRY: list[tuple[str, str, list[tuple]]] = [
    ("length", "m", [("m", 1.0, ("metre", "meter", "metres", "meters")), ("mm", 0.001, ("millimetre", "millimeter")), ("cm", 0.01, ()), ("km", 1000.0, ()), ("in", 0.0254, ("inch", "inches")), ("ft", 0.3048, ("feet", "foot")), ("mile", 1609.344, ("mi", "miles"))]),
    ("speed", "m/s", [("m/s", 1.0, ("mps", "ms-1", "m.s^-1")), ("km/h", 1 / 3.6, ("kph", "kmh", "kmph", "km/hr")), ("mph", 0.44704, ("mi/h",)), ("kn", 0.5144444444444444, ("knot", "knots"))]),
    ("acceleration", "m/s^2", [("m/s^2", 1.0, ("m/s2", "mps2", "m/s²")), ("g", 9.80665, ("G", "g-force"))]),
    ("angle", "rad", [("rad", 1.0, ("radian", "radians")), ("deg", 1 / _DEG, ("degree", "degrees", "°")), ("rev", 2 * math.pi, ("revolution",))]),
    ("angular_velocity", "rad/s", [("rad/s", 1.0, ("rads", "rad/sec")), ("rpm", 2 * math.pi / 60, ("RPM", "rev/min", "r/min")), ("deg/s", 1 / _DEG, ("dps", "deg/sec"))]),
    ("angular_acceleration", "rad/s^2", [("rad/s^2", 1.0, ("rad/s2",)), ("deg/s^2", 1 / _DEG, ("deg/s2",))]),
    ("pressure", "Pa", [("Pa", 1.0, ("pascal", "pa")), ("kPa", 1e3, ("kpa",)), ("MPa", 1e6, ("mpa",)), ("bar", 1e5, ("Bar",)), ("mbar", 100.0, ("millibar", "hPa")), ("psi", 6894.757293168361, ("PSI", "lbf/in^2")), ("atm", 101325.0, ()), ("inHg", 3386.388640341, ("inhg",))]),
    ("temperature", "K", [("K", 1.0, ("kelvin",)), ("C", 1.0, ("degC", "°C", "celsius", "Celsius", "deg C"), 273.15), ("F", 5 / 9, ("degF", "°F", "fahrenheit", "Fahrenheit", "deg F"), 273.15 - 32 * 5 / 9)]),
    ("time", "s", [("s", 1.0, ("sec", "secs", "second", "seconds")), ("ms", 0.001, ("millisecond", "msec")), ("us", 1e-6, ("microsecond", "usec", "µs")), ("ns", 1e-9, ("nanosecond", "nsec")), ("min", 60.0, ("minute", "minutes")), ("h", 3600.0, ("hr", "hour", "hours"))]),
    ("frequency", "Hz", [("Hz", 1.0, ("hz", "hertz")), ("kHz", 1e3, ("khz",))]),
    ("force", "N", [("N", 1.0, ("newton",)), ("kN", 1e3, ("kilonewton",)), ("lbf", 4.4482216152605, ())]),
    ("torque", "Nm", [("Nm", 1.0, ("N.m", "N*m", "newton-metre")), ("lbft", 1.3558179483314004, ("lb-ft", "ft-lb", "ftlb"))]),
    ("energy", "J", [("J", 1.0, ("joule",)), ("kJ", 1e3, ("kilojoule",)), ("MJ", 1e6, ("megajoule",)), ("kWh", 3.6e6, ("kwh",))]),
    ("power", "W", [("W", 1.0, ("watt",)), ("kW", 1e3, ("kw",)), ("hp", 745.6998715822702, ("HP", "bhp")), ("PS", 735.49875, ("ps",))]),
    ("voltage", "V", [("V", 1.0, ("volt", "volts")), ("mV", 0.001, ("millivolt",))]),
    ("current", "A", [("A", 1.0, ("amp", "amps", "ampere")), ("mA", 0.001, ("milliamp",))]),
    ("resistance", "ohm", [("ohm", 1.0, ("Ohm", "Ω"))]),
    ("mass", "kg", [("kg", 1.0, ("kilogram", "kilogramme")), ("g_mass", 0.001, ("gram", "gramme")), ("lb", 0.45359237, ("lbs", "pound"))]),
    ("volume", "m^3", [("m^3", 1.0, ("m3", "cubic metre")), ("L", 0.001, ("l", "litre", "liter", "litres", "liters")), ("mL", 1e-6, ("ml", "millilitre")), ("gal", 0.003785411784, ("gallon",))]),
    ("volumetric_flow", "m^3/s", [("m^3/s", 1.0, ("m3/s",)), ("L/s", 0.001, ("l/s",)), ("L/h", 0.001 / 3600, ("l/h", "L/hr"))]),
    ("mass_flow", "kg/s", [("kg/s", 1.0, ()), ("kg/h", 1 / 3600, ("kg/hr",))]),
    ("ratio", "ratio", [("ratio", 1.0, ("fraction", "Lambda", "lambda")), ("%", 0.01, ("percent", "pct")), ("%/s", 0.01, ("pct/s",)), ("%/Period", 0.01, ("%/period", "pct/period"))]),
    ("count", "count", [("count", 1.0, ("cnt", "counts", "num", "number")), ("laps", 1.0, ("lap",)), ("gear", 1.0, ()), ("code", 1.0, ("error_code",))]),
    ("marker", "marker", [("marker", 1.0, ()), ("raw", 1.0, ("Raw", "RAW")), ("flag", 1.0, ("Flag", "flags", "bool", "boolean")), ("state", 1.0, ("status", "State", "Status", "mode")), ("pp1", 1.0, ()), ("Driver", 1.0, ("driver",)), ("defined", 1.0, ("user defined", "User Defined", "user-defined")), ("text", 1.0, ("string", "label"))]),
    ("logarithmic", "dBm", [("dBm", 1.0, ("dbm",)), ("dB", 1.0, ("db",))]),
]
NOT_CONVERTIBLE = frozenset({"count", "marker"})


@dataclass(frozen=True)
class UnitDef:
    unit: str
    dimension: str
    base_unit: str
    factor: float
    offset: float
    spellings: tuple[str, ...]

    @property
    def convertible(self) -> bool:
        return self.dimension not in NOT_CONVERTIBLE


class UnknownUnit(ValueError):
    pass


class DimensionMismatch(ValueError):
    pass


class NotConvertible(ValueError):
    pass


def _load() -> list[UnitDef]:
    out = []
    for dimension, base, units in _REGISTRY:
        for name, factor, aliases, *offset in units:
            out.append(UnitDef(name, dimension, base, factor, offset[0] if offset else 0.0, (name, *aliases)))
    return out


UNITS = _load()
_EXACT: dict[str, UnitDef] = {}
_FOLDED: dict[str, UnitDef] = {}
for _u in UNITS:
    for _s in _u.spellings:
        _EXACT.setdefault(_s, _u)
        _FOLDED.setdefault(_s.lower(), _u)


def lookup(text: str | None) -> UnitDef | None:
    """The unit a spelling stands for: exactly first, then without regard to case; None if unknown."""
    t = (text or "").strip()
    return _EXACT.get(t) or _FOLDED.get(t.lower())


def normalise(text: str | None) -> str | None:
    u = lookup(text)
    return u.unit if u else None


def _pair(source: str, target: str) -> tuple[UnitDef, UnitDef]:
    a, b = lookup(source), lookup(target)
    for text, u in ((source, a), (target, b)):
        if u is None:
            raise UnknownUnit(f"unknown unit {text!r}")
    if a.dimension != b.dimension:
        raise DimensionMismatch(f"{a.unit} is a {a.dimension}, {b.unit} a {b.dimension}")
    if a.unit != b.unit and not a.convertible:
        raise NotConvertible(f"{a.unit} and {b.unit} of dimension {a.dimension} do not convert")
    return a, b


def convert_value(value: float, source: str, target: str) -> float:
    a, b = _pair(source, target)
    return value if a.unit == b.unit else (value * a.factor + a.offset - b.offset) / b.factor


def can_convert_units(source: str, target: str) -> bool:
    try:
        _pair(source, target)
    except ValueError:
        return False
    return True


def convert(value: Column, source: str, target: str) -> Column:
    """``value`` from one literal unit to another; units are checked and folded when the plan is built."""
    a, b = _pair(source, target)
    v = value.cast("double")
    return v if a.unit == b.unit else (v * F.lit(a.factor) + F.lit(a.offset) - F.lit(b.offset)) / F.lit(b.factor)


def units_table(spark: SparkSession) -> DataFrame:
    """One row per spelling of the registry."""
    rows = [(s, u.unit, s == u.unit, u.dimension, u.base_unit, u.factor, u.offset, u.convertible) for u in UNITS for s in u.spellings]
    return spark.createDataFrame(rows, "unit string, canonical_unit string, is_canonical boolean, dimension string, base_unit string, to_base_factor double, to_base_offset double, is_convertible boolean")


_ENTRY = "struct<unit:string,dimension:string,factor:double,offset:double,convertible:boolean>"


def _book(spellings: dict[str, UnitDef]) -> Column:
    """The registry as one constant map from spelling to unit, folded when the plan is optimised."""
    entries = {s: {"unit": u.unit, "dimension": u.dimension, "factor": u.factor, "offset": u.offset, "convertible": u.convertible} for s, u in spellings.items()}
    return F.from_json(F.lit(json.dumps(entries)), f"map<string,{_ENTRY}>")


def looked_up(unit: Column) -> Column:
    """A struct of the unit that a text column spells; NULL if it spells none."""
    t = F.trim(unit)
    return F.coalesce(F.try_element_at(_book(_EXACT), t), F.try_element_at(_book(_FOLDED), F.lower(t)))


def convert_units(value: Column, source: Column, target: Column) -> Column:
    """``value`` between units given by columns; an impossible pair raises when the query runs, NULL gives NULL."""
    a, b = looked_up(source), looked_up(target)
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.coalesce(source, F.lit("")), F.lit(" -> "), F.coalesce(target, F.lit("")))).cast("double")
    return (
        F.when(value.isNull() | source.isNull() | target.isNull(), F.lit(None).cast("double"))
        .when(a.isNull() | b.isNull(), fail("unknown unit: "))
        .when(a.dimension != b.dimension, fail("different dimensions: "))
        .when(a.unit == b.unit, value)
        .when(~a.convertible, fail("not convertible: "))
        .otherwise((value * a.factor + a.offset - b.offset) / b.factor)
    )


def can_convert(source: Column, target: Column) -> Column:
    """Whether the unit texts of two columns convert; NULL if either is NULL."""
    a, b = looked_up(source), looked_up(target)
    same = (a.dimension == b.dimension) & ((a.unit == b.unit) | a.convertible)
    return F.when(source.isNotNull() & target.isNotNull(), F.coalesce(same, F.lit(False)))


TAG = "telemetry_unit"


def tag_unit(df: DataFrame, column: str, unit: str) -> DataFrame:
    """``column`` with its unit in the column metadata, where plain projections and Parquet keep it."""
    name = normalise(unit)
    if name is None:
        raise UnknownUnit(f"unknown unit {unit!r}")
    return df.withMetadata(column, {**df.schema[column].metadata, TAG: name})


def unit_of(df: DataFrame, column: str) -> str:
    unit = df.schema[column].metadata.get(TAG)
    if not unit:
        raise ValueError(f"column {column!r} carries no unit")
    return unit


def convert_column(df: DataFrame, column: str, target: str) -> Column:
    """A tagged column in another unit; a column without a tag, or an expression, is refused."""
    return convert(F.col(f"`{column}`"), unit_of(df, column), target)
