"""Small tables in the layouts of the logger domain."""

import datetime as dt

UNIT_DEFS = "unit string, dimension string, base_unit string, to_base_factor double, to_base_offset double, is_convertible boolean, aliases array<string>"
RULES = "rule_id int, source string, target string, unit string, scale double, value_offset double"
LIMITS = "quantity string, dimension string, base_unit string, low double, high double, is_step boolean"
SAMPLES = "file string, format string, channel_id bigint, channel string, unit string, unit_source string, frequency_hz double, sample_index bigint, time_ns bigint, value double, arrived_at timestamp_ntz, resolved string, block bigint, h string"
CHANNELS = "file string, format string, channel_id bigint, name string, unit string, unit_source string, data_type string, resolved string, quantity string"
CHUNKS = "file string, channel_id bigint, chunk_index int, sample_period_ns bigint, sample_count bigint, data_ptr bigint, sample_base bigint, time_base_ns bigint, block int, slot string"
FILES = "file string, logger_id string, file_seq bigint, venue string, date string, time string, clock string, received_at timestamp_ntz, day_first string, tz_name string, place string"
VENUES = "venue string, tz_name string"

UNITS = [
    ("m/s", "speed", "m/s", 1.0, 0.0, True, ["mps"]), ("km/h", "speed", "m/s", 1 / 3.6, 0.0, True, ["kph"]), ("kn", "speed", "m/s", 0.5144, 0.0, True, ["knot"]),
    ("N", "force", "N", 1.0, 0.0, True, []), ("kN", "force", "N", 1000.0, 0.0, True, None), ("K", "temperature", "K", 1.0, 0.0, True, ["kelvin"]), ("C", "temperature", "K", 1.0, 273.15, True, ["degC", "°C", "deg C"]),
    ("min", "time", "s", 60.0, 0.0, True, []), ("arcmin", "angle", "rad", 0.000291, 0.0, True, ["min"]), ("rpm", "angular_velocity", "rad/s", 0.10472, 0.0, True, ["1/min"]),
    ("count", "count", "count", 1.0, 0.0, False, ["cnt"]), ("raw", "marker", "raw", 1.0, 0.0, False, ["adc"]), ("bar", "pressure", "Pa", 1e5, 0.0, True, []), ("%", "ratio", "ratio", 0.01, 0.0, True, ["pct"]), ("ratio", "ratio", "ratio", 1.0, 0.0, True, []),
]
RULE_ROWS = [(1, "AN_P", "Brake Pressure", "bar", 0.0125, -5.0), (2, "vCar", "Vehicle Speed", "km/h", 1.0, 0.0), (3, "FDamp", "Damper Force FL", None, 1.0, 0.0), (4, "spare", None, None, None, None), (5, None, "x", "bar", 2.0, 0.0)]
LIMIT_ROWS = [("Vehicle Speed", "speed", "m/s", 0.0, 130.0, False), ("Oil Temp", "temperature", "K", 228.0, 490.0, False), ("Damper Force FL", "force", "N", -6e4, 6e4, False), ("Gear", "count", "count", -1.0, 12.0, True), ("GPS Latitude", "angle", "rad", -1.57, 1.57, False), ("Brake Pressure", "pressure", "Pa", 0.0, 3e7, False), ("Throttle Position", "ratio", "ratio", 0.0, 1.0, False)]


def reference(spark):
    return spark.createDataFrame(UNITS, UNIT_DEFS), spark.createDataFrame(RULE_ROWS, RULES), spark.createDataFrame(LIMIT_ROWS, LIMITS)


def empty_reference(spark):
    return spark.createDataFrame([], UNIT_DEFS), spark.createDataFrame([], RULES), spark.createDataFrame([], LIMITS)


def samples(spark, series, repeat=()):
    """series: {(file, channel_id): (channel, unit, [value], [time_ns] or None)}"""
    rows = []
    now = dt.datetime(2024, 1, 1)
    for (file, cid), (name, unit, values, times) in series.items():
        for i, v in enumerate(values):
            row = (file, "motec", cid, name, unit, "declared", 10.0, i, int(times[i]) if times else i * 100_000_000, None if v is None else float(v), now, "x", 1, "h")
            rows.append(row)
            if i in repeat:
                rows.append(row[:10] + (now + dt.timedelta(hours=1),) + row[11:])
    return spark.createDataFrame(rows, SAMPLES)


def channels(spark, rows):
    return spark.createDataFrame([(f, "motec", i, n, u, s, t, "x", "y") for f, i, n, u, s, t in rows], CHANNELS)


def chunks(spark, rows):
    return spark.createDataFrame([(f, c, k, p, n, 0, b, t, 0, "s") for f, c, k, p, n, b, t in rows], CHUNKS)
