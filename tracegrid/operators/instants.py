"""One UTC instant per recording from date, time and clock texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.runtime import broadcast_if_small, columns_named, materialise

#: Version of the rules of ``parse_instants``; a dictionary kept across runs belongs to one.
GRAMMAR = 1
#: Seconds by which GPS time is ahead of UTC, and the GPS epoch as Unix seconds.
GPS_AHEAD_S = 18
GPS_EPOCH_S = 315_964_800

#: Minutes east of UTC of zone abbreviations.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "SAST": 120, "MSK": 180, "GST": 240, "IST": 330, "SGT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "BRT": -180, "BRST": -120, "ART": -180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$"
_ZONE = r"(?i)\s*(?:Z|[+-]\d{2}(?::?\d{2})?|(?:UTC|GMT)[+-]\d{1,2}(?::?\d{2})?|[A-Z]{2,5})$"
KEY = ["date_text", "time_text", "clock", "tz_name", "day_first"]


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _group(c: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(c, pattern, i)


def _year(text: Column) -> Column:
    return F.when(F.length(text) == 2, _int(text) + 2000).otherwise(_int(text))


def _day(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01; NULL for a date that does not exist."""
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), F.unix_date(text.try_cast("date")))


def _parsed_day(d: Column, day_first: Column) -> Column:
    """Days since 1970-01-01 of a date text in any of the known forms."""
    ymd = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$"
    packed = r"^(\d{4})(\d{2})(\d{2})$"
    dotted = r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})$"
    dashed = r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
    named = r"^(\d{1,2})[-/ .]+([A-Za-z]{3,9})\.?[-/ ,.]+(\d{4}|\d{2})$"
    turned = r"^([A-Za-z]{3,9})\.?[- ]+(\d{1,2}),?[- ]+(\d{4})$"
    month = lambda c: F.nullif(F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.substring(c, 1, 3))).cast("int"), F.lit(0))
    a, b = _int(_group(d, _SLASHED, 1)), _int(_group(d, _SLASHED, 2))
    return (
        F.when(d.rlike(ymd), _day(_int(_group(d, ymd, 1)), _int(_group(d, ymd, 2)), _int(_group(d, ymd, 3))))
        .when(d.rlike(packed), _day(_int(_group(d, packed, 1)), _int(_group(d, packed, 2)), _int(_group(d, packed, 3))))
        .when(d.rlike(_SLASHED), _day(_year(_group(d, _SLASHED, 3)), F.when(day_first, b).otherwise(a), F.when(day_first, a).otherwise(b)))
        .when(d.rlike(dotted), _day(_year(_group(d, dotted, 3)), _int(_group(d, dotted, 2)), _int(_group(d, dotted, 1))))
        .when(d.rlike(dashed), _day(_int(_group(d, dashed, 3)), _int(_group(d, dashed, 2)), _int(_group(d, dashed, 1))))
        .when(d.rlike(named), _day(_year(_group(d, named, 3)), month(_group(d, named, 2)), _int(_group(d, named, 1))))
        .when(d.rlike(turned), _day(_int(_group(d, turned, 3)), month(_group(d, turned, 1)), _int(_group(d, turned, 2))))
    )


def _parsed_time(t: Column) -> Column:
    """Microseconds since midnight of a time text without zone; NULL if impossible."""
    colon = r"^(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp])?\.?(?:[Mm]\.?)?$"
    packed = r"^(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?$"
    hour, half = _int(_group(t, colon, 1)), F.upper(_group(t, colon, 5))
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "P", 12).otherwise(0))
    number = lambda p, i: F.coalesce(_int(_group(t, p, i)), F.lit(0))
    micros = lambda p: F.rpad(F.substring(_group(t, p, 4), 1, 6), 6, "0").try_cast("long")

    def total(h: Column, p: str) -> Column:
        m, s = number(p, 2), number(p, 3)
        return F.when(h.between(0, 23) & m.between(0, 59) & s.between(0, 59), ((h.cast("long") * 60 + m) * 60 + s) * 1_000_000 + micros(p))

    return F.when(t.rlike(colon), total(hour, colon)).when(t.rlike(packed), total(_int(_group(t, packed, 1)), packed))


def _zone_minutes(z: Column) -> Column:
    """Minutes east of UTC of a zone text (offset or abbreviation); NULL if there is none."""
    z = F.regexp_replace(z, r"^(UTC|GMT)(?=[+-])", "")
    form = r"^([+-])(\d{1,2}):?(\d{2})?$"
    table = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    minutes = _int(_group(z, form, 2)) * 60 + F.coalesce(_int(_group(z, form, 3)), F.lit(0))
    return F.when(z.rlike(form), F.when(_group(z, form, 1) == "-", -minutes).otherwise(minutes)).when(z != "", F.try_element_at(table, z))


def _clean(c: str) -> Column:
    text = F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " "))
    return F.when(F.lower(text).isin("n/a", "na", "none", "null", "(null)", "-", "unknown", "?"), "").otherwise(text)


def parse_instants(entries: DataFrame) -> DataFrame:
    """``start_utc_us`` of dictionary entries (columns ``KEY``), parsed exhaustively with JVM expressions."""
    stamp = r"^(\d{4}-\d{2}-\d{2}|\d{8})[Tt ](.+)$"
    d, t = F.col("date_text"), F.col("time_text")
    whole = F.when((t == "") & d.rlike(stamp), d).when((d == "") & t.rlike(stamp), t)
    df = entries.withColumns({"d": F.when(whole.isNotNull(), _group(whole, stamp, 1)).otherwise(d), "tz": F.when(whole.isNotNull(), _group(whole, stamp, 2)).otherwise(t)})
    tz = F.col("tz")
    half_day = tz.rlike(r"(?i)^[\d:.,]+\s*[ap]\.?m\.?$")
    df = df.withColumn("zone", F.when(half_day, "").otherwise(F.upper(F.trim(F.regexp_extract(tz, _ZONE, 0)))))
    df = df.withColumn("t", F.when(F.col("zone") == "", tz).otherwise(F.trim(F.expr("substr(tz, 1, length(tz) - length(zone))"))))
    df = df.withColumns({"day": _parsed_day(F.col("d"), F.col("day_first")), "us": _parsed_time(F.col("t"))})
    wall = F.col("day").cast("long") * 86_400_000_000 + F.col("us")
    df = df.withColumn("wall", wall)

    count = F.when(F.col("date_text") == "", F.col("time_text")).when(F.col("time_text") == "", F.col("date_text"))
    bare = count.rlike(r"^\d{9,19}$")
    n = count.try_cast("long")
    unix = F.when(n < 10**11, n * 1_000_000).when(n < 10**14, n * 1000).when(n < 10**17, n).otherwise(F.floor(n / F.lit(1000).cast("decimal(20,0)")).cast("long"))
    week, ms = F.col("date_text").try_cast("long"), F.col("time_text").try_cast("long")
    gps = F.when(
        F.col("date_text").rlike(r"^\d{1,5}$") & F.col("time_text").rlike(r"^\d{1,9}$") & (ms < 604_800_000),
        (GPS_EPOCH_S + week * 604_800 - GPS_AHEAD_S) * 1_000_000 + ms * 1000,
    )
    # The wall clock as a timestamp without zone, so that the session's zone plays no part.
    naive = F.timestamp_add("MICROSECOND", F.col("wall"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    utc = F.convert_timezone(F.col("tz_name"), F.lit("UTC"), naive)
    local = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), utc)
    offset = _zone_minutes(F.col("zone"))
    clock = F.col("clock")
    start = (
        F.when(bare, unix)
        .when(F.col("zone") != "", F.col("wall") - offset.cast("long") * 60_000_000)
        .when(clock == "gps", gps)
        .when(clock.isin("utc", "time_of_day"), F.col("wall"))
        .when(clock.isin("local", "") & F.col("tz_name").isNotNull(), local)
    )
    return df.select(*KEY, start.alias("start_utc_us"))


def slash_order(files: DataFrame) -> DataFrame:
    """(logger_id, day_first): the order of day and month in each logger's slashed dates.

    Evidence, in this order: dates that exist in one order only; how near the
    readings lie to ``received_at`` (taken together, so one late delivery does
    not decide).  A logger without evidence counts as day first.
    """
    s = files.select("logger_id", "received_at", _clean("date").alias("d")).where(F.col("d").rlike(_SLASHED)).distinct()
    dmy, mdy = _parsed_day(F.col("d"), F.lit(True)), _parsed_day(F.col("d"), F.lit(False))
    seen = F.unix_date(F.col("received_at").cast("date"))
    near = lambda day: F.least(F.abs(seen - day), F.lit(400))
    both = dmy.isNotNull() & mdy.isNotNull()
    votes = s.select(
        "logger_id",
        F.when(dmy.isNotNull() & mdy.isNull(), 1).when(dmy.isNull() & mdy.isNotNull(), -1).otherwise(0).alias("only"),
        F.when(both, near(mdy) - near(dmy)).alias("nearer"),
    )
    g = votes.groupBy("logger_id").agg(F.sum("only").alias("only"), F.sum(F.signum("nearer")).alias("nearer"))
    return g.select("logger_id", F.when(F.col("only") != 0, F.col("only") > 0).otherwise(F.coalesce(F.col("nearer"), F.lit(0.0)) >= 0).alias("day_first"))


def normalise_instants(source_files: DataFrame, venues: DataFrame, dictionary: str | None = None) -> DataFrame:
    """(file, start_utc_us): the UTC instant of every recording whose texts fix one.

    The distinct (date, time, clock, zone, order) texts form a dictionary; only
    entries that the persisted dictionary lacks are parsed, once, and appended to
    it; the instants are then joined back to the rows.  ``dictionary`` is the
    folder of a dictionary kept across runs (a new one in the scratch folder
    otherwise).  NULL, empty and placeholder texts count as blank; texts in no
    known form, impossible dates and wall clocks without known venue give no row.
    Repeated rows count once, an empty table gives an empty result.
    """
    spark = source_files.sparkSession
    f = columns_named(source_files, "file", "logger_id", "venue", "date", "time", "clock", "received_at").where("file is not null").distinct()
    place = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    zones = venues.select(place(F.col("venue")).alias("place"), "tz_name").where("place is not null and tz_name is not null").groupBy("place").agg(F.min("tz_name").alias("tz_name"))
    clock = F.lower(F.regexp_replace(_clean("clock"), r"\s+", ""))
    rows = (
        f.withColumn("place", place(F.col("venue")))
        .join(broadcast_if_small(zones), "place", "left")
        .join(slash_order(f), "logger_id", "left")
        .select("file", _clean("date").alias("date_text"), _clean("time").alias("time_text"), clock.alias("clock"), F.col("tz_name"), F.coalesce(F.col("day_first"), F.lit(True)).alias("day_first"))
    )
    # The zone and the order are part of an entry only where they can matter.
    slashed = F.col("date_text").rlike(_SLASHED)
    rows = rows.withColumns({"day_first": F.when(slashed, F.col("day_first")).otherwise(True), "tz_name": F.when(F.col("clock").isin("local", ""), F.col("tz_name"))})
    wanted = rows.select(*KEY).where("date_text <> '' or time_text <> ''").distinct()
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in KEY]
    if dictionary:
        schema = parse_instants(wanted).schema
        try:
            known = spark.read.schema(schema).parquet(dictionary)
            fresh = wanted.alias("a").join(known.alias("b"), same, "left_anti")
        except Exception as e:  # no dictionary yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            fresh = wanted
        parse_instants(fresh).write.mode("append").parquet(dictionary)
        book = spark.read.schema(schema).parquet(dictionary).distinct()
    else:
        book = materialise(parse_instants(wanted), "instants")
    out = rows.alias("a").join(book.where("start_utc_us is not null").alias("b"), same)
    return out.select("a.file", "b.start_utc_us").distinct()
