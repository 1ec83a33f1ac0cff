"""Which channel of a file plays which part, layout signatures, and what the parts are used for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.model import normalised
from tracegrid.operators.blocks import along, time_block

#: Per role the normalised names in order of preference, else a pattern in the name, and one that rules it out.
ROLES = {
    "speed": (("groundspeed", "speedref", "corrspeed", "vehiclespeed", "gpsspeed", "speed", "velocitykmh"), "speed|velocity", "engine|wheel|target|limit"),
    "throttle": (("throttlepos", "driverthrottlepos", "throttlepedal", "throttle"), "throttle", None),
    "brake": (("brakepedalpos", "driverbrakepressure", "brakepressure", "brake"), "brake|p_f_brake", None),
    "gLat": (("gforcelat", "lateralacceleration", "glat"), "accel.*lat|lat.*accel|glat|g force lat", None),
    "gLong": (("gforcelong", "longitudinalacceleration", "glong"), "accel.*long|long.*accel|glong|g force long", None),
    "distance": (("lapdistancecorrected", "lapdistance", "lapdist", "lapdistpct", "distance"), "lap.*dist|distance", None),
}
#: Channels that most recordings have, by normalised name in order of preference.
COMMON = {
    "speed": ("speedref", "corrspeed", "groundspeed", "vehrefspeed", "wheelspeedavg", "uspeed"),
    "throttle": ("driverthrottlepos", "accelpedalpos", "fbwdrivertps", "pps", "tpsreal"),
    "front brake": ("brakepressuref", "brakepressurefr", "pfbrake"),
    "rpm": ("enginespeed", "rpm", "enginerpm"),
    "steering": ("steeringangle", "steerangle", "steering"),
    "gear": ("gearpos", "gearposdisplay", "gear"),
    "longitudinal accel": ("iaccellong", "gforcelong", "fiaaccelx", "glong"),
    "lateral accel": ("iaccellat", "gforcelat", "fiaaccely", "glat"),
}
#: Normalised names of coordinates.
LATITUDE, LONGITUDE = ("lat", "latitude", "gpslat", "gpslatitude"), ("lon", "long", "longitude", "gpslon", "gpslongitude")
#: Fixed value: start of the signature's hash.
SEED = 5381
#: Channels shown of a file that has none of the common ones.
OTHERS = 4


def _place(names: tuple[str, ...]) -> Column:
    """The place of a normalised name in a list, NULL if it is not there."""
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), normalised(F.col("name"))), F.lit(0))


def signal_roles(channels: DataFrame) -> DataFrame:
    """(file, role, channel_id, name): the sampled channel that plays each role in a file, where one does.

    The first name of the role's list that the file has, its first channel in
    file order; without any, the first channel that the role's pattern finds.
    """
    found = []
    for role, (names, pattern, exclude) in ROLES.items():
        told = F.col("name").rlike(f"(?i){pattern}")
        if exclude:
            told &= ~F.col("name").rlike(f"(?i){exclude}")
        rank = F.coalesce(_place(names), F.when(told, F.lit(1000)))
        found.append(F.when(rank.isNotNull(), F.struct(F.lit(role).alias("role"), rank.cast("int").alias("rank"))))
    c = channels.where("sample_count > 0").select("file", "channel_id", "name", F.explode(F.array_compact(F.array(*found))).alias("r"))
    g = c.groupBy("file", "r.role").agg(F.min(F.struct("r.rank", "channel_id", "name")).alias("m"))
    return g.select("file", "role", "m.channel_id", "m.name")


def common_channels(channels: DataFrame) -> DataFrame:
    """(file, part, channel_id, name): the common channels a file has, or its first four if it has none."""
    found = [F.when(_place(names).isNotNull(), F.struct(F.lit(part).alias("part"), _place(names).alias("rank"))) for part, names in COMMON.items()]
    c = channels.where("sample_count > 0")
    known = c.select("file", "channel_id", "name", F.explode(F.array_compact(F.array(*found))).alias("r")).groupBy("file", "r.part").agg(F.min(F.struct("r.rank", "channel_id", "name")).alias("m"))
    known = known.select("file", "part", "m.channel_id", "m.name")
    # Channel lists are bounded by the file formats.
    rest = c.join(known.select("file").distinct(), "file", "left_anti").groupBy("file").agg(F.slice(F.array_sort(F.collect_list(F.struct("channel_id", "name"))), 1, OTHERS).alias("first"))
    return known.unionByName(rest.select("file", F.explode("first").alias("m")).select("file", F.lit("other").alias("part"), "m.channel_id", "m.name"))


def layout_signature(channels: DataFrame) -> DataFrame:
    """(file, signature): a 32-bit hash of the sorted normalised names of a file, the same for equal layouts."""
    g = channels.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(normalised(F.col("name")))), "|").alias("t"))
    fold = F.expr(f"aggregate(filter(split(t, ''), c -> c <> ''), {SEED}L, (h, c) -> pmod(h * 33L, 4294967296L) ^ cast(ascii(c) as bigint))")
    return g.select("file", fold.alias("signature"))


def _unit_text(unit: Column) -> Column:
    return F.replace(F.lower(F.coalesce(unit, F.lit(""))), F.lit(" "), F.lit(""))


def speed_to_kmh(value: Column, unit: Column) -> Column:
    """A speed in km/h from its unit text; a text that is neither m/s nor mph is taken for km/h."""
    u = _unit_text(unit)
    return value * F.when(u.isin("m/s", "mps"), 3.6).when(u == "mph", 1.609344).otherwise(1.0)


def acceleration_to_g(value: Column, unit: Column) -> Column:
    """An acceleration in g from its unit text; a text that is not in metres a second is taken for g."""
    u = _unit_text(unit)
    return F.when(u.contains("m/s") | u.contains("m.s"), value / 9.80665).otherwise(value)


def gps_track(samples: DataFrame, channels: DataFrame) -> DataFrame:
    """(file, time_ns, latitude, longitude): each latitude with the longitude last recorded; impossible coordinates and 0, 0 left out."""
    c = channels.where("sample_count > 0")
    axis = lambda names: c.where(normalised(F.col("name")).isin(*names)).groupBy("file").agg(F.min("channel_id").alias("channel_id"))
    pair = axis(LATITUDE).withColumnRenamed("channel_id", "la").join(axis(LONGITUDE).withColumnRenamed("channel_id", "lo"), "file")
    s = samples.join(pair, "file").where("channel_id in (la, lo)")
    is_lat = F.col("channel_id") == F.col("la")
    s = s.select("file", "time_ns", is_lat.cast("int").alias("k"), F.when(is_lat, F.col("value")).alias("latitude"), F.when(~is_lat, F.struct("value")).alias("v"))
    s = along(s, ["file"], ["time_ns", "k"], time_block(), latest={"last": F.col("v")}).where("k = 1").select("file", "time_ns", "latitude", F.col("last.value").alias("longitude"))
    return s.where("abs(latitude) <= 90 and abs(longitude) <= 180 and not (latitude = 0 and longitude = 0)")


def _names_sql(names: tuple[str, ...]) -> str:
    return f"list_position([{', '.join(repr(n) for n in names)}], regexp_replace(lower(name), '[^a-z0-9]', '', 'g'))"


#: The same rules for the SQL side, over a relation ``def`` of definitions.
ROLES_SQL = "rk AS (" + " UNION ALL ".join(
    f"SELECT file, channel_id, name, '{role}' AS role, CASE WHEN {_names_sql(names)} > 0 THEN {_names_sql(names)} WHEN regexp_matches(name, '{pattern}', 'i')" + (f" AND NOT regexp_matches(name, '{exclude}', 'i')" if exclude else "") + " THEN 1000 END AS rank FROM def WHERE sample_count > 0"
    for role, (names, pattern, exclude) in ROLES.items()
) + "), roles AS (SELECT file, role, arg_min(channel_id, (rank, channel_id)) AS channel_id, arg_min(name, (rank, channel_id)) AS name FROM rk WHERE rank IS NOT NULL GROUP BY 1, 2)"
COMMON_SQL = "ck AS (" + " UNION ALL ".join(f"SELECT file, channel_id, name, '{part}' AS part, {_names_sql(names)} AS rank FROM def WHERE sample_count > 0" for part, names in COMMON.items()) + f"""),
cf AS (SELECT file, part, arg_min(channel_id, (rank, channel_id)) AS channel_id, arg_min(name, (rank, channel_id)) AS name FROM ck WHERE rank > 0 GROUP BY 1, 2),
common AS (SELECT * FROM cf UNION ALL SELECT file, 'other', channel_id, name FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY channel_id) AS r FROM def WHERE sample_count > 0 AND file NOT IN (SELECT file FROM cf)) WHERE r <= {OTHERS})"""  # fmt: skip
SPEED_SQL = "CASE replace(lower(coalesce(unit, '')), ' ', '') WHEN 'm/s' THEN 3.6 WHEN 'mps' THEN 3.6 WHEN 'mph' THEN 1.609344 ELSE 1.0 END"
G_SQL = "CASE WHEN replace(lower(coalesce(unit, '')), ' ', '') LIKE '%m/s%' OR replace(lower(coalesce(unit, '')), ' ', '') LIKE '%m.s%' THEN 1 / 9.80665 ELSE 1.0 END"
