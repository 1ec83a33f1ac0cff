"""Registered queries of the engine's operators over the logger tables as they were delivered.

Here are readings delivered twice and late, values that are no numbers, gaps
between chunks, layouts that drift and the long endurance recording.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.model import FLOATING, STEP_NAMES, finite, normalised
from tracegrid.operators import events as ev
from tracegrid.operators import resample as rs
from tracegrid.operators import roles as ro
from tracegrid.operators import sessions as se
from tracegrid.operators.blocks import stored_once
from tracegrid.operators.quantiles import exact_quantiles
from tracegrid.plans.engine import _merged
from tracegrid.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SECOND = 1_000_000_000

#: Each stored reading once; a value that is no finite number is NULL.
_SMP = "smp AS (SELECT DISTINCT file, channel_id, channel, sample_index, time_ns, CASE WHEN value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) THEN value END AS value FROM telemetry_samples)"
_DUR = "dur AS (SELECT file, channel, max(time_ns) + 1000000000 AS duration FROM smp GROUP BY 1, 2)"
_DEF = "def AS (SELECT file, channel_id, min(name) AS name, min(data_type) AS data_type, max(sample_count) AS sample_count, min(unit) AS unit FROM channels GROUP BY 1, 2)"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = ("WITH " + _SMP + "," if sql.lstrip().startswith(">") else "") + sql.lstrip().lstrip(">")
        return f

    return register


def readings(spark: SparkSession, d: str) -> DataFrame:
    """file, channel_id, channel, sample_index, time_ns, value: each stored reading once."""
    s = table(spark, d, "telemetry_samples").select("file", "channel_id", "channel", "sample_index", "time_ns", "value")
    return stored_once(s).withColumn("value", F.when(finite(F.col("value")), F.col("value")))


def definitions(spark: SparkSession, d: str) -> DataFrame:
    """file, channel_id, name, data_type, sample_count, unit: one row per channel definition."""
    return table(spark, d, "channels").groupBy("file", "channel_id").agg(*[f(c).alias(c) for c, f in (("name", F.min), ("data_type", F.min), ("sample_count", F.max), ("unit", F.min))])


def timed(s: DataFrame) -> DataFrame:
    """``s`` plus the duration of its channels: a second past the last reading."""
    return s.join(s.groupBy("file", "channel").agg((F.max("time_ns") + SECOND).alias("duration_ns")), ["file", "channel"])


_TICKS = _DUR + """,
nx AS (SELECT *, lead(time_ns) OVER w AS nt, lead(value) OVER w AS nv FROM smp WINDOW w AS (PARTITION BY file, channel ORDER BY sample_index)),
grid AS (SELECT file, channel, duration, unnest(generate_series(0, (duration + 999999999) // 1000000000 - 1)) AS tick FROM dur),
j AS (SELECT g.file, g.channel, g.tick, g.tick * 1000000000 AS time_ns, nx.channel_id, nx.time_ns AS ta, nx.value AS a, nx.nt AS tb, nx.nv AS b, f.value AS f
      FROM grid g ASOF LEFT JOIN nx ON g.file = nx.file AND g.channel = nx.channel AND g.tick * 1000000000 >= nx.time_ns
      JOIN smp f ON f.file = g.file AND f.channel = g.channel AND f.sample_index = 0)"""


@query("> " + _TICKS + " SELECT file, channel, tick, time_ns, CASE WHEN ta IS NULL THEN f ELSE a END AS value FROM j")
def logger_previous(spark, d):
    return rs.resample(timed(readings(spark, d)).withColumn("data_type", F.lit("float64")), rate=1, interpolate="previous")


@query("> " + _TICKS + "," + _DEF + f""" SELECT j.file, channel, tick, time_ns, round(CASE WHEN ta IS NULL THEN f WHEN regexp_matches(regexp_replace(lower(channel), '[^a-z0-9]', '', 'g'), '{"|".join(STEP_NAMES)}')
  OR def.data_type NOT IN ({", ".join(f"'{x}'" for x in FLOATING)}) OR tb IS NULL OR time_ns <= ta THEN a ELSE a + (b - a) * ((time_ns - ta) / (tb - ta)) END, 6) AS value FROM j JOIN def ON j.file = def.file AND def.name = j.channel""")
def logger_linear(spark, d):
    kinds = definitions(spark, d).select("file", F.col("name").alias("channel"), "data_type")
    return rs.resample(timed(readings(spark, d)).join(kinds, ["file", "channel"]), rate=1).withColumn("value", F.round("value", 6))


@query("> " + _DUR + """,
k AS (SELECT DISTINCT c.file, s.channel, sample_base + sample_count - 1 AS sample_index, time_base_ns + sample_count * nullif(sample_period_ns, 0) AS extent FROM chunks c JOIN (SELECT DISTINCT file, channel_id, channel FROM smp) s USING (file, channel_id)),
nx AS (SELECT smp.*, extent, lead(time_ns) OVER w AS nt, lead(value) OVER w AS nv FROM smp LEFT JOIN k USING (file, channel, sample_index) WINDOW w AS (PARTITION BY smp.file, smp.channel ORDER BY smp.sample_index)),
grid AS (SELECT file, channel, unnest(generate_series(0, (duration + 999999999) // 1000000000 - 1)) * 1000000000 AS time_ns FROM dur),
j AS (SELECT g.file, g.channel, g.time_ns, nx.time_ns AS ta, nx.value AS a, nx.nv AS b, nx.nt, nx.extent, f.value AS f FROM grid g ASOF LEFT JOIN nx ON g.file = nx.file AND g.channel = nx.channel AND g.time_ns >= nx.time_ns
      JOIN smp f ON f.file = g.file AND f.channel = g.channel AND f.sample_index = 0)
SELECT file, channel, time_ns, CASE WHEN ta IS NULL THEN f WHEN extent IS NOT NULL AND time_ns >= extent AND nt IS NOT NULL THEN b ELSE a END AS value FROM j""")
def logger_chunk_gap(spark, d):
    s = readings(spark, d)
    names = s.select("file", "channel_id", "channel").distinct()
    k = table(spark, d, "chunks").select("file", "channel_id", "sample_base", "sample_count", "time_base_ns", F.nullif("sample_period_ns", F.lit(0)).alias("sample_period_ns")).distinct().join(names, ["file", "channel_id"])
    return rs.resample(rs.chunk_extents(timed(s).withColumn("data_type", F.lit("float64")), k), rate=1, interpolate="previous").drop("tick")


@query("""
> dl AS (SELECT file, channel, sample_index, time_ns, time_ns - lag(time_ns) OVER (PARTITION BY file, channel ORDER BY time_ns) AS delta FROM smp),
c AS (SELECT file, channel, delta, count(*) AS n FROM dl WHERE delta > 0 GROUP BY 1, 2, 3),
p AS (SELECT file, channel, delta AS period FROM (SELECT *, row_number() OVER (PARTITION BY file, channel ORDER BY n DESC, delta) AS r FROM c) WHERE r = 1),
k AS (SELECT dl.*, period, sum(CASE WHEN delta > 2 * period THEN 1 ELSE 0 END) OVER (PARTITION BY dl.file, dl.channel ORDER BY sample_index) AS chunk FROM dl LEFT JOIN p USING (file, channel))
SELECT file, channel, CAST(chunk AS BIGINT) AS chunk_index, min(period) AS sample_period_ns, min(sample_index) AS sample_base, count(*) AS sample_count, min(time_ns) AS time_base_ns FROM k GROUP BY 1, 2, 3""")
def logger_modal_chunks(spark, d):
    return rs.modal_chunks(readings(spark, d)).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@query("> q AS (SELECT 1) SELECT file, channel_id, channel, count(*) AS samples, count(value) AS finite, min(value) AS low, max(value) AS high, round(avg(value) FILTER (abs(value) < 1e6) + 1e-9, 6) AS mean FROM smp GROUP BY 1, 2, 3")
def logger_stats(spark, d):
    # Sentinels of 1e38 would drown a mean; the billionth keeps means that end in a half from falling either way.
    near = F.when(F.abs("value") < 1e6, F.col("value"))
    return readings(spark, d).groupBy("file", "channel_id", "channel").agg(F.count(F.lit(1)).alias("samples"), F.count("value").alias("finite"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg(near) + 1e-9, 6).alias("mean"))


@query("> q AS (SELECT 1) SELECT channel, count(value) AS n, quantile_disc(value, 0.01) AS p01, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM smp WHERE value IS NOT NULL GROUP BY 1")
def logger_percentiles(spark, d):
    q = exact_quantiles(readings(spark, d), ["channel"], (0.01, 0.5, 0.99), discrete=True)
    return q.select("channel", "n", *[F.get("quantiles", F.lit(i)).alias(c) for i, c in enumerate(("p01", "p50", "p99"))])


_GEAR = "regexp_replace(lower(channel), '[^a-z0-9]', '', 'g') IN ('gear', 'ngear', 'gearpos')"


@query(f"> o AS (SELECT file, channel, time_ns, value AS v, lag(value) OVER (PARTITION BY file, channel ORDER BY time_ns) AS b FROM smp WHERE {_GEAR}) SELECT file, channel, time_ns, b AS before, v AS after FROM o WHERE b IS DISTINCT FROM v")
def logger_transitions(spark, d):
    return ev.transitions(readings(spark, d).where(normalised(F.col("channel")).isin("gear", "ngear", "gearpos")))


_COUNTERS = ", ".join(f"'{n}'" for n in ev.LAP_NAMES)
_LAPS = "> " + _DEF + f""",
lc AS (SELECT file, min(channel_id) AS channel_id FROM def WHERE sample_count > 0 AND regexp_replace(lower(name), '[^a-z0-9]', '', 'g') IN ({_COUNTERS}) GROUP BY 1),
v AS (SELECT smp.file, time_ns, CAST(round(value) AS BIGINT) AS v FROM smp JOIN lc USING (file, channel_id) WHERE value IS NOT NULL),
fr AS (SELECT *, CASE WHEN v IS DISTINCT FROM lag(v) OVER w OR lag(time_ns) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM v WINDOW w AS (PARTITION BY file ORDER BY time_ns)),
e AS (SELECT smp.file, max(time_ns) + 1000000000 AS d FROM smp JOIN lc USING (file, channel_id) GROUP BY 1),
runs AS (SELECT fr.file, row_number() OVER w - 1 AS run, v AS value, time_ns AS start_ns, coalesce(lead(time_ns) OVER w, d) AS end_ns, count(*) OVER (PARTITION BY fr.file) AS n FROM fr JOIN e USING (file) WHERE fresh = 1 WINDOW w AS (PARTITION BY fr.file ORDER BY time_ns)),
laps AS (SELECT file, value AS number, start_ns, end_ns, end_ns - start_ns AS duration_ns, run > 0 AND run < n - 1 AS complete FROM runs WHERE value > 0)"""


def _counter(spark, d) -> DataFrame:
    of = ev.semantic_channel(definitions(spark, d), ev.LAP_NAMES).select("file", "channel_id")
    return timed(readings(spark, d)).join(of, ["file", "channel_id"], "left_semi")


@query(_LAPS + " SELECT * FROM laps")
def logger_laps(spark, d):
    return ev.laps_from_counter(_counter(spark, d))


@query(_LAPS + """ SELECT l.file, l.number, l.start_ns, s.channel, count(value) AS n, min(s.value) AS low, max(s.value) AS high FROM smp s JOIN laps l ON s.file = l.file AND s.time_ns >= l.start_ns AND s.time_ns < l.end_ns GROUP BY 1, 2, 3, 4""")
def logger_lap_stats(spark, d):
    j = ev.samples_in_laps(readings(spark, d), logger_laps(spark, d))
    return j.groupBy("file", "number", "start_ns", "channel").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


_SESSION = "> " + """f0 AS (SELECT DISTINCT file, driver, venue, session, received_at, duration_ns FROM source_files),
fl AS (SELECT file, lower(trim(venue)) || '/' || lower(trim(session)) AS session_key, epoch_us(received_at) * 1000 - duration_ns AS absolute_start_ns, epoch_us(received_at) * 1000 AS absolute_end_ns FROM f0),
so AS (SELECT *, CASE WHEN session_key IS NOT NULL AND absolute_start_ns <= lag(absolute_end_ns) OVER w + 86400000000000 THEN 0 ELSE 1 END AS fresh FROM fl WINDOW w AS (PARTITION BY session_key, CASE WHEN session_key IS NULL THEN file END ORDER BY absolute_start_ns NULLS FIRST, file)),
nu AS (SELECT *, CAST(sum(fresh) OVER (ORDER BY session_key NULLS FIRST, absolute_start_ns NULLS FIRST, file) - 1 AS BIGINT) AS i FROM so),
g AS (SELECT *, coalesce(session_key, 'unkeyed:' || i) || ':' || i AS name FROM nu)"""


def _deliveries(spark, d) -> DataFrame:
    """Recordings on the clock of their delivery, keyed by venue and session."""
    f = table(spark, d, "source_files").select("file", "venue", "session", "received_at", "duration_ns").distinct()
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("received_at").cast("timestamp_ntz")) * 1000
    key = F.concat(F.lower(F.trim("venue")), F.lit("/"), F.lower(F.trim("session")))
    return f.select("file", key.alias("session_key"), (us - F.col("duration_ns")).alias("absolute_start_ns"), us.alias("absolute_end_ns"))


@query(_SESSION + " SELECT file, name AS session FROM g")
def logger_session_groups(spark, d):
    return se.group_sessions(_deliveries(spark, d), 86_400).select("file", "session")


@query(_SESSION + "," + _LAPS.replace("> ", "", 1) + """,
li AS (SELECT name, number, absolute_start_ns + start_ns AS start_ns, absolute_start_ns + end_ns AS end_ns FROM laps JOIN g USING (file) WHERE absolute_start_ns IS NOT NULL),""" + _merged("li", "name", "number", 86_400 * SECOND, "ml") + """,
own AS (SELECT file, min(duration_ns) AS d, arg_min(number, (duration_ns, start_ns, number)) AS number FROM laps WHERE complete AND duration_ns >= 10000000000 GROUP BY 1),
so2 AS (SELECT name, min(d) AS d, arg_min(number, (d, file)) AS number FROM own JOIN g USING (file) GROUP BY 1),
tl AS (SELECT name, count(*) AS lap_count, min(d) FILTER (inside) AS d, arg_min(number, (d, start_ns, number)) FILTER (inside) AS number FROM (
  SELECT *, end_ns - start_ns AS d, lag(number) OVER w IS NOT NULL AND lead(number) OVER w IS NOT NULL AND end_ns - start_ns >= 10000000000 AS inside FROM ml WINDOW w AS (PARTITION BY name ORDER BY start_ns)) GROUP BY 1),
bs AS (SELECT name, count(*) AS file_count, min(absolute_start_ns) AS absolute_start_ns, max(absolute_end_ns) AS absolute_end_ns FROM g GROUP BY 1)
SELECT name AS session_key, file_count, absolute_start_ns, absolute_end_ns, coalesce(absolute_end_ns - absolute_start_ns, 0) AS duration_ns, coalesce(lap_count, 0) AS lap_count, coalesce(so2.number, tl.number) AS fastest_lap_number, coalesce(so2.d, tl.d) AS fastest_lap_time_ns
FROM bs LEFT JOIN tl USING (name) LEFT JOIN so2 USING (name)""")
def logger_sessions(spark, d):
    laps = logger_laps(spark, d)
    none = laps.select("file", F.col("number").alias("driver_id"), "start_ns", "end_ns").limit(0)
    return se.session_metadata(_deliveries(spark, d), none, laps.select("file", "number", "start_ns", "end_ns"), 86_400, ev.fastest_lap(laps)).drop("driver_ids", "stint_count")


# ---- roles, layouts, laps of the browser and recipes that need them


@query("WITH " + _DEF + "," + ro.ROLES_SQL + " SELECT * FROM roles")
def signal_roles(spark, d):
    return ro.signal_roles(definitions(spark, d))


@query("WITH " + _DEF + "," + ro.COMMON_SQL + " SELECT * FROM common")
def common_channels(spark, d):
    return ro.common_channels(definitions(spark, d))


@query("WITH " + _DEF + f""", n AS (SELECT file, channel_id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS n FROM def),
s AS (SELECT file, string_agg(n, '|' ORDER BY n) AS t FROM n GROUP BY 1),
h AS (SELECT file, list_reduce(list_prepend(CAST({ro.SEED} AS UBIGINT), list_transform(string_split(t, ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda h, c: xor((h * 33) % 4294967296, c)) AS h FROM s)
SELECT file, CAST(h AS BIGINT) AS signature FROM h""")
def layout_signatures(spark, d):
    return ro.layout_signature(definitions(spark, d))


@query("> " + _DEF + "," + ro.ROLES_SQL + f""",
sp AS (SELECT smp.file, max(value) AS top, arg_max(time_ns, (value, -time_ns)) AS at_ns, arg_max(unit, sample_index) AS unit FROM smp JOIN roles r ON r.file = smp.file AND r.role = 'speed' AND r.channel_id = smp.channel_id JOIN def ON def.file = smp.file AND def.channel_id = smp.channel_id WHERE value IS NOT NULL GROUP BY 1)
SELECT file, round(top * {ro.SPEED_SQL}, 6) AS top_kmh, at_ns FROM sp""")
def top_speed_kmh(spark, d):
    c = definitions(spark, d)
    of = ro.signal_roles(c).where("role = 'speed'").select("file", "channel_id").join(c.select("file", "channel_id", "unit"), ["file", "channel_id"])
    best = readings(spark, d).where("value is not null").groupBy("file", "channel_id").agg(F.max(F.struct("value", (-F.col("time_ns")).alias("t"))).alias("m"))
    return best.join(of, ["file", "channel_id"]).select("file", F.round(ro.speed_to_kmh(F.col("m.value"), F.col("unit")), 6).alias("top_kmh"), (-F.col("m.t")).alias("at_ns"))


@query("> " + _DEF + "," + ro.ROLES_SQL + f""",
gs AS (SELECT smp.file, r.role, max(abs(value)) * min({ro.G_SQL}) AS peak FROM smp JOIN roles r ON r.file = smp.file AND r.role IN ('gLat', 'gLong') AND r.channel_id = smp.channel_id JOIN def ON def.file = smp.file AND def.channel_id = smp.channel_id WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT file, max(round(peak, 6)) AS peak_g FROM gs GROUP BY 1""")
def directional_g(spark, d):
    c = definitions(spark, d)
    of = ro.signal_roles(c).where("role in ('gLat', 'gLong')").select("file", "channel_id", "role").join(c.select("file", "channel_id", "unit"), ["file", "channel_id"])
    most = readings(spark, d).where("value is not null").groupBy("file", "channel_id").agg(F.max(F.abs("value")).alias("peak"))
    return most.join(of, ["file", "channel_id"]).groupBy("file").agg(F.max(F.round(ro.acceleration_to_g(F.col("peak"), F.col("unit")), 6)).alias("peak_g"))


@query("> " + _DEF + "," + ro.ROLES_SQL + f""",
gv AS (SELECT smp.file, channel, time_ns, value * {ro.G_SQL} AS g FROM smp JOIN roles r ON r.file = smp.file AND r.role IN ('gLat', 'gLong') AND r.channel_id = smp.channel_id JOIN def ON def.file = smp.file AND def.channel_id = smp.channel_id WHERE value IS NOT NULL)
SELECT file, arg_max(channel, (abs(g), -time_ns, channel)) AS channel, round(arg_max(g, (abs(g), -time_ns, channel)), 6) AS peak_g, arg_max(time_ns, (abs(g), -time_ns, channel)) AS at_ns, round(max(g), 6) AS high, round(min(g), 6) AS low FROM gv GROUP BY 1""")
def peak_g(spark, d):
    c = definitions(spark, d)
    of = ro.signal_roles(c).where("role in ('gLat', 'gLong')").select("file", "channel_id").join(c.select("file", "channel_id", "unit"), ["file", "channel_id"])
    s = readings(spark, d).where("value is not null")
    # The greatest and the least reading of each channel first; a unit only scales them.
    peak = F.max(F.struct(F.abs("value").alias("size"), (-F.col("time_ns")).alias("t"), "channel", "value"))
    one = s.groupBy("file", "channel_id").agg(peak.alias("m"), F.max("value").alias("hi"), F.min("value").alias("lo")).join(of, ["file", "channel_id"])
    g = lambda x: ro.acceleration_to_g(F.col(x), F.col("unit"))
    top = one.groupBy("file").agg(F.max(F.struct(F.abs(g("m.value")).alias("size"), F.col("m.t").alias("t"), F.col("m.channel").alias("channel"), g("m.value").alias("g"))).alias("m"), F.max(g("hi")).alias("high"), F.min(g("lo")).alias("low"))
    return top.select("file", "m.channel", F.round("m.g", 6).alias("peak_g"), (-F.col("m.t")).alias("at_ns"), F.round("high", 6).alias("high"), F.round("low", 6).alias("low"))


_G_GRID = "> " + _DEF + "," + ro.ROLES_SQL + f""",
gs AS (SELECT smp.file, r.role, sample_index, time_ns, value * {ro.G_SQL} AS value FROM smp JOIN roles r ON r.file = smp.file AND r.role IN ('gLat', 'gLong') AND r.channel_id = smp.channel_id JOIN def ON def.file = smp.file AND def.channel_id = smp.channel_id),
du AS (SELECT file, role, max(time_ns) + 1000000000 AS d FROM gs GROUP BY 1, 2), bo AS (SELECT file, max(d) AS d FROM du GROUP BY 1 HAVING count(*) = 2),
nx AS (SELECT *, lead(time_ns) OVER w AS nt, lead(value) OVER w AS nv FROM gs WINDOW w AS (PARTITION BY file, role ORDER BY sample_index)),
gr AS (SELECT file, role, du.d, unnest(generate_series(0, (du.d + 9999999) // 10000000 - 1)) * 10000000 AS t FROM du SEMI JOIN bo USING (file)),
jg AS (SELECT gr.file, gr.role, gr.t, CASE WHEN nx.time_ns IS NULL THEN f.value WHEN nt IS NULL OR t <= nx.time_ns THEN nx.value ELSE nx.value + (nv - nx.value) * ((t - nx.time_ns) / (nt - nx.time_ns)) END AS v
  FROM gr ASOF LEFT JOIN nx ON gr.file = nx.file AND gr.role = nx.role AND gr.t >= nx.time_ns JOIN gs f ON f.file = gr.file AND f.role = gr.role AND f.sample_index = 0),
w AS (SELECT file, t, max(v) FILTER (role = 'gLat') AS a, max(v) FILTER (role = 'gLong') AS b FROM jg GROUP BY 1, 2)"""


@query(_G_GRID + " SELECT file, round(max(sqrt(a * a + b * b)), 6) AS combined_g FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def combined_g(spark, d):
    """The greatest resultant of both accelerations on one grid of 100 ticks a second."""
    c = definitions(spark, d)
    of = ro.signal_roles(c).where("role in ('gLat', 'gLong')").select("file", "channel_id", "role").join(c.select("file", "channel_id", "unit"), ["file", "channel_id"])
    s = timed(readings(spark, d)).join(of, ["file", "channel_id"])
    s = s.select("file", F.col("role").alias("channel"), "sample_index", "time_ns", ro.acceleration_to_g(F.col("value"), F.col("unit")).alias("value"), "duration_ns", F.lit("float64").alias("data_type"))
    w = rs.resample_wide(s, ["gLat", "gLong"], rate=100).where("gLat is not null and gLong is not null")
    return w.groupBy("file").agg(F.round(F.max(F.sqrt(F.col("gLat") * F.col("gLat") + F.col("gLong") * F.col("gLong"))), 6).alias("combined_g"))


_RESETS = _LAPS + f""",
many AS (SELECT file, CAST(round(value) AS BIGINT) AS number, min(time_ns) AS start_ns FROM smp JOIN lc USING (file, channel_id) WHERE value >= 0 AND value < 100000 GROUP BY 1, 2),
ct AS (SELECT file FROM many GROUP BY 1 HAVING count(*) > 1),
fd AS (SELECT file, max(time_ns) + 1000000000 AS d FROM smp GROUP BY 1),
rc AS (SELECT file, arg_min(channel_id, (p, channel_id)) AS channel_id, min(p) AS p FROM (SELECT file, channel_id, list_position([{", ".join(f"'{n}'" for n in ev.RESET_NAMES)}], regexp_replace(lower(name), '[^a-z0-9]', '', 'g')) AS p FROM def WHERE sample_count > 0) WHERE p > 0 GROUP BY 1),
dr AS (SELECT file, time_ns FROM (SELECT smp.file, time_ns, p, value, lag(value) OVER (PARTITION BY smp.file ORDER BY time_ns) AS b FROM smp JOIN rc USING (file, channel_id) WHERE value IS NOT NULL) WHERE b - value > CASE WHEN p <= 3 THEN 5 ELSE 20 END),
rs AS (SELECT file, time_ns FROM (SELECT *, lag(time_ns) OVER (PARTITION BY file ORDER BY time_ns) AS b FROM dr) WHERE b IS NULL OR time_ns - b > 5000000000),
bo AS (SELECT file, number, start_ns FROM many SEMI JOIN ct USING (file)
  UNION ALL SELECT file, row_number() OVER (PARTITION BY file ORDER BY t), t FROM (SELECT file, time_ns AS t FROM rs UNION ALL SELECT DISTINCT file, 0 FROM rs) ANTI JOIN ct USING (file)
  UNION ALL SELECT file, 1, 0 FROM fd WHERE file NOT IN (SELECT file FROM ct) AND file NOT IN (SELECT file FROM rs)),
wl AS (SELECT file, number, start_ns, coalesce(lead(start_ns) OVER w, d) AS end_ns, row_number() OVER w AS i, count(*) OVER (PARTITION BY file) AS n FROM bo JOIN fd USING (file) WINDOW w AS (PARTITION BY file ORDER BY start_ns))
SELECT file, CAST(number AS BIGINT) AS number, start_ns, end_ns, (i > 1 AND i < n) OR (n = 1 AND file NOT IN (SELECT file FROM rs)) AS complete FROM wl WHERE end_ns > start_ns"""


@query(_RESETS)
def laps_browser(spark, d):
    c, s = definitions(spark, d), readings(spark, d)
    ends = s.groupBy("file").agg((F.max("time_ns") + SECOND).alias("duration_ns"))
    return ev.laps_browser(s, c, ends)


@query(_LAPS + " SELECT file, number, start_ns, CAST(least(100, greatest(10, ceil(5000 / greatest(duration_ns / 1e9, 1)))) AS BIGINT) AS rate FROM laps")
def trace_rates(spark, d):
    return logger_laps(spark, d).select("file", "number", "start_ns", ev.trace_rate(F.col("duration_ns")).alias("rate"))


@query("WITH " + _DEF + " SELECT file, string_agg(name || ' -> ' || name || CASE WHEN coalesce(unit, '') <> '' THEN ' [' || unit || ']' ELSE '' END, '; ' ORDER BY channel_id) AS map FROM def WHERE name IS NOT NULL GROUP BY 1")
def recovered_map(spark, d):
    from tracegrid.channelmap import recovered_map as recover

    return recover(definitions(spark, d))


@query("""
> tr AS (SELECT file, channel_id, sample_index, value, lower(channel) AS n FROM smp),
st AS (SELECT channel, count(*) FILTER (value <> floor(value)) AS non_integer, min(value) AS low, max(value) AS high FROM smp WHERE value IS NOT NULL AND (lower(channel) LIKE '%gear%' OR lower(channel) LIKE '%lap%') GROUP BY 1)
SELECT channel, non_integer, low, high, CASE WHEN lower(channel) LIKE '%gear%' AND (high > 8 OR low < -1) THEN 'SUSPECT' WHEN non_integer > 0 THEN 'NON-INTEGER' ELSE 'ok' END AS verdict FROM st""")
def verify_discrete(spark, d):
    n = F.lower("channel")
    s = readings(spark, d).where(F.col("value").isNotNull() & (n.like("%gear%") | n.like("%lap%")))
    g = s.groupBy("channel").agg(F.count_if(F.col("value") != F.rint("value")).alias("non_integer"), F.min("value").alias("low"), F.max("value").alias("high"))
    verdict = F.when(n.like("%gear%") & ((F.col("high") > 8) | (F.col("low") < -1)), "SUSPECT").when(F.col("non_integer") > 0, "NON-INTEGER").otherwise("ok")
    return g.withColumn("verdict", verdict)


@query("""
> st AS (SELECT s.file, s.channel_id, min(value) AS low, max(value) AS high FROM smp s WHERE value IS NOT NULL GROUP BY 1, 2),
c AS (SELECT DISTINCT file, channel_id, canonical_unit FROM channels)
SELECT st.file, st.channel_id, round(low * u.to_base_factor + u.to_base_offset, 6) AS low, round(high * u.to_base_factor + u.to_base_offset, 6) AS high, l.quantity
FROM st JOIN c USING (file, channel_id) JOIN unit_defs u ON u.unit = c.canonical_unit JOIN (SELECT dimension, min(low) AS lo, max(high) AS hi, min(quantity) AS quantity FROM channel_limits GROUP BY 1) l ON l.dimension = u.dimension
WHERE low * u.to_base_factor + u.to_base_offset < l.lo OR high * u.to_base_factor + u.to_base_offset > l.hi""")
def verify_implausible(spark, d):
    """Channels whose range leaves the widest physical range of their dimension."""
    s = readings(spark, d).where("value is not null").groupBy("file", "channel_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    c = table(spark, d, "channels").select("file", "channel_id", F.col("canonical_unit").alias("unit")).distinct()
    u = table(spark, d, "unit_defs").select("unit", "dimension", "to_base_factor", "to_base_offset")
    wide = table(spark, d, "channel_limits").groupBy("dimension").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.min("quantity").alias("quantity"))
    base = lambda x: F.col(x) * F.col("to_base_factor") + F.col("to_base_offset")
    j = s.join(c, ["file", "channel_id"]).join(u, "unit").join(wide, "dimension").where((base("lo") < F.col("least")) | (base("hi") > F.col("most")))
    return j.select("file", "channel_id", F.round(base("lo"), 6).alias("low"), F.round(base("hi"), 6).alias("high"), "quantity")


# ---- the statistics tool: inventory, rates, raw and interpolated statistics


@query("SELECT file, count(*) AS definitions, count(*) FILTER (sample_count > 0) AS sampled, coalesce(CAST(sum(sample_count) FILTER (sample_count > 0) AS BIGINT), 0) AS samples, round(coalesce(max(duration_ns) FILTER (sample_count > 0), 0) / 1e9, 3) AS seconds FROM (SELECT DISTINCT * FROM channels) GROUP BY 1")
def stats_tool_files(spark, d):
    on = F.col("sample_count") > 0
    c = table(spark, d, "channels").distinct()
    return c.groupBy("file").agg(
        F.count(F.lit(1)).alias("definitions"), F.count_if(on).alias("sampled"), F.coalesce(F.sum(F.when(on, F.col("sample_count"))), F.lit(0)).alias("samples"), F.round(F.coalesce(F.max(F.when(on, F.col("duration_ns"))), F.lit(0)) / 1e9, 3).alias("seconds")
    )


@query("SELECT frequency_hz, count(*) AS channels, CAST(sum(sample_count) AS BIGINT) AS samples FROM (SELECT DISTINCT * FROM channels) WHERE sample_count > 0 AND frequency_hz > 0 GROUP BY 1")
def stats_tool_rates(spark, d):
    return table(spark, d, "channels").distinct().where("sample_count > 0 and frequency_hz > 0").groupBy("frequency_hz").agg(F.count(F.lit(1)).alias("channels"), F.sum("sample_count").alias("samples"))


@query(SQL["logger_linear"].replace(" SELECT j.file, channel, tick", ", il AS (SELECT j.file, channel, tick").rstrip() + ") SELECT file, channel, count(*) AS n, count(value) AS finite, min(value) AS low, max(value) AS high, round(avg(value) FILTER (abs(value) < 1e6) + 1e-9, 5) AS mean FROM il GROUP BY 1, 2")
def stats_tool_interp(spark, d):
    near = F.when(F.abs("value") < 1e6, F.col("value"))
    return logger_linear(spark, d).groupBy("file", "channel").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("finite"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg(near) + 1e-9, 5).alias("mean"))


@query("SELECT format, name, unit, list_aggregate(list(DISTINCT frequency_hz ORDER BY frequency_hz), 'string_agg', ',') AS rates, count(DISTINCT file) AS files FROM channels WHERE sample_count > 0 GROUP BY 1, 2, 3")
def rate_comparison(spark, d):
    c = table(spark, d, "channels").where("sample_count > 0")
    return c.groupBy("format", "name", "unit").agg(F.array_join(F.transform(F.sort_array(F.collect_set("frequency_hz")), lambda x: x.cast("string")), ",").alias("rates"), F.count_distinct("file").alias("files"))


@query("SELECT DISTINCT * EXCLUDE (format, type_code) FROM channels")
def exclude_columns(spark, d):
    return table(spark, d, "channels").drop("format", "type_code").distinct()


@query("SELECT file, any_value(format) AS format FROM channels GROUP BY 1")
def any_values(spark, d):
    return table(spark, d, "channels").groupBy("file").agg(F.any_value("format", F.lit(True)).alias("format"))


@query("SELECT file, channel_id, sample_count, NULL AS chunk_index, NULL AS time_base_ns FROM (SELECT DISTINCT file, channel_id, sample_count FROM channels) UNION ALL BY NAME SELECT DISTINCT file, channel_id, chunk_index, time_base_ns, sample_count FROM chunks")
def union_by_name(spark, d):
    c = table(spark, d, "channels").select("file", "channel_id", "sample_count").distinct()
    k = table(spark, d, "chunks").select("file", "channel_id", "chunk_index", "time_base_ns", "sample_count").distinct()
    return c.unionByName(k, allowMissingColumns=True)


@query("> q AS (SELECT 1) SELECT file, channel, count(DISTINCT value) AS distinct_values, abs(approx_count_distinct(value) - count(DISTINCT value)) <= 3 + 0.3 * count(DISTINCT value) AS near FROM smp GROUP BY 1, 2")
def approximate_distinct(spark, d):
    """The approximate number of distinct values beside the exact one."""
    g = readings(spark, d).groupBy("file", "channel").agg(F.count_distinct("value").alias("distinct_values"), F.approx_count_distinct("value").alias("a"))
    return g.select("file", "channel", "distinct_values", (F.abs(F.col("a") - F.col("distinct_values")) <= 3 + 0.3 * F.col("distinct_values")).alias("near"))


@query("SELECT file, channel_id, count(*) OVER () AS total, sum(count(*)) OVER () AS readings, count(*) AS n FROM telemetry_samples GROUP BY 1, 2")
def whole_totals(spark, d):
    """Totals beside every row: an aggregate joined to one row, not a window over everything in one task."""
    g = table(spark, d, "telemetry_samples").groupBy("file", "channel_id").agg(F.count(F.lit(1)).alias("n"))
    one = g.agg(F.count(F.lit(1)).alias("total"), F.sum("n").alias("readings"))
    return g.crossJoin(F.broadcast(one)).select("file", "channel_id", "total", "readings", "n")


@query("> " + _DEF + "," + ro.ROLES_SQL + f""",
gv AS (SELECT smp.file, channel, time_ns, value * {ro.G_SQL} AS g FROM smp JOIN roles r ON r.file = smp.file AND r.role IN ('gLat', 'gLong') AND r.channel_id = smp.channel_id JOIN def ON def.file = smp.file AND def.channel_id = smp.channel_id WHERE value IS NOT NULL)
SELECT file, arg_max(channel, (abs(g), -time_ns, channel)) AS channel, round(arg_max(g, (abs(g), -time_ns, channel)), 6) AS peak_g, arg_max(time_ns, (abs(g), -time_ns, channel)) AS at_ns, round(max(g), 6) AS high, round(min(g), 6) AS low FROM gv GROUP BY 1""")
def peak_g(spark, d):
    c = definitions(spark, d)
    of = ro.signal_roles(c).where("role in ('gLat', 'gLong')").select("file", "channel_id").join(c.select("file", "channel_id", "unit"), ["file", "channel_id"])
    s = readings(spark, d).where("value is not null")
    # The greatest and the least reading of each channel first; a unit only scales them.
    peak = F.max(F.struct(F.abs("value").alias("size"), (-F.col("time_ns")).alias("t"), "channel", "value"))
    one = s.groupBy("file", "channel_id").agg(peak.alias("m"), F.max("value").alias("hi"), F.min("value").alias("lo")).join(of, ["file", "channel_id"])
    g = lambda x: ro.acceleration_to_g(F.col(x), F.col("unit"))
    top = one.groupBy("file").agg(F.max(F.struct(F.abs(g("m.value")).alias("size"), F.col("m.t").alias("t"), F.col("m.channel").alias("channel"), g("m.value").alias("g"))).alias("m"), F.max(g("hi")).alias("high"), F.min(g("lo")).alias("low"))
    return top.select("file", "m.channel", F.round("m.g", 6).alias("peak_g"), (-F.col("m.t")).alias("at_ns"), F.round("high", 6).alias("high"), F.round("low", 6).alias("low"))


_G_GRID = "> " + _DEF + "," + ro.ROLES_SQL + f""",
gs AS (SELECT smp.file, r.role, sample_index, time_ns, value * {ro.G_SQL} AS value FROM smp JOIN roles r ON r.file = smp.file AND r.role IN ('gLat', 'gLong') AND r.channel_id = smp.channel_id JOIN def ON def.file = smp.file AND def.channel_id = smp.channel_id),
du AS (SELECT file, role, max(time_ns) + 1000000000 AS d FROM gs GROUP BY 1, 2), bo AS (SELECT file, max(d) AS d FROM du GROUP BY 1 HAVING count(*) = 2),
nx AS (SELECT *, lead(time_ns) OVER w AS nt, lead(value) OVER w AS nv FROM gs WINDOW w AS (PARTITION BY file, role ORDER BY sample_index)),
gr AS (SELECT file, role, du.d, unnest(generate_series(0, (du.d + 9999999) // 10000000 - 1)) * 10000000 AS t FROM du SEMI JOIN bo USING (file)),
jg AS (SELECT gr.file, gr.role, gr.t, CASE WHEN nx.time_ns IS NULL THEN f.value WHEN nt IS NULL OR t <= nx.time_ns THEN nx.value ELSE nx.value + (nv - nx.value) * ((t - nx.time_ns) / (nt - nx.time_ns)) END AS v
  FROM gr ASOF LEFT JOIN nx ON gr.file = nx.file AND gr.role = nx.role AND gr.t >= nx.time_ns JOIN gs f ON f.file = gr.file AND f.role = gr.role AND f.sample_index = 0),
w AS (SELECT file, t, max(v) FILTER (role = 'gLat') AS a, max(v) FILTER (role = 'gLong') AS b FROM jg GROUP BY 1, 2)"""


@query(_G_GRID + " SELECT file, round(max(sqrt(a * a + b * b)), 6) AS combined_g FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def combined_g(spark, d):
    """The greatest resultant of both accelerations on one grid of 100 ticks a second."""
    c = definitions(spark, d)
    of = ro.signal_roles(c).where("role in ('gLat', 'gLong')").select("file", "channel_id", "role").join(c.select("file", "channel_id", "unit"), ["file", "channel_id"])
    s = timed(readings(spark, d)).join(of, ["file", "channel_id"])
    s = s.select("file", F.col("role").alias("channel"), "sample_index", "time_ns", ro.acceleration_to_g(F.col("value"), F.col("unit")).alias("value"), "duration_ns", F.lit("float64").alias("data_type"))
    w = rs.resample_wide(s, ["gLat", "gLong"], rate=100).where("gLat is not null and gLong is not null")
    return w.groupBy("file").agg(F.round(F.max(F.sqrt(F.col("gLat") * F.col("gLat") + F.col("gLong") * F.col("gLong"))), 6).alias("combined_g"))


_RESETS = _LAPS + f""",
many AS (SELECT file, CAST(round(value) AS BIGINT) AS number, min(time_ns) AS start_ns FROM smp JOIN lc USING (file, channel_id) WHERE value >= 0 AND value < 100000 GROUP BY 1, 2),
ct AS (SELECT file FROM many GROUP BY 1 HAVING count(*) > 1),
fd AS (SELECT file, max(time_ns) + 1000000000 AS d FROM smp GROUP BY 1),
rc AS (SELECT file, arg_min(channel_id, (p, channel_id)) AS channel_id, min(p) AS p FROM (SELECT file, channel_id, list_position([{", ".join(f"'{n}'" for n in ev.RESET_NAMES)}], regexp_replace(lower(name), '[^a-z0-9]', '', 'g')) AS p FROM def WHERE sample_count > 0) WHERE p > 0 GROUP BY 1),
dr AS (SELECT file, time_ns FROM (SELECT smp.file, time_ns, p, value, lag(value) OVER (PARTITION BY smp.file ORDER BY time_ns) AS b FROM smp JOIN rc USING (file, channel_id) WHERE value IS NOT NULL) WHERE b - value > CASE WHEN p <= 3 THEN 5 ELSE 20 END),
rs AS (SELECT file, time_ns FROM (SELECT *, lag(time_ns) OVER (PARTITION BY file ORDER BY time_ns) AS b FROM dr) WHERE b IS NULL OR time_ns - b > 5000000000),
bo AS (SELECT file, number, start_ns FROM many SEMI JOIN ct USING (file)
  UNION ALL SELECT file, row_number() OVER (PARTITION BY file ORDER BY t), t FROM (SELECT file, time_ns AS t FROM rs UNION ALL SELECT DISTINCT file, 0 FROM rs) ANTI JOIN ct USING (file)
  UNION ALL SELECT file, 1, 0 FROM fd WHERE file NOT IN (SELECT file FROM ct) AND file NOT IN (SELECT file FROM rs)),
wl AS (SELECT file, number, start_ns, coalesce(lead(start_ns) OVER w, d) AS end_ns, row_number() OVER w AS i, count(*) OVER (PARTITION BY file) AS n FROM bo JOIN fd USING (file) WINDOW w AS (PARTITION BY file ORDER BY start_ns))
SELECT file, CAST(number AS BIGINT) AS number, start_ns, end_ns, (i > 1 AND i < n) OR (n = 1 AND file NOT IN (SELECT file FROM rs)) AS complete FROM wl WHERE end_ns > start_ns"""


@query(_RESETS)
def laps_browser(spark, d):
    c, s = definitions(spark, d), readings(spark, d)
    ends = s.groupBy("file").agg((F.max("time_ns") + SECOND).alias("duration_ns"))
    return ev.laps_browser(s, c, ends)


@query(_LAPS + " SELECT file, number, start_ns, CAST(least(100, greatest(10, ceil(5000 / greatest(duration_ns / 1e9, 1)))) AS BIGINT) AS rate FROM laps")
def trace_rates(spark, d):
    return logger_laps(spark, d).select("file", "number", "start_ns", ev.trace_rate(F.col("duration_ns")).alias("rate"))


@query("WITH " + _DEF + " SELECT file, string_agg(name || ' -> ' || name || CASE WHEN coalesce(unit, '') <> '' THEN ' [' || unit || ']' ELSE '' END, '; ' ORDER BY channel_id) AS map FROM def WHERE name IS NOT NULL GROUP BY 1")
def recovered_map(spark, d):
    from tracegrid.channelmap import recovered_map as recover

    return recover(definitions(spark, d))


@query("""
> tr AS (SELECT file, channel_id, sample_index, value, lower(channel) AS n FROM smp),
st AS (SELECT channel, count(*) FILTER (value <> floor(value)) AS non_integer, min(value) AS low, max(value) AS high FROM smp WHERE value IS NOT NULL AND (lower(channel) LIKE '%gear%' OR lower(channel) LIKE '%lap%') GROUP BY 1)
SELECT channel, non_integer, low, high, CASE WHEN lower(channel) LIKE '%gear%' AND (high > 8 OR low < -1) THEN 'SUSPECT' WHEN non_integer > 0 THEN 'NON-INTEGER' ELSE 'ok' END AS verdict FROM st""")
def verify_discrete(spark, d):
    n = F.lower("channel")
    s = readings(spark, d).where(F.col("value").isNotNull() & (n.like("%gear%") | n.like("%lap%")))
    g = s.groupBy("channel").agg(F.count_if(F.col("value") != F.rint("value")).alias("non_integer"), F.min("value").alias("low"), F.max("value").alias("high"))
    verdict = F.when(n.like("%gear%") & ((F.col("high") > 8) | (F.col("low") < -1)), "SUSPECT").when(F.col("non_integer") > 0, "NON-INTEGER").otherwise("ok")
    return g.withColumn("verdict", verdict)


@query("""
> st AS (SELECT s.file, s.channel_id, min(value) AS low, max(value) AS high FROM smp s WHERE value IS NOT NULL GROUP BY 1, 2),
c AS (SELECT DISTINCT file, channel_id, canonical_unit FROM channels)
SELECT st.file, st.channel_id, round(low * u.to_base_factor + u.to_base_offset, 6) AS low, round(high * u.to_base_factor + u.to_base_offset, 6) AS high, l.quantity
FROM st JOIN c USING (file, channel_id) JOIN unit_defs u ON u.unit = c.canonical_unit JOIN (SELECT dimension, min(low) AS lo, max(high) AS hi, min(quantity) AS quantity FROM channel_limits GROUP BY 1) l ON l.dimension = u.dimension
WHERE low * u.to_base_factor + u.to_base_offset < l.lo OR high * u.to_base_factor + u.to_base_offset > l.hi""")
def verify_implausible(spark, d):
    """Channels whose range leaves the widest physical range of their dimension."""
    s = readings(spark, d).where("value is not null").groupBy("file", "channel_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    c = table(spark, d, "channels").select("file", "channel_id", F.col("canonical_unit").alias("unit")).distinct()
    u = table(spark, d, "unit_defs").select("unit", "dimension", "to_base_factor", "to_base_offset")
    wide = table(spark, d, "channel_limits").groupBy("dimension").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.min("quantity").alias("quantity"))
    base = lambda x: F.col(x) * F.col("to_base_factor") + F.col("to_base_offset")
    j = s.join(c, ["file", "channel_id"]).join(u, "unit").join(wide, "dimension").where((base("lo") < F.col("least")) | (base("hi") > F.col("most")))
    return j.select("file", "channel_id", F.round(base("lo"), 6).alias("low"), F.round(base("hi"), 6).alias("high"), "quantity")


# ---- the statistics tool: inventory, rates, raw and interpolated statistics


@query("SELECT file, count(*) AS definitions, count(*) FILTER (sample_count > 0) AS sampled, coalesce(CAST(sum(sample_count) FILTER (sample_count > 0) AS BIGINT), 0) AS samples, round(coalesce(max(duration_ns) FILTER (sample_count > 0), 0) / 1e9, 3) AS seconds FROM (SELECT DISTINCT * FROM channels) GROUP BY 1")
def stats_tool_files(spark, d):
    on = F.col("sample_count") > 0
    c = table(spark, d, "channels").distinct()
    return c.groupBy("file").agg(
        F.count(F.lit(1)).alias("definitions"), F.count_if(on).alias("sampled"), F.coalesce(F.sum(F.when(on, F.col("sample_count"))), F.lit(0)).alias("samples"), F.round(F.coalesce(F.max(F.when(on, F.col("duration_ns"))), F.lit(0)) / 1e9, 3).alias("seconds")
    )


@query("SELECT frequency_hz, count(*) AS channels, CAST(sum(sample_count) AS BIGINT) AS samples FROM (SELECT DISTINCT * FROM channels) WHERE sample_count > 0 AND frequency_hz > 0 GROUP BY 1")
def stats_tool_rates(spark, d):
    return table(spark, d, "channels").distinct().where("sample_count > 0 and frequency_hz > 0").groupBy("frequency_hz").agg(F.count(F.lit(1)).alias("channels"), F.sum("sample_count").alias("samples"))


@query(SQL["logger_linear"].replace(" SELECT j.file, channel, tick", ", il AS (SELECT j.file, channel, tick").rstrip() + ") SELECT file, channel, count(*) AS n, count(value) AS finite, min(value) AS low, max(value) AS high, round(avg(value) FILTER (abs(value) < 1e6) + 1e-9, 5) AS mean FROM il GROUP BY 1, 2")
def stats_tool_interp(spark, d):
    near = F.when(F.abs("value") < 1e6, F.col("value"))
    return logger_linear(spark, d).groupBy("file", "channel").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("finite"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg(near) + 1e-9, 5).alias("mean"))


@query("SELECT format, name, unit, list_aggregate(list(DISTINCT frequency_hz ORDER BY frequency_hz), 'string_agg', ',') AS rates, count(DISTINCT file) AS files FROM channels WHERE sample_count > 0 GROUP BY 1, 2, 3")
def rate_comparison(spark, d):
    c = table(spark, d, "channels").where("sample_count > 0")
    return c.groupBy("format", "name", "unit").agg(F.array_join(F.transform(F.sort_array(F.collect_set("frequency_hz")), lambda x: x.cast("string")), ",").alias("rates"), F.count_distinct("file").alias("files"))


@query("SELECT DISTINCT * EXCLUDE (format, type_code) FROM channels")
def exclude_columns(spark, d):
    return table(spark, d, "channels").drop("format", "type_code").distinct()


@query("SELECT file, any_value(format) AS format FROM channels GROUP BY 1")
def any_values(spark, d):
    return table(spark, d, "channels").groupBy("file").agg(F.any_value("format", F.lit(True)).alias("format"))


@query("SELECT file, channel_id, sample_count, NULL AS chunk_index, NULL AS time_base_ns FROM (SELECT DISTINCT file, channel_id, sample_count FROM channels) UNION ALL BY NAME SELECT DISTINCT file, channel_id, chunk_index, time_base_ns, sample_count FROM chunks")
def union_by_name(spark, d):
    c = table(spark, d, "channels").select("file", "channel_id", "sample_count").distinct()
    k = table(spark, d, "chunks").select("file", "channel_id", "chunk_index", "time_base_ns", "sample_count").distinct()
    return c.unionByName(k, allowMissingColumns=True)


@query("> q AS (SELECT 1) SELECT file, channel, count(DISTINCT value) AS distinct_values, abs(approx_count_distinct(value) - count(DISTINCT value)) <= 3 + 0.3 * count(DISTINCT value) AS near FROM smp GROUP BY 1, 2")
def approximate_distinct(spark, d):
    """The approximate number of distinct values beside the exact one."""
    g = readings(spark, d).groupBy("file", "channel").agg(F.count_distinct("value").alias("distinct_values"), F.approx_count_distinct("value").alias("a"))
    return g.select("file", "channel", "distinct_values", (F.abs(F.col("a") - F.col("distinct_values")) <= 3 + 0.3 * F.col("distinct_values")).alias("near"))


@query("SELECT file, channel_id, count(*) OVER () AS total, sum(count(*)) OVER () AS readings, count(*) AS n FROM telemetry_samples GROUP BY 1, 2")
def whole_totals(spark, d):
    """Totals beside every row: an aggregate joined to one row, not a window over everything in one task."""
    g = table(spark, d, "telemetry_samples").groupBy("file", "channel_id").agg(F.count(F.lit(1)).alias("n"))
    one = g.agg(F.count(F.lit(1)).alias("total"), F.sum("n").alias("readings"))
    return g.crossJoin(F.broadcast(one)).select("file", "channel_id", "total", "readings", "n")


_PAIR = "> " + _DEF + f""",
gp AS (SELECT file, arg_min(channel_id, channel_id) FILTER (regexp_replace(lower(name), '[^a-z0-9]', '', 'g') IN ({", ".join(f"'{n}'" for n in ro.LATITUDE)})) AS la, arg_min(channel_id, channel_id) FILTER (regexp_replace(lower(name), '[^a-z0-9]', '', 'g') IN ({", ".join(f"'{n}'" for n in ro.LONGITUDE)})) AS lo FROM def WHERE sample_count > 0 GROUP BY 1),
ax AS (SELECT s.file, s.sample_index, s.time_ns, s.value AS latitude FROM smp s JOIN gp ON gp.file = s.file AND gp.la = s.channel_id AND gp.lo IS NOT NULL),
ay AS (SELECT s.file, s.time_ns, s.value AS longitude FROM smp s JOIN gp ON gp.file = s.file AND gp.lo = s.channel_id AND gp.la IS NOT NULL),
tr AS (SELECT ax.file, ax.time_ns, latitude, longitude FROM ax ASOF JOIN ay ON ax.file = ay.file AND ax.time_ns >= ay.time_ns)
SELECT file, time_ns, latitude, longitude FROM tr WHERE abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT (latitude = 0 AND longitude = 0)"""


@query(_PAIR)
def gps_track(spark, d):
    """Each latitude with the longitude last recorded, where both are possible."""
    return ro.gps_track(readings(spark, d), definitions(spark, d))


@query(_LAPS + """,
b AS (SELECT file, arg_min(start_ns, (duration_ns, start_ns)) AS s, arg_min(end_ns, (duration_ns, start_ns)) AS e FROM laps GROUP BY 1)
SELECT smp.file, channel, sample_index, time_ns - s AS lap_ns, value FROM smp JOIN b ON smp.file = b.file AND time_ns >= s AND time_ns < e""")
def current_lap(spark, d):
    """All readings of each file's shortest lap, on the clock of the lap."""
    laps = logger_laps(spark, d)
    best = laps.groupBy("file").agg(F.min(F.struct("duration_ns", "start_ns", "end_ns", "number")).alias("b")).select("file", "b.*")
    j = ev.samples_in_laps(readings(spark, d), best)
    return j.select("file", "channel", "sample_index", (F.col("time_ns") - F.col("start_ns")).alias("lap_ns"), "value")


@query("WITH a AS (" + SQL["top_speed_kmh"] + "), b AS (" + SQL["directional_g"] + "), c AS (" + SQL["combined_g"] + "), l AS (" + SQL["logger_laps"] + """),
e AS (SELECT file, min(duration_ns) FILTER (complete AND duration_ns > 5000000000) AS best_lap_ns FROM l GROUP BY 1)
SELECT file, top_kmh, peak_g, combined_g, best_lap_ns FROM a FULL JOIN b USING (file) FULL JOIN c USING (file) FULL JOIN e USING (file)""")
def performance_cards(spark, d):
    """Top speed, greatest directional and combined acceleration and best lap of each file that has any."""
    best = logger_laps(spark, d).groupBy("file").agg(F.min(F.when(F.col("complete") & (F.col("duration_ns") > 5 * SECOND), F.col("duration_ns"))).alias("best_lap_ns"))
    out = top_speed_kmh(spark, d).drop("at_ns")
    for other in (directional_g(spark, d), combined_g(spark, d), best):
        out = out.join(other, "file", "full")
    return out


@query("SELECT name AS column_name FROM pragma_table_info('channels')")
def catalog_columns(spark, d):
    """The columns of a table as the catalog lists them."""
    table(spark, d, "channels").createOrReplaceTempView("catalogued_channels")
    return spark.sql("DESCRIBE TABLE catalogued_channels").select(F.col("col_name").alias("column_name"))
