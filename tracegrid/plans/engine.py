"""Registered queries of the engine's own operators: resampling, events, sessions, units, channel maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegrid import channelmap, units
from tracegrid.operators import events as ev
from tracegrid.operators import resample as rs
from tracegrid.operators import sessions as se
from tracegrid.plans.recordings import DAY_GAP, DAYS, SECOND, UNITS, day_files, day_samples, samples, with_duration
from tracegrid.plans.recordings import SQL as REC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CHANNELS = ["click", "error", "purchase", "signup", "view"]


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            text = sql.lstrip()
            SQL[f.__name__] = ("WITH " + DAYS + "," if text.startswith(">>") else "WITH " + REC + "," if text.startswith(">") else "") + text.lstrip(">")
        return f

    return register


def rounded(c: str, n: int = 6):
    return F.round(c, n).alias(c)


_GRID = """
> dur AS (SELECT file, channel, max(time_ns) + 1000000000 AS duration FROM smp GROUP BY 1, 2),
nx AS (SELECT *, lead(time_ns) OVER w AS nt, lead(value) OVER w AS nv FROM smp WINDOW w AS (PARTITION BY file, channel ORDER BY sample_index)),
grid AS (SELECT file, channel, duration, unnest(generate_series(0, (duration * 2 + 999999999) // 1000000000 - 1)) AS tick FROM dur),
tk AS (SELECT file, channel, duration, tick, tick * 1000000000 // 2 AS time_ns FROM grid WHERE tick * 1000000000 // 2 < duration),
j AS (SELECT tk.file, tk.channel, tk.tick, tk.time_ns, nx.time_ns AS ta, nx.value AS a, nx.nt AS tb, nx.nv AS b, f.value AS f
      FROM tk ASOF LEFT JOIN nx ON tk.file = nx.file AND tk.channel = nx.channel AND tk.time_ns >= nx.time_ns
      JOIN smp f ON f.file = tk.file AND f.channel = tk.channel AND f.sample_index = 0)"""


@query(_GRID + " SELECT file, channel, tick, time_ns, coalesce(a, f) AS value FROM j")
def asof_previous(spark, d):
    return rs.resample(with_duration(samples(spark, d)), rate=2, interpolate="previous")


_LINE = "CASE WHEN a IS NULL THEN f WHEN tb IS NULL OR time_ns <= ta OR tb <= ta THEN a ELSE a + (b - a) * ((time_ns - ta) / (tb - ta)) END"


@query(_GRID + f" SELECT file, channel, tick, time_ns, round({_LINE}, 6) AS value FROM j")
def resample_linear(spark, d):
    return rs.resample(with_duration(samples(spark, d)), rate=2).withColumn("value", F.round("value", 6))


def _wide_sql(expr: str) -> str:
    cols = ", ".join(f"max(CASE WHEN channel = '{c}' THEN {expr} END) AS \"{c}\"" for c in CHANNELS)
    return _GRID + f" SELECT file, time_ns, {cols} FROM j GROUP BY 1, 2"


@query(_wide_sql(f"round({_LINE}, 6)"))
def wide_linear(spark, d):
    w = rs.resample_wide(with_duration(samples(spark, d)), CHANNELS, rate=2)
    return w.select("file", "time_ns", *[rounded(c) for c in CHANNELS])


@query(_wide_sql("coalesce(a, f)"))
def wide_previous(spark, d):
    return rs.resample_wide(with_duration(samples(spark, d)), CHANNELS, rate=2, interpolate="previous")


@query(_wide_sql("coalesce(a, f)"))
def wide_step_types(spark, d):
    return rs.resample_wide(with_duration(samples(spark, d), "int32"), CHANNELS, rate=2)


@query("> q AS (SELECT 1) SELECT file, time_ns, " + ", ".join(f"max(value) FILTER (channel = '{c}') AS \"{c}\"" for c in CHANNELS) + " FROM smp GROUP BY 1, 2")
def wide_pivot(spark, d):
    return rs.wide(samples(spark, d), CHANNELS)


@query("""
> dl AS (SELECT file, channel, sample_index, time_ns, time_ns - lag(time_ns) OVER (PARTITION BY file, channel ORDER BY time_ns) AS delta FROM smp),
c AS (SELECT file, channel, delta, count(*) AS n FROM dl WHERE delta > 0 GROUP BY 1, 2, 3),
p AS (SELECT file, channel, delta AS period FROM (SELECT *, row_number() OVER (PARTITION BY file, channel ORDER BY n DESC, delta) AS r FROM c) WHERE r = 1),
k AS (SELECT dl.*, period, sum(CASE WHEN delta > 2 * period THEN 1 ELSE 0 END) OVER (PARTITION BY dl.file, dl.channel ORDER BY sample_index) AS chunk FROM dl LEFT JOIN p USING (file, channel))
SELECT file, channel, CAST(chunk AS BIGINT) AS chunk_index, min(period) AS sample_period_ns, min(sample_index) AS sample_base, count(*) AS sample_count, min(time_ns) AS time_base_ns FROM k GROUP BY 1, 2, 3""")
def modal_period_chunks(spark, d):
    return rs.modal_chunks(samples(spark, d)).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@query("""
> k AS (SELECT file, channel, 60000000000 AS cut FROM smp GROUP BY 1, 2),
c AS (SELECT s.file, s.channel, CASE WHEN s.time_ns >= cut THEN 1 ELSE 0 END AS chunk, min(sample_index) AS base, count(*) AS n, min(time_ns) AS t0 FROM smp s JOIN k USING (file, channel) GROUP BY 1, 2, 3),
x AS (SELECT s.*, c.t0 + c.n * 1000000000 AS extent, c.base + c.n - 1 AS last_index FROM smp s JOIN c ON s.file = c.file AND s.channel = c.channel AND s.sample_index BETWEEN c.base AND c.base + c.n - 1),
nx AS (SELECT *, lead(time_ns) OVER w AS nt, lead(value) OVER w AS nv FROM x WINDOW w AS (PARTITION BY file, channel ORDER BY sample_index)),
dur AS (SELECT file, channel, max(time_ns) + 1000000000 AS duration FROM smp GROUP BY 1, 2),
grid AS (SELECT file, channel, unnest(generate_series(0, (duration + 999999999) // 1000000000 - 1)) * 1000000000 AS time_ns FROM dur),
j AS (SELECT g.file, g.channel, g.time_ns, nx.value AS a, nx.nv AS b, nx.nt, CASE WHEN nx.sample_index = nx.last_index THEN nx.extent END AS extent, f.value AS f
      FROM grid g ASOF LEFT JOIN nx ON g.file = nx.file AND g.channel = nx.channel AND g.time_ns >= nx.time_ns
      JOIN smp f ON f.file = g.file AND f.channel = g.channel AND f.sample_index = 0)
SELECT file, channel, time_ns, CASE WHEN a IS NULL THEN f WHEN extent IS NOT NULL AND time_ns >= extent AND nt IS NOT NULL THEN b ELSE a END AS value FROM j""")
def chunked_gap(spark, d):
    s = samples(spark, d)
    chunk = F.when(F.col("time_ns") >= 60 * SECOND, 1).otherwise(0)
    chunks = s.groupBy("file", "channel", chunk.alias("k")).agg(F.min("sample_index").alias("sample_base"), F.count(F.lit(1)).alias("sample_count"), F.min("time_ns").alias("time_base_ns")).withColumn("sample_period_ns", F.lit(SECOND))
    return rs.resample(rs.chunk_extents(with_duration(s), chunks), rate=1, interpolate="previous").drop("tick")


@query("> q AS (SELECT 1) SELECT file, channel, unit, sample_index, time_ns, value FROM smp WHERE lower(channel) IN ('view', 'click')")
def channel_filter(spark, d):
    return rs.pick_channels(samples(spark, d), " View ,CLICK,")


@query("> q AS (SELECT 1) SELECT file, channel, unit, sample_index, time_ns, value FROM smp WHERE time_ns >= 100000000000 AND time_ns < 300000000000")
def time_range(spark, d):
    return rs.time_range(samples(spark, d), 100 * SECOND, 300 * SECOND)


MAP = "view -> Speed [m/s] * 0.5 + 1   # half\nclick -> Engine\npurchase -> Pressure [kPa] * 100"


@query("""
> q AS (SELECT 1) SELECT file, CASE channel WHEN 'view' THEN 'Speed' WHEN 'click' THEN 'Engine' WHEN 'purchase' THEN 'Pressure' ELSE channel END AS channel,
CASE channel WHEN 'view' THEN 'm/s' WHEN 'purchase' THEN 'kPa' ELSE unit END AS unit, sample_index, time_ns,
CASE channel WHEN 'view' THEN value * 0.5 + 1 WHEN 'purchase' THEN value * 100 ELSE value END AS value FROM smp""")
def channel_map(spark, d):
    rules = channelmap.parse_map(MAP)
    channelmap.validate_map(rules, CHANNELS)
    return channelmap.apply_map(samples(spark, d), rules)


@query("""
> a AS (SELECT file, sample_index, time_ns, value FROM smp WHERE channel = 'view'), b AS (SELECT file, sample_index, 2 * value AS value FROM smp WHERE channel = 'view')
SELECT a.file, 'twice' AS channel, a.sample_index, a.time_ns, 'km/h' AS unit, a.value + b.value AS value FROM a JOIN b USING (file, sample_index)""")
def sum_channels(spark, d):
    s = samples(spark, d).where("channel = 'view'")
    both = s.unionByName(s.withColumns({"channel": F.lit("other"), "value": 2 * F.col("value")}))
    return rs.sum_channels(both, ["view", "other"], "twice")


@query("""
> v AS (SELECT file, channel, time_ns, CAST(round(value / 50) AS BIGINT) AS v FROM smp WHERE channel = 'view'),
f AS (SELECT *, CASE WHEN v IS DISTINCT FROM lag(v) OVER (PARTITION BY file ORDER BY time_ns) OR lag(time_ns) OVER (PARTITION BY file ORDER BY time_ns) IS NULL THEN 1 ELSE 0 END AS fresh FROM v),
s AS (SELECT * FROM f WHERE fresh = 1), e AS (SELECT file, max(time_ns) + 1000000000 AS d FROM v GROUP BY 1)
SELECT s.file, row_number() OVER w - 1 AS run, v AS value, time_ns AS start_ns, coalesce(lead(time_ns) OVER w, d) AS end_ns FROM s JOIN e USING (file) WINDOW w AS (PARTITION BY s.file ORDER BY time_ns)""")
def integer_runs(spark, d):
    return ev.integer_runs(_lap_like(spark, d))


def _lap_like(spark, d) -> DataFrame:
    s = with_duration(samples(spark, d).where("channel = 'view'"))
    return s.withColumn("value", F.col("value") / 50)


_RUNS = """
> v AS (SELECT file, time_ns, CAST(round(value / 50) AS BIGINT) AS v FROM smp WHERE channel = 'view'),
f AS (SELECT *, CASE WHEN v IS DISTINCT FROM lag(v) OVER (PARTITION BY file ORDER BY time_ns) OR lag(time_ns) OVER (PARTITION BY file ORDER BY time_ns) IS NULL THEN 1 ELSE 0 END AS fresh FROM v),
e AS (SELECT file, max(time_ns) + 1000000000 AS d FROM v GROUP BY 1),
runs AS (SELECT f.file, row_number() OVER w - 1 AS run, v AS value, time_ns AS start_ns, coalesce(lead(time_ns) OVER w, d) AS end_ns, count(*) OVER (PARTITION BY f.file) AS n
  FROM f JOIN e USING (file) WHERE fresh = 1 WINDOW w AS (PARTITION BY f.file ORDER BY time_ns)),
laps AS (SELECT file, value AS number, start_ns, end_ns, end_ns - start_ns AS duration_ns, run > 0 AND run < n - 1 AS complete FROM runs WHERE value > 0),
stints AS (SELECT file, value AS driver_id, start_ns, end_ns FROM runs WHERE (n = 1 OR end_ns - start_ns >= 1000000000) AND value >= 0)"""


@query(_RUNS + " SELECT * FROM laps")
def laps_counter(spark, d):
    return ev.laps_from_counter(_lap_like(spark, d))


@query(_RUNS + " SELECT * FROM stints")
def driver_stints(spark, d):
    return ev.driver_stints(_lap_like(spark, d))


@query(_RUNS + " SELECT file, number, duration_ns FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY duration_ns, start_ns, number) AS r FROM laps WHERE complete AND duration_ns >= 10000000000) WHERE r = 1")
def fastest_lap(spark, d):
    return ev.fastest_lap(ev.laps_from_counter(_lap_like(spark, d)))


_REPORTED = """,
rf AS (SELECT file, arg_min(value, time_ns) FILTER (value > 0) AS v, max(value) AS m FROM smp WHERE channel = 'click' GROUP BY 1),
ref AS (SELECT file, CAST(round(v * CASE WHEN m > 1000 THEN 1e6 ELSE 1e9 END) AS BIGINT) AS r FROM rf WHERE v > 0),
inf AS (SELECT file, arg_min(number, (duration_ns, start_ns, number)) AS number, min(duration_ns) AS d FROM laps LEFT JOIN ref USING (file)
  WHERE complete AND duration_ns >= 10000000000 AND (r IS NULL OR duration_ns BETWEEN r // 2 AND r * 3 // 2) GROUP BY 1),
nb AS (SELECT p.file, p.time_ns, p.value, CAST(round(c.value / 50) AS BIGINT) AS number FROM (SELECT * FROM smp WHERE channel = 'purchase') p ASOF LEFT JOIN (SELECT * FROM smp WHERE channel = 'view') c ON p.file = c.file AND p.time_ns >= c.time_ns),
rp AS (SELECT nb.*, CAST(round(value * CASE WHEN max(value) OVER (PARTITION BY file) > 1000 THEN 1e6 ELSE 1e9 END) AS BIGINT) AS d FROM nb),
rep AS (SELECT file, arg_min({'n': number}, (d, time_ns)).n AS number, min(d) AS d FROM rp LEFT JOIN ref USING (file) WHERE value > 0 AND d >= 10000000000 AND (r IS NULL OR d BETWEEN r // 2 AND r * 3 // 2) GROUP BY 1)
SELECT file, CASE WHEN rep.d IS NOT NULL THEN coalesce(rep.number - 1, 0) ELSE inf.number END AS number, coalesce(rep.d, inf.d) AS duration_ns FROM inf FULL JOIN rep USING (file)"""


@query(_RUNS + _REPORTED)
def fastest_reported(spark, d):
    s = samples(spark, d)
    laps = ev.laps_from_counter(_lap_like(spark, d))
    reported = ev.lap_at(s.where("channel = 'purchase'").select("file", "time_ns", "value"), s.where("channel = 'view'").withColumn("value", F.col("value") / 50)).withColumnRenamed("lap", "number")
    return ev.fastest_lap(laps, ev.reference_lap(s.where("channel = 'click'")), reported)


@query(_RUNS + " SELECT file, count(*) AS lap_count, coalesce(arg_min(number, (duration_ns, start_ns, number)) FILTER (complete AND duration_ns > 5000000000), arg_min(number, (start_ns, number))) AS best_number, coalesce(min(duration_ns) FILTER (complete AND duration_ns > 5000000000), arg_min(duration_ns, (start_ns, number))) AS best_ns FROM laps GROUP BY 1")
def best_laps(spark, d):
    return ev.laps_report(ev.laps_from_counter(_lap_like(spark, d)))


def _merged(source: str, key: str, label: str, gap: int, out: str) -> str:
    """CTEs that join neighbouring intervals of one label, as ``merge_intervals`` does, into ``out``."""
    return f"""
{out}1 AS (SELECT *, CASE WHEN {label} IS DISTINCT FROM lag({label}) OVER w OR lag(start_ns) OVER w IS NULL THEN 1 ELSE 0 END AS other FROM (SELECT DISTINCT {key}, {label}, start_ns, end_ns FROM {source}) WINDOW w AS (PARTITION BY {key} ORDER BY start_ns, end_ns, {label})),
{out}2 AS (SELECT *, sum(other) OVER (PARTITION BY {key} ORDER BY start_ns, end_ns, {label} ROWS UNBOUNDED PRECEDING) AS island FROM {out}1),
{out}3 AS (SELECT *, max(end_ns) OVER (PARTITION BY {key}, island ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM {out}2),
{out}4 AS (SELECT *, sum(CASE WHEN upto IS NULL OR start_ns - upto > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {key}, island ORDER BY start_ns, end_ns ROWS UNBOUNDED PRECEDING) AS part FROM {out}3),
{out} AS (SELECT {key}, min({label}) AS {label}, min(start_ns) AS start_ns, max(end_ns) AS end_ns FROM {out}4 GROUP BY {key}, island, part)"""


@query(_RUNS + "," + _merged("stints", "file", "driver_id", 30 * SECOND, "mg") + " SELECT * FROM mg")
def merge_stints(spark, d):
    return ev.merge_intervals(ev.driver_stints(_lap_like(spark, d)), ["file"], "driver_id", 30 * SECOND)


@query("""
> o AS (SELECT file, channel, time_ns, CAST(value AS BIGINT) // 25 AS v FROM smp)
SELECT file, channel, time_ns, b AS before, v AS after FROM (SELECT *, lag(v) OVER (PARTITION BY file, channel ORDER BY time_ns) AS b FROM o) WHERE b IS DISTINCT FROM v""")
def transitions(spark, d):
    # Rounded to whole numbers as the SQL cast does.
    s = samples(spark, d).withColumn("value", F.expr("cast(rint(value) as bigint) div 25"))
    return ev.transitions(s)


_TIMER = "> tm AS (SELECT file, time_ns, value, lag(value) OVER (PARTITION BY file ORDER BY time_ns) AS b, max(value) OVER (PARTITION BY file) AS m FROM smp WHERE channel = 'click'), rst AS (SELECT file, time_ns FROM tm WHERE b - value > CASE WHEN m > 1000 THEN 5000 ELSE 5 END)"


@query(_TIMER + " SELECT * FROM rst")
def timer_resets(spark, d):
    return ev.timer_resets(samples(spark, d).where("channel = 'click'"))


@query(_TIMER + """, two AS (SELECT file FROM rst GROUP BY 1 HAVING count(*) >= 2), du AS (SELECT file, max(time_ns) + 1000000000 AS d FROM smp WHERE channel = 'click' GROUP BY 1),
b AS (SELECT file, time_ns FROM rst UNION ALL SELECT file, 0 FROM du),
l AS (SELECT b.file, row_number() OVER w AS p, time_ns AS s, lead(time_ns) OVER w AS u, d FROM b JOIN two USING (file) JOIN du USING (file) WINDOW w AS (PARTITION BY b.file ORDER BY time_ns))
SELECT file, p AS number, s AS start_ns, coalesce(u, d) AS end_ns, coalesce(u, d) - s AS duration_ns, p > 1 AND u IS NOT NULL AS complete FROM l""")
def laps_timer(spark, d):
    return ev.laps_from_timer(with_duration(samples(spark, d).where("channel = 'click'")))


@query("""
> v AS (SELECT file, CAST(round(value / 100) AS BIGINT) AS number, min(time_ns) AS start_ns FROM smp WHERE channel = 'view' GROUP BY 1, 2)
SELECT file, number, start_ns FROM (SELECT *, count(*) OVER (PARTITION BY file) AS n FROM v WHERE number >= 0 AND number < 100000) WHERE n > 1""")
def laps_web(spark, d):
    return ev.laps_by_value(samples(spark, d).where("channel = 'view'").withColumn("value", F.col("value") / 100))


def _pulses(spark, d) -> DataFrame:
    return samples(spark, d).where("channel = 'view'").withColumn("value", F.when(F.col("value") > 60, 1.0).otherwise(0.0))


def _greedy(source: str, least: int, out: str) -> str:
    """CTE ``out`` (file, time_ns): each event of ``source`` at least ``least`` ns after the last one kept."""
    return f"""{out}l AS (SELECT file, list(DISTINCT time_ns ORDER BY time_ns) AS t FROM {source} GROUP BY 1),
{out} AS (SELECT file, unnest(list_reduce(list_prepend([CAST(NULL AS BIGINT)], list_transform(t, lambda x: [x])), lambda a, x: CASE WHEN a[-1] IS NULL THEN x WHEN x[1] - a[-1] >= {least} THEN list_concat(a, x) ELSE a END)) AS time_ns FROM {out}l)"""


_BEACONS = """
> p AS (SELECT file, time_ns, CASE WHEN value > 60 THEN 1 ELSE 0 END AS v FROM smp WHERE channel = 'view'),
e AS (SELECT file, time_ns FROM (SELECT *, lag(v) OVER (PARTITION BY file ORDER BY time_ns) AS b FROM p) WHERE v > 0 AND b <= 0 AND time_ns > 0),
""" + _greedy("e", 5 * SECOND, "mk")


@query(_BEACONS + " SELECT file, time_ns FROM mk")
def beacons(spark, d):
    return ev.beacons(_pulses(spark, d))


@query(_BEACONS + """, d AS (SELECT file, row_number() OVER w AS i, lead(time_ns) OVER w - time_ns AS d FROM mk WINDOW w AS (PARTITION BY file ORDER BY time_ns)),
y AS (SELECT file, count(*) + 1 AS total_laps, arg_min(i, (d, i)) FILTER (d IS NOT NULL) + 1 AS fastest_lap, CAST(round(min(d) / 1e6) AS BIGINT) AS ms FROM d GROUP BY 1)
SELECT file, total_laps, fastest_lap, printf('%d:%02d.%03d', ms // 60000, ms // 1000 % 60, ms % 1000) AS fastest_time FROM y""")
def beacon_summary(spark, d):
    return ev.lap_summary(ev.beacons(_pulses(spark, d)))


def _track(spark, d) -> DataFrame:
    s = samples(spark, d).where("channel = 'view'")
    return s.select("file", "time_ns", (F.col("value") / 100).alias("latitude"), (F.pmod(F.col("sample_index") * 37, F.lit(101)) / 50 - 1).alias("longitude"))


@query("""
> tr AS (SELECT file, time_ns, value / 100 AS y1, (sample_index * 37) % 101 / 50.0 - 1 AS x1 FROM smp WHERE channel = 'view'),
b AS (SELECT *, lag(y1) OVER w AS y0, lag(x1) OVER w AS x0 FROM tr WINDOW w AS (PARTITION BY file ORDER BY time_ns)),
e AS (SELECT file, time_ns FROM b WHERE y0 IS NOT NULL AND (x0 <> x1 OR y0 <> y1)
  AND (0.0 * (y0 - 0.0) - (5.0 - 0.0) * (x0 - 0.0)) * (0.0 * (y1 - 0.0) - (5.0 - 0.0) * (x1 - 0.0)) <= 0
  AND ((x1 - x0) * (0.0 - y0) - (y1 - y0) * (0.0 - x0)) * ((x1 - x0) * (5.0 - y0) - (y1 - y0) * (0.0 - x0)) <= 0),
""" + _greedy("e", 10 * SECOND, "mk") + " SELECT file, time_ns FROM mk")
def gate_crossings(spark, d):
    return ev.gate_crossings(_track(spark, d), (0.0, 0.0, 5.0, 0.0))


@query("""
> tr AS (SELECT file, time_ns, value / 100 AS la, (sample_index * 37) % 101 / 50.0 - 1 AS lo FROM smp WHERE channel = 'view'), ok AS (SELECT * FROM tr WHERE abs(la) <= 90 AND abs(lo) <= 180 AND NOT (la = 0 AND lo = 0)), m AS (SELECT file, avg(la) AS a, avg(lo) AS o FROM ok GROUP BY 1)
SELECT ok.file, time_ns, round(radians(lo - o) * cos(radians(a)) * 6371000.0, 3) AS x_m, round(radians(la - a) * 6371000.0, 3) AS y_m FROM ok JOIN m USING (file)""")
def gps_projection(spark, d):
    return ev.project_track(_track(spark, d)).withColumns({"x_m": F.round("x_m", 3), "y_m": F.round("y_m", 3)})


@query("""
> la AS (SELECT file, time_ns, value / 10 - 10 AS latitude FROM smp WHERE channel = 'view'), lo AS (SELECT file, time_ns, value / 5 - 20 AS longitude FROM smp WHERE channel = 'click'),
tr AS (SELECT la.file, la.time_ns, latitude, longitude FROM la ASOF JOIN lo ON la.file = lo.file AND la.time_ns >= lo.time_ns)
SELECT file, time_ns, latitude, longitude FROM tr WHERE abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT (latitude = 0 AND longitude = 0)""")
def gps_track(spark, d):
    from tracegrid.operators.roles import gps_track as track

    s = samples(spark, d).where("channel in ('view', 'click')")
    lat = F.col("channel") == "view"
    s = s.select("file", F.when(lat, F.lit("GPS Latitude")).otherwise("GPS Longitude").alias("name"), F.when(lat, 1).otherwise(2).alias("channel_id"), "time_ns", F.when(lat, F.col("value") / 10 - 10).otherwise(F.col("value") / 5 - 20).alias("value"))
    return track(s.drop("name"), s.groupBy("file", "channel_id", "name").agg(F.count(F.lit(1)).alias("sample_count")))


@query(_GRID + f""", w AS (SELECT file, time_ns, {", ".join(f"max(CASE WHEN channel = '{c}' THEN {_LINE} END) AS {c}" for c in CHANNELS)} FROM j GROUP BY 1, 2)
SELECT file, round(avg(click) FILTER (view > 50), 6) AS mean_at_speed, round(max(click), 6) AS peak, round(avg(purchase) FILTER (abs(signup) > 1.5), 6) AS loaded FROM w GROUP BY 1""")
def conditional_means(spark, d):
    """Means of one channel while another is beyond a bound, on the shared timeline."""
    w = rs.resample_wide(with_duration(samples(spark, d)), CHANNELS, rate=2)
    return w.groupBy("file").agg(
        F.round(F.avg(F.when(F.col("view") > 50, F.col("click"))), 6).alias("mean_at_speed"), F.round(F.max("click"), 6).alias("peak"), F.round(F.avg(F.when(F.abs("signup") > 1.5, F.col("purchase"))), 6).alias("loaded")
    )


@query(_RUNS + """ SELECT l.file, l.number, s.channel, count(*) AS n, min(s.value) AS low, max(s.value) AS high, round(avg(s.value), 6) AS mean
FROM smp s JOIN laps l ON s.file = l.file AND s.time_ns >= l.start_ns AND s.time_ns < l.end_ns GROUP BY 1, 2, 3""")
def lap_stats(spark, d):
    j = ev.samples_in_laps(samples(spark, d), ev.laps_from_counter(_lap_like(spark, d)))
    return j.groupBy("file", "number", "channel").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"))


@query(_RUNS + """ SELECT s.file, l.number, s.channel, s.sample_index, round((s.time_ns - l.start_ns) / (l.end_ns - l.start_ns), 6) AS progress, s.time_ns - l.start_ns AS elapsed_ns
FROM smp s JOIN laps l ON s.file = l.file AND s.time_ns >= l.start_ns AND s.time_ns < l.end_ns""")
def lap_progress(spark, d):
    return ev.lap_progress(samples(spark, d), ev.laps_from_counter(_lap_like(spark, d))).withColumn("progress", F.round("progress", 6))


_PROGRESS = _RUNS + """,
dl AS (SELECT s.file, l.number, l.start_ns, s.time_ns, s.value FROM smp s JOIN laps l ON s.channel = 'purchase' AND l.file = s.file AND s.time_ns >= l.start_ns AND s.time_ns < l.end_ns),
sp AS (SELECT file, number, start_ns, min(value) AS lo, max(value) AS hi, count(*) AS n FROM dl GROUP BY 1, 2, 3),
pl AS (SELECT dl.*, lo, hi, n, row_number() OVER (PARTITION BY dl.file, dl.number, dl.start_ns ORDER BY time_ns) AS i FROM dl JOIN sp USING (file, number, start_ns)),
pg AS (SELECT file, number, start_ns, time_ns, CASE WHEN value IS NOT NULL AND hi > lo THEN greatest(0.0, least(1.0, (value - lo) / (hi - lo))) ELSE (i - 1) / greatest(n - 1, 1) END AS progress FROM pl)"""


@query(_PROGRESS + " SELECT file, number, start_ns, time_ns, round(progress, 9) AS progress FROM pg")
def distance_progress(spark, d):
    return _distance(spark, d).withColumn("progress", F.round("progress", 9))


def _distance(spark, d) -> DataFrame:
    return ev.distance_progress(samples(spark, d).where("channel = 'purchase'"), ev.laps_from_counter(_lap_like(spark, d)))


@query(_PROGRESS + """,
rf AS (SELECT file, arg_min(number, (duration_ns, start_ns)) AS number, arg_min(start_ns, (duration_ns, start_ns)) AS start_ns FROM laps WHERE duration_ns >= 60000000000 GROUP BY 1),
rp AS (SELECT file, progress, min(time_ns) AS o, min(time_ns - pg.start_ns) AS e FROM pg SEMI JOIN rf ON pg.file = rf.file AND pg.number = rf.number AND pg.start_ns = rf.start_ns GROUP BY 1, 2),
bf AS (SELECT pg.*, rp.progress AS p, rp.o AS po, rp.e AS pe FROM pg ASOF LEFT JOIN rp ON pg.file = rp.file AND pg.progress >= rp.progress),
af AS (SELECT pg.file, pg.number, pg.start_ns, pg.time_ns, rp.progress AS q, rp.o AS qo, rp.e AS qe FROM pg ASOF LEFT JOIN rp ON pg.file = rp.file AND pg.progress <= rp.progress)
SELECT file, number, start_ns, time_ns, round(progress, 9) AS progress, time_ns - start_ns - CASE WHEN q IS NULL OR progress - p < q - progress OR (progress - p = q - progress AND po <= qo) THEN pe ELSE qe END AS delta_ns
FROM bf JOIN af USING (file, number, start_ns, time_ns) WHERE p IS NOT NULL OR q IS NOT NULL""")
def lap_deltas(spark, d):
    """Every point of every lap against the file's shortest lap of a minute or more, at equal progress."""
    laps = ev.laps_from_counter(_lap_like(spark, d))
    best = laps.where(F.col("duration_ns") >= 60 * SECOND).groupBy("file").agg(F.min(F.struct("duration_ns", "start_ns", "number")).alias("b")).select("file", "b.number", "b.start_ns")
    return ev.lap_deltas(_distance(spark, d), best).withColumn("progress", F.round("progress", 9))


@query("""
> l AS (SELECT file, sample_index, time_ns FROM smp WHERE channel = 'click'), r AS (SELECT file, time_ns, value FROM smp WHERE channel = 'view'),
p AS (SELECT l.*, r.time_ns AS pt, r.value AS pv FROM l ASOF LEFT JOIN r ON l.file = r.file AND l.time_ns >= r.time_ns),
n AS (SELECT l.file, l.sample_index, r.time_ns AS nt, r.value AS nv FROM l ASOF LEFT JOIN r ON l.file = r.file AND l.time_ns <= r.time_ns)
SELECT p.file, p.time_ns, p.sample_index, CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL OR p.time_ns - pt <= nt - p.time_ns THEN pv ELSE nv END AS view
FROM p JOIN n USING (file, sample_index)""")
def nearest_rows(spark, d):
    s = samples(spark, d)
    return ev.nearest(s.where("channel = 'click'").select("file", "time_ns", "sample_index"), s.where("channel = 'view'").select("file", "time_ns", "value"), ["file"], "time_ns", "value", "view")


@query("> o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY time_ns) AS i, count(*) OVER (PARTITION BY file) AS n FROM smp) SELECT file, channel, unit, sample_index, time_ns, value FROM o WHERE (i - 1) % greatest(1, CAST(ceil(n / 20.0) AS BIGINT)) = 0")
def downsample(spark, d):
    return ev.downsample(samples(spark, d), ["file"], 20)


@query("> o AS (SELECT file, time_ns, row_number() OVER (PARTITION BY file ORDER BY time_ns) - 1 AS i FROM smp WHERE channel = 'view'), t AS (SELECT file, time_ns FROM smp WHERE channel = 'click') SELECT t.file, t.time_ns, coalesce(o.i, 0) AS frame_index FROM t ASOF LEFT JOIN o ON t.file = o.file AND t.time_ns >= o.time_ns")
def video_frames(spark, d):
    s = samples(spark, d)
    frames = s.where("channel = 'view'").select("file", "time_ns", F.col("sample_index").alias("frame_index"))
    return rs.frame_at(s.where("channel = 'click'"), frames)


@query(">> q AS (SELECT 1) SELECT file, session_key, absolute_start_ns, absolute_end_ns, session FROM g")
def session_groups(spark, d):
    return se.group_sessions(day_files(spark, d), DAY_GAP)


def _day_runs(name: str, width: int) -> str:
    """CTE ``name``: runs of the rounded value over ``width``, over all events of a file."""
    return f"""
{name}1 AS (SELECT file, time_ns, CAST(round(value / {width}) AS BIGINT) AS v FROM smp),
{name}2 AS (SELECT *, CASE WHEN v IS DISTINCT FROM lag(v) OVER w OR lag(time_ns) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM {name}1 WINDOW w AS (PARTITION BY file ORDER BY time_ns)),
{name} AS (SELECT r.file, v, time_ns AS start_ns, coalesce(lead(time_ns) OVER w, absolute_end_ns - absolute_start_ns) AS end_ns, row_number() OVER w AS run, count(*) OVER (PARTITION BY r.file) AS n
  FROM {name}2 r JOIN fl USING (file) WHERE fresh = 1 WINDOW w AS (PARTITION BY r.file ORDER BY time_ns))"""


_SESSIONS = (
    ">>" + _day_runs("dr", 50) + "," + _day_runs("lr", 20) + """,
sti AS (SELECT session, v AS driver_id, absolute_start_ns + start_ns AS start_ns, absolute_start_ns + end_ns AS end_ns FROM dr JOIN g USING (file) WHERE (n = 1 OR end_ns - start_ns >= 1000000000) AND v >= 0),
lap AS (SELECT file, v AS number, start_ns, end_ns, run > 1 AND run < n AS complete FROM lr WHERE v > 0),
lpi AS (SELECT session, number, absolute_start_ns + start_ns AS start_ns, absolute_start_ns + end_ns AS end_ns FROM lap JOIN g USING (file)),"""
    + _merged("sti", "session", "driver_id", DAY_GAP * SECOND, "ms") + "," + _merged("lpi", "session", "number", DAY_GAP * SECOND, "ml") + """,
own AS (SELECT file, min((end_ns - start_ns, start_ns, number)) AS b, min(end_ns - start_ns) AS d, arg_min(number, (end_ns - start_ns, start_ns, number)) AS number FROM lap WHERE complete AND end_ns - start_ns >= 10000000000 GROUP BY 1),
so AS (SELECT session, min(d) AS d, arg_min(number, (d, file)) AS number FROM own JOIN g USING (file) GROUP BY 1),
tl AS (SELECT session, count(*) AS lap_count, min(d) FILTER (inner_lap) AS d, arg_min(number, (d, start_ns, number)) FILTER (inner_lap) AS number FROM (
  SELECT *, end_ns - start_ns AS d, lag(number) OVER w IS NOT NULL AND lead(number) OVER w IS NOT NULL AND end_ns - start_ns >= 10000000000 AS inner_lap FROM ml WINDOW w AS (PARTITION BY session ORDER BY start_ns)) GROUP BY 1),
ids AS (SELECT session, string_agg(CAST(driver_id AS VARCHAR), ',' ORDER BY driver_id) AS driver_ids FROM (SELECT DISTINCT session, driver_id FROM sti) GROUP BY 1),
ns AS (SELECT session, count(*) AS stint_count FROM ms GROUP BY 1),
bs AS (SELECT session, count(*) AS file_count, min(absolute_start_ns) AS absolute_start_ns, max(absolute_end_ns) AS absolute_end_ns FROM g GROUP BY 1)
SELECT session AS session_key, file_count, absolute_start_ns, absolute_end_ns, absolute_end_ns - absolute_start_ns AS duration_ns, coalesce(driver_ids, '') AS driver_ids, coalesce(stint_count, 0) AS stint_count,
  coalesce(lap_count, 0) AS lap_count, coalesce(so.number, tl.number) AS fastest_lap_number, coalesce(so.d, tl.d) AS fastest_lap_time_ns
FROM bs LEFT JOIN ids USING (session) LEFT JOIN ns USING (session) LEFT JOIN tl USING (session) LEFT JOIN so USING (session)"""
)


@query(_SESSIONS)
def session_metadata(spark, d):
    f, s = day_files(spark, d), day_samples(spark, d)
    s = s.join(f.select("file", (F.col("absolute_end_ns") - F.col("absolute_start_ns")).alias("duration_ns")), "file")
    stints = ev.driver_stints(s.withColumn("value", F.col("value") / 50))
    laps = ev.laps_from_counter(s.withColumn("value", F.col("value") / 20))
    return se.session_metadata(f, stints, laps.select("file", "number", "start_ns", "end_ns"), DAY_GAP, ev.fastest_lap(laps))


_STITCH = ", ".join(f"max(CASE WHEN channel = '{c}' THEN coalesce(a, f) END) AS \"{c}\"" for c in CHANNELS)


@query(_GRID.replace(">", ">>", 1) + f""", w AS (SELECT file, time_ns, {_STITCH} FROM j GROUP BY 1, 2), st AS (SELECT session, min(absolute_start_ns) AS s0 FROM g GROUP BY 1)
SELECT g.session AS session_key, w.time_ns + g.absolute_start_ns - s0 AS time_ns, w.time_ns AS file_time_ns, g.file AS source_file, {", ".join(f'"{c}"' for c in CHANNELS)} FROM w JOIN g USING (file) JOIN st USING (session)""")
def session_stitch(spark, d):
    w = rs.resample_wide(with_duration(day_samples(spark, d)), CHANNELS, rate=2, interpolate="previous")
    return se.stitch(w, day_files(spark, d), DAY_GAP, every=True)


@query("> q AS (SELECT 1) SELECT file, max(time_ns) + 1000000000 AS duration_ns, count(DISTINCT channel) AS channel_count, count(DISTINCT channel) AS sampled_channel_count, count(*) AS sample_count FROM smp GROUP BY 1")
def file_summary(spark, d):
    s = samples(spark, d)
    c = s.groupBy("file", F.col("channel").alias("name")).agg((F.max("time_ns") + SECOND).alias("duration_ns"), F.count(F.lit(1)).alias("sample_count"), F.first("unit").alias("unit"))
    c = c.withColumns({"channel_id": F.row_number().over(Window.partitionBy("file").orderBy("name")), "type_code": F.lit(7)})
    return se.file_summary(c).drop("schema_hash")


@query("""
WITH c AS (SELECT DISTINCT file, channel_id, name, unit, type_code FROM channels),
x AS (SELECT file, string_agg(hex(encode(translate(coalesce(name, '') || coalesce(unit, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) || printf('%02X', coalesce(type_code, 0)), '' ORDER BY channel_id) AS t FROM c GROUP BY 1),
b AS (SELECT file, list_transform(generate_series(1, length(t) // 2), lambda i: CAST(('0x' || substr(t, 2 * i - 1, 2)) AS UHUGEINT)) AS b FROM x)
SELECT file, lpad(lower(hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), b), lambda h, x: (xor(h, x) * CAST(1099511628211 AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT)) AS UBIGINT))), 16, '0') AS schema_hash FROM b""")
def schema_hashes(spark, d):
    from tracegrid.sources.tables import table

    return se.schema_hash(table(spark, d, "channels").dropDuplicates(["file", "channel_id"])).select("file", se.hash_hex(F.col("schema_hash")).alias("schema_hash"))


@query("""
> wk AS (SELECT file, 2000 + floor(arg_min(value, time_ns)) AS w FROM smp WHERE channel = 'view' GROUP BY 1), it AS (SELECT file, arg_min(value, time_ns) * 1000 AS i, min(time_ns) AS t FROM smp WHERE channel = 'click' GROUP BY 1)
SELECT file, (CAST(round(w) AS BIGINT) * 604800000 + CAST(round(i) AS BIGINT)) * 1000000 - t AS absolute_start_ns, CAST(round(w) AS BIGINT) AS gps_week FROM wk JOIN it USING (file)""")
def gps_clock(spark, d):
    s = samples(spark, d)
    return se.gps_clock(s.where("channel = 'view'").withColumn("value", 2000 + F.floor("value").cast("double")), s.where("channel = 'click'").withColumn("value", F.col("value") * 1000))


@query("> q AS (SELECT 1) SELECT CAST(round(value / 10) AS BIGINT) AS driver_id, count(*) AS n FROM smp WHERE channel = 'view' GROUP BY 1")
def driver_histogram(spark, d):
    s = samples(spark, d).where("channel = 'view'")
    return s.groupBy(F.round(F.col("value") / 10).cast("bigint").alias("driver_id")).agg(F.count(F.lit(1)).alias("n"))


@query("""
> q AS (SELECT 1) SELECT file, channel, sample_index, round(CASE channel WHEN 'view' THEN value * (1 / 3.6) WHEN 'click' THEN value * (2 * pi() / 60) WHEN 'purchase' THEN value * 1e5 WHEN 'error' THEN value + 273.15 ELSE value END, 6) AS base_value FROM smp""")
def convert_units(spark, d):
    base = {u.unit: u.base_unit for u in units.UNITS}
    target = F.create_map(*[F.lit(x) for k, v in base.items() for x in (k, v)])[F.col("unit")]
    return samples(spark, d).select("file", "channel", "sample_index", F.round(units.convert_units(F.col("value"), F.col("unit"), target), 6).alias("base_value"))


@query("""
> u AS (SELECT DISTINCT unit FROM smp), d(unit, dim, conv) AS (VALUES ('km/h', 'speed', true), ('rpm', 'angular_velocity', true), ('bar', 'pressure', true), ('C', 'temperature', true), ('count', 'count', false))
SELECT a.unit AS source, b.unit AS target, a.dim = b.dim AND (a.unit = b.unit OR a.conv) AS possible FROM d a, d b WHERE a.unit IN (SELECT unit FROM u) AND b.unit IN (SELECT unit FROM u)""")
def can_convert(spark, d):
    u = samples(spark, d).select("unit").distinct()
    pairs = u.select(F.col("unit").alias("source"), F.explode(F.array(*[F.lit(x) for x in UNITS.values()])).alias("target"))
    return pairs.withColumn("possible", units.can_convert(F.col("source"), F.col("target")))


@query("> q AS (SELECT 1) SELECT file, sample_index, round(value / 3.6, 6) AS speed FROM smp WHERE channel = 'view'")
def convert_column(spark, d):
    s = units.tag_unit(samples(spark, d).where("channel = 'view'").select("file", "sample_index", F.col("value").alias("speed")), "speed", "km/h")
    return s.select("file", "sample_index", F.round(units.convert_column(s, "speed", "m/s"), 6).alias("speed"))


def _unit_values() -> str:
    """The registry as a CTE ``un``, one row per spelling."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({text(a)}, {text(u.unit)}, {a == u.unit}, {text(u.dimension)}, {text(u.base_unit)}, CAST({u.factor!r} AS DOUBLE), CAST({u.offset!r} AS DOUBLE), {u.convertible})" for u in units.UNITS for a in u.spellings)
    return f"WITH un(unit, canonical_unit, is_canonical, dimension, base_unit, to_base_factor, to_base_offset, is_convertible) AS (VALUES {rows})"


@query(_unit_values() + " SELECT * FROM un")
def units_table(spark, d):
    return units.units_table(spark)


@query(_unit_values() + """ SELECT a.dimension, a.unit AS source, b.unit AS target,
round(CASE WHEN a.unit = b.unit THEN 1.0 ELSE ((((a.to_base_factor + a.to_base_offset - b.to_base_offset) / b.to_base_factor) * b.to_base_factor + b.to_base_offset) - a.to_base_offset) / a.to_base_factor END, 9) AS round_trip
FROM un a JOIN un b ON a.dimension = b.dimension WHERE a.is_canonical AND b.is_canonical AND a.is_convertible AND b.is_convertible""")
def unit_pairs(spark, d):
    u = units.units_table(spark).where("is_canonical and is_convertible")
    return u.alias("a").join(u.alias("b"), "dimension").select("dimension", F.col("a.unit").alias("source"), F.col("b.unit").alias("target"), F.round(units.convert_units(units.convert_units(F.lit(1.0), F.col("a.unit"), F.col("b.unit")), F.col("b.unit"), F.col("a.unit")), 9).alias("round_trip"))


@query(_unit_values() + " SELECT a.unit AS source, b.unit AS target, false AS possible FROM un a JOIN un b ON a.dimension <> b.dimension WHERE a.is_canonical AND b.is_canonical")
def unit_cross_dimension(spark, d):
    u = units.units_table(spark).where("is_canonical").select("unit", "dimension")
    return u.alias("a").join(F.broadcast(u.alias("b")), F.col("a.dimension") != F.col("b.dimension")).select(F.col("a.unit").alias("source"), F.col("b.unit").alias("target"), units.can_convert(F.col("a.unit"), F.col("b.unit")).alias("possible"))


@query("""
WITH k AS (SELECT DISTINCT file, channel_id, name, unit, frequency_hz, sample_period_ns FROM channels WHERE name IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY file, channel_id, name, unit NULLS FIRST, frequency_hz NULLS FIRST) AS r FROM k),
p AS (SELECT name AS column_name, coalesce(unit, '') AS unit, 'unit=' || coalesce(unit, '') || coalesce('; native_frequency_hz=' || regexp_replace(CAST(frequency_hz AS VARCHAR), '\\.0$', '') || '; native_sample_period_ns=' || sample_period_ns, '') AS kv_metadata FROM f WHERE r = 1)
SELECT column_name, unit, 'COMMENT ON COLUMN "lap"."' || replace(column_name, '"', '""') || '" IS ''' || replace(kv_metadata, '''', '''''') || '''' AS ddl, kv_metadata,
  column_name || ' -> ' || column_name || CASE WHEN unit <> '' THEN ' [' || unit || ']' ELSE '' END AS channel_map_rule FROM p""")
def column_comments(spark, d):
    from tracegrid.sources.comments import column_comments as comments
    from tracegrid.sources.tables import table

    c = table(spark, d, "channels").select("file", "channel_id", "name", "unit", "frequency_hz", "sample_period_ns").where("name is not null")
    return comments(c, "lap")


@query("""
> a AS (SELECT file, sample_index, time_ns, value FROM smp WHERE channel = 'view')
SELECT file, 'Speed' AS channel, sample_index, time_ns, round(value / 3.6, 6) AS value FROM a
UNION ALL SELECT file, 'click', sample_index, time_ns, round(value, 6) FROM smp WHERE channel = 'click'""")
def export_projection(spark, d):
    from tracegrid.sources.export import project

    s = samples(spark, d).where("channel in ('view', 'click', 'error')")
    return project(s, mapping=[("view", "Speed", "m/s")], include_unmapped=True, exclude=["ERROR"]).select("file", "channel", "sample_index", "time_ns", F.round("value", 6).alias("value"))
