"""Runs, transitions, laps, driver stints, beacons and gate crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.model import finite, normalised, round_half_away
from tracegrid.operators.blocks import along, time_block

SECOND = 1_000_000_000
#: Normalised channel names by meaning.
DRIVER_NAMES = ("driverid", "driver", "driverindex")
LAP_NAMES = ("lapnumber", "lapnum", "lapcount", "lapcounter", "currentlap", "lap")
TIMER_NAMES = ("currentlaptime", "lapcurrentlaptime", "laptime", "laptimerunning")
REFERENCE_NAMES = ("reflaptime", "referencelaptime")
REPORTED_NAMES = ("previouslt", "previouslaptime", "lastlaptime")
PULSE_NAMES = ("lapbeacontrig", "laptrigger", "blaptrig", "fiabeacon")
COUNTER_NAMES = ("lapnumber", "beaconeventcount")
#: Lap times and lap distances whose falls are laps, in order of preference; the times come first.
RESET_NAMES = ("lapcurrentlaptime", "laptime", "laptimerunning", "lapdistancecorrected", "lapdistance", "lapdist", "lapdistpct")
RESET_TIMES = 3


def semantic_channel(channels: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(file, channel_id, name): the first sampled channel of each file whose normalised name is one of ``names``."""
    c = channels.where((F.col("sample_count") > 0) & normalised(F.col("name")).isin(*names))
    return c.groupBy("file").agg(F.min(F.struct("channel_id", "name")).alias("c")).select("file", "c.channel_id", "c.name")


def _runs(samples: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """``integer_runs`` plus ``more``: whether another run follows."""
    s = samples.where(finite(F.col("value"))).select(*keys, "time_ns", "duration_ns", round_half_away(F.col("value")).alias("v"))
    fresh = along(s, list(keys), ["time_ns"], time_block(), before=["v"]).where(~F.col("v").eqNullSafe(F.col("before.v"))).drop("before")
    r = along(fresh, list(keys), ["time_ns"], time_block(), after=["time_ns"], number="run")
    return r.select(*keys, (F.col("run") - 1).cast("bigint").alias("run"), F.col("v").alias("value"), F.col("time_ns").alias("start_ns"), F.coalesce("after.time_ns", F.greatest("duration_ns", "time_ns")).alias("end_ns"), F.col("after").isNotNull().alias("more"))


def integer_runs(samples: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """(keys, run, value, start_ns, end_ns): stretches of one rounded value; samples that are not finite do not count.

    A run ends where the next one starts, the last one at ``duration_ns`` (or its
    own start if that is later).
    """
    return _runs(samples, keys).drop("more")


def transitions(samples: DataFrame, keys: tuple[str, ...] = ("file", "channel")) -> DataFrame:
    """(keys, time_ns, before, after): where a discrete channel changes its value; the first sample counts."""
    s = along(samples.select(*keys, "time_ns", "value"), list(keys), ["time_ns"], time_block(), before=["value"])
    return s.select(*keys, "time_ns", F.col("before.value").alias("before"), F.col("value").alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))


def driver_stints(samples: DataFrame) -> DataFrame:
    """(file, driver_id, start_ns, end_ns): runs of a driver channel, without those below one second (unless alone) and negative ids."""
    alone = (F.col("run") == 0) & ~F.col("more")
    return _runs(samples).where((alone | (F.col("end_ns") - F.col("start_ns") >= SECOND)) & (F.col("value") >= 0)).select("file", F.col("value").alias("driver_id"), "start_ns", "end_ns")


def laps_from_counter(samples: DataFrame) -> DataFrame:
    """(file, number, start_ns, end_ns, duration_ns, complete): runs of a lap counter above 0; the first and last run are not complete."""
    r = _runs(samples).withColumn("complete", (F.col("run") > 0) & F.col("more"))
    return r.where("value > 0").select("file", F.col("value").alias("number"), "start_ns", "end_ns", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"), "complete")


def timer_resets(samples: DataFrame) -> DataFrame:
    """(file, time_ns): where a running lap time falls back by more than 5 s (5000 if the channel counts milliseconds)."""
    s = samples.where(finite(F.col("value"))).select("file", "time_ns", "value")
    fall = along(s, ["file"], ["time_ns"], time_block(), before=["value"]).where(F.col("before.value") - F.col("value") > 5.0)
    most = s.groupBy("file").agg(F.max("value").alias("most"))
    return fall.join(most, "file").where(F.col("before.value") - F.col("value") > F.when(F.col("most") > 1000, 5000.0).otherwise(5.0)).select("file", "time_ns")


def laps_from_timer(timer: DataFrame, counter: DataFrame | None = None) -> DataFrame:
    """(file, number, start_ns, end_ns, duration_ns, complete) between the resets of a running lap time.

    Needs two resets.  Boundaries are 0, the resets and the duration; only laps
    between two resets are complete.  ``counter`` (file, time_ns, value) numbers a
    lap by its value at the start, else its position counts; numbers below 1 go.
    """
    resets = timer_resets(timer)
    two = resets.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("file")
    ends = timer.groupBy("file").agg(F.max("duration_ns").alias("duration_ns"))
    bounds = resets.unionByName(ends.select("file", F.lit(0).cast("bigint").alias("time_ns"))).join(two, "file", "left_semi").join(ends, "file")
    order = Window.partitionBy("file").orderBy("time_ns")
    laps = bounds.select("file", F.row_number().over(order).cast("bigint").alias("position"), F.col("time_ns").alias("start_ns"), F.lead("time_ns").over(order).alias("until"), "duration_ns")
    laps = laps.select("file", "position", "start_ns", F.coalesce("until", "duration_ns").alias("end_ns"), ((F.col("position") > 1) & F.col("until").isNotNull()).alias("complete"))
    if counter is None:
        laps = laps.withColumn("number", F.col("position"))
    else:
        laps = lap_at(laps.withColumnRenamed("start_ns", "time_ns"), counter).withColumn("number", F.coalesce("lap", "position")).withColumnRenamed("time_ns", "start_ns")
    return laps.where("number > 0").select("file", "number", "start_ns", "end_ns", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"), "complete")


def lap_at(times: DataFrame, counter: DataFrame) -> DataFrame:
    """``times`` (file, time_ns, ...) plus ``lap``: the rounded value of a lap counter (file, time_ns, value) at each, NULL before its first sample."""
    rest = [c for c in times.columns if c not in ("file", "time_ns")]
    t = times.select("file", "time_ns", F.lit(1).alias("__k"), F.struct(F.lit(0).alias("__none"), *rest).alias("__row"), F.lit(None).cast("bigint").alias("__v"))
    c = counter.select("file", "time_ns", F.lit(0).alias("__k"), F.lit(None).cast(t.schema["__row"].dataType).alias("__row"), round_half_away(F.col("value")).alias("__v"))
    out = along(t.unionByName(c), ["file"], ["time_ns", "__k"], time_block(), latest={"lap": F.col("__v")}).where("__k = 1")
    return out.select("file", "time_ns", *[F.col(f"__row.`{x}`").alias(x) for x in rest], "lap")


def plausible(duration: Column, reference: Column) -> Column:
    """At least 10 s and, if there is a reference lap, between half and one and a half of it."""
    return (duration >= 10 * SECOND) & (reference.isNull() | duration.between(F.floor(reference / 2), F.floor(reference * 3 / 2)))


def _nanoseconds(value: Column, most: Column) -> Column:
    """A lap time in ns, from ms if the channel exceeds 1000 anywhere, else from s; rounded half up."""
    return F.round(value * F.when(most > 1000, 1e6).otherwise(1e9), 0).try_cast("bigint")


def reference_lap(samples: DataFrame) -> DataFrame:
    """(file, reference_ns): the first finite value above 0 of a reference channel, in ms if it exceeds 1000 anywhere, else s."""
    s = samples.where(finite(F.col("value")))
    g = s.groupBy("file").agg(F.max("value").alias("most"), F.min_by("value", F.when(F.col("value") > 0, F.col("time_ns"))).alias("v"))
    return g.where("v > 0").select("file", _nanoseconds(F.col("v"), F.col("most")).alias("reference_ns"))


def fastest_lap(laps: DataFrame, reference: DataFrame | None = None, reported: DataFrame | None = None) -> DataFrame:
    """(file, number, duration_ns): the shortest plausible complete lap; a reported lap time outranks it.

    ``reference``: (file, reference_ns), against which both kinds are plausible or
    not.  ``reported``: (file, time_ns, value, number) of a previous-lap channel,
    whose lap is the one before ``number``; 0 where no number is known.  The first
    of equal laps wins.
    """
    known = laps.select("file").distinct().limit(0).withColumn("reference_ns", F.lit(None).cast("bigint")) if reference is None else reference.select("file", "reference_ns")
    inferred = laps.where("complete").join(known, "file", "left").where(plausible(F.col("duration_ns"), F.col("reference_ns"))).groupBy("file").agg(F.min(F.struct("duration_ns", "start_ns", "number")).alias("m"))
    out = inferred.select("file", F.col("m.number").alias("number"), F.col("m.duration_ns").alias("duration_ns"))
    if reported is None:
        return out
    told = reported.where(finite(F.col("value")))
    most = told.groupBy("file").agg(F.max("value").alias("most"))
    r = told.where("value > 0").join(most, "file").select("file", "time_ns", "number", _nanoseconds(F.col("value"), F.col("most")).alias("duration_ns"))
    r = r.join(known, "file", "left").where(plausible(F.col("duration_ns"), F.col("reference_ns"))).groupBy("file").agg(F.min(F.struct("duration_ns", "time_ns", "number")).alias("r"))
    both = out.join(r, "file", "full")
    return both.select("file", F.when(F.col("r").isNotNull(), F.coalesce(F.col("r.number") - 1, F.lit(0))).otherwise(F.col("number")).cast("bigint").alias("number"), F.coalesce("r.duration_ns", "duration_ns").alias("duration_ns"))


def merge_intervals(intervals: DataFrame, keys: list[str], label: str, max_gap_ns: int) -> DataFrame:
    """Neighbouring intervals of one label joined where the gap is at most ``max_gap_ns``: (keys, label, start_ns, end_ns).

    In the order of start; an interval of another label in between keeps them
    apart.  Equal intervals count once.
    """
    intervals = intervals.select(*keys, label, "start_ns", "end_ns").distinct()
    order = Window.partitionBy(*keys).orderBy("start_ns", "end_ns", label)
    d = intervals.withColumn("__other", (~F.col(label).eqNullSafe(F.lag(label).over(order)) | F.lag("start_ns").over(order).isNull()).cast("int"))
    d = d.withColumn("__row", F.sum("__other").over(order))
    alike = Window.partitionBy(*keys, "__row").orderBy("start_ns", "end_ns")
    before = F.max("end_ns").over(alike.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("__new", (before.isNull() | (F.col("start_ns") - before > max_gap_ns)).cast("int")).withColumn("__part", F.sum("__new").over(alike))
    return d.groupBy(*keys, "__row", "__part").agg(F.min(label).alias(label), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns")).drop("__row", "__part")


def spaced(times: DataFrame, keys: list[str], least_ns: int) -> DataFrame:
    """Greedy spacing: each event at least ``least_ns`` after the last one kept; (keys, time_ns).

    An event that far from the candidate before it is kept whatever came before,
    so the candidates fall into clusters that do not depend on each other; each is
    folded in order inside the JVM.
    """
    t = times.select(*keys, "time_ns").distinct()
    t = along(t, keys, ["time_ns"], time_block(), before=["time_ns"])
    apart = F.col("before").isNull() | (F.col("time_ns") - F.col("before.time_ns") >= least_ns)
    t = along(t.select(*keys, "time_ns", apart.cast("int").alias("new")), keys, ["time_ns"], time_block(), sums={"__cluster": F.col("new")})
    g = t.groupBy(*keys, "__cluster").agg(F.sort_array(F.collect_list("time_ns")).alias("t"))
    fold = F.expr(f"aggregate(t, cast(array() as array<bigint>), (a, x) -> if(size(a) = 0 or x - element_at(a, -1) >= {int(least_ns)}L, concat(a, array(x)), a))")
    return g.select(*keys, F.explode(fold).alias("time_ns"))


def beacons(samples: DataFrame, pulse: bool = True, least_ns: int = 5 * SECOND, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """(keys, time_ns): lap markers, rising edges of a pulse channel or steps up of a counter, after time 0, at least 5 s apart."""
    s = along(samples.where(finite(F.col("value"))).select(*keys, "time_ns", "value"), list(keys), ["time_ns"], time_block(), before=["value"])
    edge = (F.col("value") > 0) & (F.col("before.value") <= 0) if pulse else F.col("value") > F.col("before.value")
    return spaced(s.where(edge & (F.col("time_ns") > 0)), list(keys), least_ns)


def lap_markers(samples: DataFrame) -> DataFrame:
    """(file, time_ns): the markers of each file's first channel that has any, pulse channels before counters, each kind in the order of its names."""
    n = normalised(F.col("channel"))
    parts = []
    for kind, (names, pulse) in enumerate(((PULSE_NAMES, True), (COUNTER_NAMES, False))):
        place = F.array_position(F.array(*map(F.lit, names)), n)
        s = samples.where(n.isin(*names)).select("file", F.struct(F.lit(kind).alias("kind"), place.alias("place"), F.col("channel").alias("channel")).alias("source"), "time_ns", "value")
        parts.append(beacons(s, pulse, keys=("file", "source")))
    found = parts[0].unionByName(parts[1])
    first = found.groupBy("file").agg(F.min("source").alias("source"))
    return found.join(first, ["file", "source"], "left_semi").select("file", "time_ns")


def lap_summary(markers: DataFrame) -> DataFrame:
    """(file, total_laps, fastest_lap, fastest_time): laps are the markers and one; times as m:ss.mmm."""
    order = Window.partitionBy("file").orderBy("time_ns")
    d = markers.select("file", (F.row_number().over(order)).alias("i"), (F.lead("time_ns").over(order) - F.col("time_ns")).alias("d"))
    g = d.groupBy("file").agg((F.count(F.lit(1)) + 1).alias("total_laps"), F.min(F.when(F.col("d").isNotNull(), F.struct("d", "i"))).alias("f"))
    ms = F.round(F.col("f.d") / 1e6).cast("bigint")
    text = F.format_string("%d:%02d.%03d", F.floor(ms / 60000).cast("bigint"), F.floor(ms / 1000).cast("bigint") % 60, ms % 1000)
    return g.select("file", "total_laps", (F.col("f.i") + 1).cast("bigint").alias("fastest_lap"), F.when(F.col("f").isNotNull(), text).alias("fastest_time"))


def gate_crossings(track: DataFrame, gate: tuple[float, float, float, float], least_ns: int = 10 * SECOND) -> DataFrame:
    """(file, time_ns): where the track (file, time_ns, latitude, longitude) crosses the gate (lat, lon, lat, lon), 10 s apart.

    A step of the track crosses if each segment's ends lie on different sides of
    the other, or on it.
    """
    ay, ax, by, bx = (F.lit(float(g)) for g in gate)
    t = track.where(finite(F.col("latitude")) & finite(F.col("longitude"))).select("file", "time_ns", "latitude", "longitude")
    t = along(t, ["file"], ["time_ns"], time_block(), before=["latitude", "longitude"]).where("before is not null").withColumns({"y0": F.col("before.latitude"), "x0": F.col("before.longitude")})
    side = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("longitude"), F.col("latitude")
    apart = (side(ax, ay, bx, by, x0, y0) * side(ax, ay, bx, by, x1, y1) <= 0) & (side(x0, y0, x1, y1, ax, ay) * side(x0, y0, x1, y1, bx, by) <= 0)
    moved = (x0 != x1) | (y0 != y1)
    return spaced(t.where(apart & moved), ["file"], least_ns)


def project_track(track: DataFrame) -> DataFrame:
    """(file, time_ns, x_m, y_m): valid coordinates on a plane around each file's mean latitude."""
    ok = finite(F.col("latitude")) & finite(F.col("longitude")) & (F.abs("latitude") <= 90) & (F.abs("longitude") <= 180) & ~((F.col("latitude") == 0) & (F.col("longitude") == 0))
    mean = track.where(ok).groupBy("file").agg(F.avg("latitude").alias("lat0"), F.avg("longitude").alias("lon0"))
    r = 6_371_000.0
    return track.where(ok).join(mean, "file").select("file", "time_ns", (F.radians(F.col("longitude") - F.col("lon0")) * F.cos(F.radians("lat0")) * r).alias("x_m"), (F.radians(F.col("latitude") - F.col("lat0")) * r).alias("y_m"))


def laps_by_value(samples: DataFrame) -> DataFrame:
    """(file, number, start_ns): first time of each rounded counter value in [0, 100000), if there are two or more."""
    v = round_half_away(F.col("value"))
    g = samples.where(finite(F.col("value"))).select("file", v.alias("number"), "time_ns").where("number >= 0 and number < 100000").groupBy("file", "number").agg(F.min("time_ns").alias("start_ns"))
    return g.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("file"))).where("n > 1").drop("n")


def laps_browser(samples: DataFrame, channels: DataFrame, ends: DataFrame, gates: DataFrame | None = None) -> DataFrame:
    """(file, number, start_ns, end_ns, complete): laps of every file by the first of four signs it shows.

    A lap counter with two values or more (each lap begins where its number first
    stands); crossings of a gate (``gates``: file, time_ns); falls of a lap time by
    more than 5 or of a lap distance by more than 20, none within 5 s after
    another; else the whole file is one lap.  ``ends``: file, duration_ns.
    """
    sampled = channels.where("sample_count > 0")
    counter = semantic_channel(sampled, LAP_NAMES).select("file", "channel_id")
    counted = laps_by_value(samples.join(counter, ["file", "channel_id"], "left_semi"))
    place = F.nullif(F.array_position(F.array(*map(F.lit, RESET_NAMES)), normalised(F.col("name"))), F.lit(0))
    source = sampled.withColumn("place", place).where("place is not null").groupBy("file").agg(F.min(F.struct("place", "channel_id")).alias("s")).select("file", "s.place", "s.channel_id")
    v = samples.join(source, ["file", "channel_id"]).where(finite(F.col("value"))).select("file", "time_ns", "value", "place")
    falls = along(v, ["file"], ["time_ns"], time_block(), before=["value"]).where(F.col("before.value") - F.col("value") > F.when(F.col("place") <= RESET_TIMES, 5).otherwise(20)).select("file", "time_ns")
    falls = along(falls, ["file"], ["time_ns"], time_block(), before=["time_ns"]).where(F.col("before").isNull() | (F.col("time_ns") - F.col("before.time_ns") > 5 * SECOND)).select("file", "time_ns")
    none = falls.limit(0)
    gates = none if gates is None else gates.select("file", "time_ns")
    cut = gates.unionByName(falls.join(gates.select("file").distinct(), "file", "left_anti")).join(counted.select("file").distinct(), "file", "left_anti")
    cut = cut.unionByName(cut.select("file").distinct().withColumn("time_ns", F.lit(0).cast("bigint")))
    marks = counted.select("file", "start_ns", "number").unionByName(cut.select("file", F.col("time_ns").alias("start_ns"), F.lit(None).cast("bigint").alias("number")))
    alone = ends.join(marks.select("file").distinct(), "file", "left_anti").select("file", F.lit(0).cast("bigint").alias("start_ns"), F.lit(None).cast("bigint").alias("number"))
    n = along(marks.unionByName(alone), ["file"], ["start_ns"], time_block("start_ns"), after=["start_ns"], number="place").join(ends.select("file", "duration_ns"), "file")
    inner, only = (F.col("place") > 1) & F.col("after").isNotNull(), (F.col("place") == 1) & F.col("after").isNull()
    laps = n.select("file", F.coalesce("number", "place").cast("bigint").alias("number"), "start_ns", F.coalesce("after.start_ns", "duration_ns").alias("end_ns"), (inner | only).alias("complete"))
    return laps.where("end_ns > start_ns")


def trace_rate(duration_ns: Column) -> Column:
    """Ticks a second at which a lap of this length is drawn: about 5000 in all, between 10 and 100 a second."""
    return F.least(F.lit(100), F.greatest(F.lit(10), F.ceil(5000 / F.greatest(duration_ns / 1e9, F.lit(1.0))))).cast("bigint")


def samples_in_laps(samples: DataFrame, laps: DataFrame) -> DataFrame:
    """Samples joined to the lap [start_ns, end_ns) they lie in.

    Laps are cut into 10 s buckets, so that the join is by equal (file, bucket)
    with the range as a filter, and long files are spread.
    """
    width = 10 * SECOND
    b = laps.where("end_ns > start_ns").withColumn("__b", F.explode(F.sequence(F.expr(f"start_ns div {width}"), F.expr(f"(end_ns - 1) div {width}"))))
    s = samples.withColumn("__b", F.expr(f"time_ns div {width}"))
    return s.join(b.select("file", "__b", "number", "start_ns", "end_ns"), ["file", "__b"]).where("time_ns >= start_ns and time_ns < end_ns").drop("__b")


def lap_progress(samples: DataFrame, laps: DataFrame) -> DataFrame:
    """(file, number, channel, sample_index, progress, elapsed_ns): how far through its lap a sample lies, by time, 0 to 1."""
    j = samples_in_laps(samples, laps)
    return j.select("file", "number", "channel", "sample_index", ((F.col("time_ns") - F.col("start_ns")) / (F.col("end_ns") - F.col("start_ns"))).alias("progress"), (F.col("time_ns") - F.col("start_ns")).alias("elapsed_ns"))


def distance_progress(samples: DataFrame, laps: DataFrame) -> DataFrame:
    """(file, number, start_ns, time_ns, progress): how far through its lap a sample of a distance channel lies, 0 to 1.

    By its distance between the least and the greatest of the lap; where these are
    equal or the value is not finite, by its place among the samples of the lap.
    """
    key = ["file", "number", "start_ns"]
    j = samples_in_laps(samples, laps).select(*key, "time_ns", "value")
    span = j.groupBy(*key).agg(F.min(F.when(finite(F.col("value")), F.col("value"))).alias("least"), F.max(F.when(finite(F.col("value")), F.col("value"))).alias("most"), F.count(F.lit(1)).alias("n"))
    n = along(j, key, ["time_ns"], time_block(), number="place").join(span, key)
    by_distance = F.when(finite(F.col("value")) & (F.col("most") > F.col("least")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - F.col("least")) / (F.col("most") - F.col("least")))))
    return n.select(*key, "time_ns", F.coalesce(by_distance, (F.col("place") - 1) / F.greatest(F.col("n") - 1, F.lit(1))).alias("progress"))


#: Classes of progress in which points of two laps meet.
PROGRESS_CLASSES = 1000


def lap_deltas(progress: DataFrame, reference: DataFrame) -> DataFrame:
    """(file, number, start_ns, time_ns, progress, delta_ns): time lost (or won, below 0) against a reference lap at equal progress.

    ``progress``: rows of ``distance_progress``; ``reference``: file, number and
    start_ns of one lap a file.  The point of the reference lap whose progress is
    nearest counts, the earlier of two as near.
    """
    ref = progress.join(reference.select("file", "number", "start_ns"), ["file", "number", "start_ns"], "left_semi").select("file", "progress", (F.col("time_ns") - F.col("start_ns")).alias("elapsed"), "time_ns")
    mine = progress.select("file", "number", "start_ns", "time_ns", "progress")
    block = F.floor(F.col("progress") * PROGRESS_CLASSES)
    own = F.struct("number", "start_ns", "time_ns")
    l = mine.select("file", "progress", F.lit(1).alias("k"), F.lit(0).cast("bigint").alias("o"), own.alias("row"), F.lit(None).cast("struct<p:double,o:bigint,e:bigint>").alias("v"))  # noqa: E741
    r = ref.select("file", "progress", F.lit(0).alias("k"), F.col("time_ns").alias("o"), F.lit(None).cast(l.schema["row"].dataType).alias("row"), F.struct(F.col("progress").alias("p"), F.col("time_ns").alias("o"), F.col("elapsed").alias("e")).alias("v"))
    # Of points with one progress the earliest counts: it stands for them on both sides.
    r = r.groupBy("file", "progress", "k").agg(F.min("o").alias("o"), F.first("row").alias("row"), F.min_by("v", "o").alias("v"))
    u = along(l.unionByName(r), ["file"], ["progress", "k", "o"], block, latest={"p": F.col("v")}, upcoming={"n": F.col("v")}).where("k = 1 and (p is not null or n is not null)")
    p, n = F.col("p"), F.col("n")
    before, after = F.col("progress") - p.p, n.p - F.col("progress")
    pick = F.when(n.isNull() | (before < after) | ((before == after) & (p.o <= n.o)), p.e).otherwise(n.e)
    return u.select("file", "row.number", "row.start_ns", "row.time_ns", "progress", (F.col("row.time_ns") - F.col("row.start_ns") - pick).alias("delta_ns"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], on: str, take: str, name: str) -> DataFrame:
    """``left`` plus the ``take`` of the ``right`` row whose ``on`` is nearest (the lower of two as near); NULL if none.

    Both sides are put in one order once, in blocks of time; the neighbours before
    and after each left row come from two running values.
    """
    extra = [c for c in left.columns if c not in (*keys, on)]
    l = left.select(*keys, on, F.lit(1).alias("__k"), F.lit(None).cast(dict(right.dtypes)[take]).alias("__v"), F.struct(F.lit(0).alias("__none"), *extra).alias("__row"))  # noqa: E741
    r = right.select(*keys, on, F.lit(0).alias("__k"), F.col(take).alias("__v"), F.lit(None).cast(l.schema["__row"].dataType).alias("__row"))
    at = F.when(F.col("__k") == 0, F.struct(F.col(on).alias("o"), F.col("__v").alias("v")))
    u = along(l.unionByName(r), keys, [on, "__k"], time_block(on), latest={"__p": at}, upcoming={"__n": at}).where("__k = 1")
    p, n = F.col("__p"), F.col("__n")
    pick = F.when(n.isNull() | (F.col(on) - p.o <= n.o - F.col(on)), p.v).otherwise(n.v)
    return u.select(*keys, on, *[F.col(f"__row.`{c}`").alias(c) for c in extra], pick.alias(name))


def downsample(samples: DataFrame, keys: list[str], points: int = 80) -> DataFrame:
    """Every n-th sample of each key so that at most about ``points`` remain: n = greatest(1, ceil(total / points))."""
    total = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    d = along(samples, keys, ["time_ns"], time_block(), number="__i").join(total, keys)
    return d.where((F.col("__i") - 1) % F.greatest(F.lit(1), F.ceil(F.col("__n") / points)) == 0).drop("__i", "__n")


def laps_report(laps: DataFrame) -> DataFrame:
    """(file, lap_count, best_number, best_ns): the shortest complete lap above 5 s, else the first lap."""
    best = F.min(F.when(F.col("complete") & (F.col("duration_ns") > 5 * SECOND), F.struct("duration_ns", "start_ns", "number")))
    g = laps.groupBy("file").agg(F.count(F.lit(1)).alias("lap_count"), best.alias("b"), F.min(F.struct("start_ns", "number", "duration_ns")).alias("f"))
    return g.select("file", "lap_count", F.coalesce("b.number", "f.number").alias("best_number"), F.coalesce("b.duration_ns", "f.duration_ns").alias("best_ns"))
