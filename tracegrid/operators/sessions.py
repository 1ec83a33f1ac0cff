"""File summaries, schema hashes and the stitching of files into sessions."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.model import finite, round_half_away
from tracegrid.operators.blocks import numbered
from tracegrid.operators.events import merge_intervals
from tracegrid.runtime import materialise

SECOND = 1_000_000_000
WEEK_MS = 604_800_000
#: Fixed values of the 64-bit FNV-1a hash.
FNV_BASIS, FNV_PRIME = 14695981039346656037, 1099511628211


def fnv1a(data: Column) -> Column:
    """The 64-bit FNV-1a hash of a binary column, as decimal(20,0).

    The bytes are folded inside the JVM; the state is kept below 2^64 in a decimal
    of 38 digits, and the exclusive or touches its lowest byte only.
    """
    return F.expr(
        "cast(aggregate(sequence(1, greatest(length({d}), 1)), cast({b} as decimal(38,0)), (h, i) -> "
        "if(length({d}) = 0, h, cast(pmod(cast((h - pmod(h, 256BD) + cast(cast(pmod(h, 256BD) as bigint) ^ cast(conv(hex(substring({d}, i, 1)), 16, 10) as bigint) as decimal(38,0))) as decimal(20,0)) * {p}BD, 18446744073709551616BD) as decimal(38,0)))"
        ") as decimal(20,0))".format(d="__fnv_data", b=FNV_BASIS, p=FNV_PRIME)
    )


def schema_hash(channels: DataFrame) -> DataFrame:
    """(file, schema_hash): FNV-1a over the channels of a file in the order of channel_id.

    Each adds the bytes of its name and unit, A to Z in lower case, and one byte of
    type code, with nothing between them.  Channel lists are bounded by the file
    formats (thousands at most), so one file's list is gathered in one row.
    """
    text = F.translate(F.concat(F.coalesce("name", F.lit("")), F.coalesce("unit", F.lit(""))), ascii_uppercase, ascii_lowercase)
    code = F.lpad(F.hex(F.coalesce(F.col("type_code"), F.lit(0)).cast("bigint")), 2, "0")
    one = F.concat(F.hex(F.encode(text, "utf-8")), code)
    g = channels.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("channel_id", one.alias("t")))), lambda x: x.t), "").alias("t"))
    return g.withColumn("__fnv_data", F.unhex("t")).select("file", fnv1a(F.col("__fnv_data")).alias("schema_hash"))


def hash_hex(h: Column) -> Column:
    """A decimal(20,0) hash as 16 hexadecimal digits."""
    half = F.lit(2**32).cast("decimal(20,0)")
    low = F.pmod(h.cast("decimal(20,0)"), half)
    high = ((h.cast("decimal(20,0)") - low) / half).cast("bigint")
    low = low.cast("bigint")
    return F.concat(F.lpad(F.lower(F.hex(high)), 8, "0"), F.lpad(F.lower(F.hex(low)), 8, "0"))


def file_summary(channels: DataFrame, driver: DataFrame | None = None, laps: DataFrame | None = None, fastest: DataFrame | None = None) -> DataFrame:
    """One row per file: duration, channel and sample counts, schema hash, driver ids, laps and the fastest lap."""
    base = channels.groupBy("file").agg(
        F.max("duration_ns").alias("duration_ns"), F.count(F.lit(1)).alias("channel_count"), F.count_if(F.col("sample_count") > 0).alias("sampled_channel_count"), F.sum("sample_count").alias("sample_count")
    )
    out = base.join(schema_hash(channels), "file")
    if driver is not None:
        ids = driver.groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("driver_id")).cast("array<string>"), ",").alias("driver_ids"))
        out = out.join(ids, "file", "left").withColumn("driver_ids", F.coalesce("driver_ids", F.lit("")))
    if laps is not None:
        out = out.join(laps.groupBy("file").agg(F.count(F.lit(1)).alias("lap_count")), "file", "left").withColumn("lap_count", F.coalesce("lap_count", F.lit(0)))
    if fastest is not None:
        out = out.join(fastest.select("file", F.col("number").alias("fastest_lap_number"), F.col("duration_ns").alias("fastest_lap_time_ns")), "file", "left")
    return out


def gps_clock(week: DataFrame, itow: DataFrame) -> DataFrame:
    """(file, absolute_start_ns, gps_week): the file start on the GPS clock, from week and milliseconds of week samples.

    Both (file, time_ns, value); the first finite sample of each counts, less its
    time in the file.
    """
    first = lambda d: d.where(finite(F.col("value"))).groupBy("file").agg(F.min(F.struct("time_ns", "value")).alias("f"))
    w, i = first(week).select("file", F.col("f.value").alias("week")), first(itow).select("file", F.col("f.value").alias("itow"), F.col("f.time_ns").alias("t"))
    j = w.join(i, "file")
    return j.select("file", ((round_half_away(F.col("week")) * WEEK_MS + round_half_away(F.col("itow"))) * 1_000_000 - F.col("t")).alias("absolute_start_ns"), round_half_away(F.col("week")).alias("gps_week"))


def session_key(hint: Column, hash_text: Column) -> Column:
    """``hint:hash``; NULL without a hint."""
    return F.concat(hint, F.lit(":"), hash_text)


def group_sessions(files: DataFrame, max_gap_seconds: int = 60) -> DataFrame:
    """``files`` (file, session_key, absolute_start_ns, absolute_end_ns) plus ``session``, files of one continuous recording.

    In the order of key (NULL first) and start, a file joins the one before it if
    both have the same key and its start is at most the gap after that one's end.
    Sessions are numbered from 0 over the whole input in this order, and named by
    their key and number; a file without key is a session, ``unkeyed:`` and its number.
    """
    if not 0 <= max_gap_seconds <= 86_400:
        raise ValueError("max_gap_seconds must be between 0 and 86400")
    alone = F.when(F.col("session_key").isNull(), F.col("file"))
    place = ["session_key", alone]
    order = Window.partitionBy(*place).orderBy(F.col("absolute_start_ns").asc_nulls_first(), "file")
    near = F.col("absolute_start_ns") <= F.lag("absolute_end_ns").over(order) + max_gap_seconds * SECOND
    d = files.withColumn("__new", ~F.coalesce(near & F.col("session_key").isNotNull(), F.lit(False)))
    d = d.withColumn("__first", F.last(F.when(F.col("__new"), F.col("file")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = [F.col("session_key").asc_nulls_first(), F.col("absolute_start_ns").asc_nulls_first(), F.col("file").asc()]
    firsts = numbered(d.where("__new").select("session_key", "absolute_start_ns", "file"), ranked, "__number").select(F.col("file").alias("__first"), "__number")
    number = F.col("__number").cast("string")
    return d.join(firsts, "__first").withColumn("session", F.concat_ws(":", F.coalesce("session_key", F.concat(F.lit("unkeyed:"), number)), number)).drop("__new", "__first", "__number")


SESSIONS = ("session_key", "file_count", "absolute_start_ns", "absolute_end_ns", "duration_ns", "driver_ids", "stint_count", "lap_count", "fastest_lap_number", "fastest_lap_time_ns")


def session_metadata(files: DataFrame, stints: DataFrame, laps: DataFrame, max_gap_seconds: int = 60, fastest: DataFrame | None = None) -> DataFrame:
    """One row per session: files, absolute range, duration, driver ids, stints and laps merged across files, fastest lap.

    ``fastest`` (file, number, duration_ns) are the files' own fastest laps, the
    shortest of which outranks one told from the merged laps.  Files without an
    absolute start count, their stints and laps do not.
    """
    f = materialise(group_sessions(files, max_gap_seconds).select("file", "session", "absolute_start_ns", "absolute_end_ns"), "sessions")
    base = f.groupBy("session").agg(F.count(F.lit(1)).alias("file_count"), F.min("absolute_start_ns").alias("absolute_start_ns"), F.max("absolute_end_ns").alias("absolute_end_ns"))
    place = lambda d: d.join(f.where("absolute_start_ns is not null"), "file").withColumns({"start_ns": F.col("start_ns") + F.col("absolute_start_ns"), "end_ns": F.col("end_ns") + F.col("absolute_start_ns")})
    gap = max_gap_seconds * SECOND
    ids = stints.join(f.select("file", "session"), "file").groupBy("session").agg(F.array_join(F.array_sort(F.collect_set("driver_id")).cast("array<string>"), ",").alias("driver_ids"))
    s = merge_intervals(place(stints).select("session", "driver_id", "start_ns", "end_ns"), ["session"], "driver_id", gap)
    n = merge_intervals(place(laps).select("session", "number", "start_ns", "end_ns"), ["session"], "number", gap)
    order = Window.partitionBy("session").orderBy("start_ns")
    n = n.withColumns({"first": F.lag("number").over(order).isNull(), "last": F.lead("number").over(order).isNull()})
    inner = ~F.col("first") & ~F.col("last") & (F.col("end_ns") - F.col("start_ns") >= 10 * SECOND)
    gs = s.groupBy("session").agg(F.count(F.lit(1)).alias("stint_count"))
    gn = n.groupBy("session").agg(F.count(F.lit(1)).alias("lap_count"), F.min(F.when(inner, F.struct((F.col("end_ns") - F.col("start_ns")).alias("d"), "start_ns", "number"))).alias("told"))
    out = base.join(ids, "session", "left").join(gs, "session", "left").join(gn, "session", "left")
    if fastest is None:
        out = out.withColumn("own", F.lit(None).cast("struct<d:bigint,file:string,number:bigint>"))
    else:
        own = fastest.join(f.select("file", "session"), "file").groupBy("session").agg(F.min(F.struct(F.col("duration_ns").alias("d"), "file", "number")).alias("own"))
        out = out.join(own, "session", "left")
    return out.select(
        F.col("session").alias("session_key"), "file_count", "absolute_start_ns", "absolute_end_ns", F.coalesce(F.col("absolute_end_ns") - F.col("absolute_start_ns"), F.lit(0)).alias("duration_ns"),
        F.coalesce("driver_ids", F.lit("")).alias("driver_ids"), F.coalesce("stint_count", F.lit(0)).alias("stint_count"), F.coalesce("lap_count", F.lit(0)).alias("lap_count"),
        F.coalesce("own.number", "told.number").alias("fastest_lap_number"), F.coalesce("own.d", "told.d").alias("fastest_lap_time_ns"),
    )


def stitch(wide_rows: DataFrame, files: DataFrame, max_gap_seconds: int = 60, session: str | None = None, every: bool = False) -> DataFrame:
    """Wide rows of the files of sessions on the session's clock: session_key, time_ns, file_time_ns, source_file, channels.

    ``session`` names the session to read, ``every`` takes all of them; without
    either exactly one must be there.
    """
    f = group_sessions(files, max_gap_seconds)
    if every:
        pass
    elif session is None:
        found = [r[0] for r in f.select("session").distinct().limit(2).collect()]
        if len(found) != 1:
            raise ValueError("the files form no session" if not found else "the files form more than one session")
    else:
        f = f.where(F.col("session") == session)
    start = f.groupBy("session").agg(F.min("absolute_start_ns").alias("__start"))
    offset = f.join(start, "session").select("file", F.col("session").alias("session_key"), (F.col("absolute_start_ns") - F.col("__start")).alias("__offset"))
    rest = [c for c in wide_rows.columns if c not in ("file", "time_ns")]
    return wide_rows.join(offset, "file").select("session_key", (F.col("time_ns") + F.col("__offset")).alias("time_ns"), F.col("time_ns").alias("file_time_ns"), F.col("file").alias("source_file"), *[F.col(f"`{c}`") for c in rest])
