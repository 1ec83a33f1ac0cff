"""Mixed-rate channels on one shared timeline: previous value or line, by the kind of channel.

No as-of join: every sample is paired with the one after it and generates the
ticks between them, so the only shuffle is the one that brings neighbours together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.model import is_step
from tracegrid.operators.blocks import along, index_block, time_block

SECOND = 1_000_000_000
#: Stored samples of one channel that share a task.
BLOCK = 1 << 14
#: Ticks of one file that share a task when channels are gathered into rows.
BUCKET = 1 << 12


def lead_in_blocks(df: DataFrame, keys: list[str], order: str, carried: list[str], block: Column | None = None, name: str = "next") -> DataFrame:
    """``df`` plus a struct of ``carried`` from the following row of the same keys.

    Windows cover (keys, block) only; the last row of a block takes its follower
    from a table with one row per block, so a hot key is spread over its blocks.
    """
    block = F.lit(0) if block is None else block
    d = df.withColumn("__block", block)
    inside = Window.partitionBy(*keys, "__block").orderBy(order)
    d = d.withColumn("__in", F.lead(F.struct(*carried)).over(inside))
    firsts = df.withColumn("__block", block).groupBy(*keys, "__block").agg(F.min_by(F.struct(*carried), order).alias("__first"))
    firsts = firsts.withColumn("__after", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__block"))).select(*keys, "__block", "__after")
    return d.join(firsts, [*keys, "__block"]).withColumn(name, F.coalesce("__in", "__after")).drop("__in", "__after", "__block")


def first_tick(x: Column, rate: int) -> Column:
    """The first tick at or after ``x`` ns: ceil(x * rate / 1e9) without overflow."""
    whole, part = F.floor(x / F.lit(SECOND)), F.pmod(x, F.lit(SECOND))
    return (whole * rate + F.ceil(part * rate / F.lit(SECOND))).cast("bigint")


def tick_time(r: Column, rate: int) -> Column:
    """floor(r * 1e9 / rate) ns."""
    if SECOND % rate == 0:
        return r * (SECOND // rate)
    whole, part = F.floor(r / F.lit(rate)), F.pmod(r, F.lit(rate))
    return (whole * SECOND + F.floor(part * SECOND / F.lit(rate))).cast("bigint")


def _check(rate: int, interpolate: str, start_ns: int, end_ns: int | None) -> None:
    if not 1 <= rate <= 5000:
        raise ValueError("rate must be between 1 and 5000")
    if interpolate not in ("linear", "previous"):
        raise ValueError("interpolate must be 'linear' or 'previous'")
    if end_ns is not None and end_ns < start_ns:
        raise ValueError("end_ns lies before start_ns")


def _stretches(samples: DataFrame, rate: int, interpolate: str, start_ns: int, end_ns: int | None) -> DataFrame:
    """One row per sample with the one after it (``next``), its first and last tick, ``lo`` and ``hi``, and whether a line leads on (``slopes``)."""
    extent = F.col("extent_ns") if "extent_ns" in samples.columns else F.lit(None).cast("bigint")
    s = samples.select("file", "channel", "sample_index", "time_ns", "value", "duration_ns", "data_type", extent.alias("extent_ns"))
    s = lead_in_blocks(s, ["file", "channel"], "sample_index", ["time_ns", "value"], F.expr(f"sample_index div {BLOCK}"))
    begin = F.when(F.col("sample_index") == 0, F.lit(0)).otherwise(F.col("time_ns"))
    end = F.least(F.coalesce(F.col("next.time_ns"), F.col("duration_ns")), F.col("duration_ns"))
    if end_ns is not None:
        end = F.least(end, F.lit(end_ns))
    lo = first_tick(F.greatest(begin - start_ns, F.lit(0)), rate)
    hi = first_tick(F.greatest(end - start_ns, F.lit(0)), rate) - 1
    # Told once per sample, not per tick.
    slopes = F.lit(False) if interpolate == "previous" else ~is_step(F.col("channel"), F.col("data_type")) & F.col("next").isNotNull()
    return s.withColumns({"lo": lo, "hi": hi, "slopes": slopes}).where("hi >= lo")


def _value_at() -> Column:
    """The value of a stretch at the time ``at``."""
    a, ta, b, tb, t = F.col("value"), F.col("time_ns"), F.col("next.value"), F.col("next.time_ns"), F.col("at")
    line = a + (b - a) * ((t - ta) / (tb - ta))
    return F.when((t >= F.col("extent_ns")) & F.col("next").isNotNull(), b).when(F.col("slopes") & (t > ta) & (tb > ta), line).otherwise(a)


def resample(samples: DataFrame, rate: int = 100, interpolate: str = "linear", start_ns: int = 0, end_ns: int | None = None) -> DataFrame:
    """(file, channel, tick, time_ns, value): every channel on the grid of ``rate`` ticks a second.

    ``samples``: file, channel, sample_index, time_ns, value, duration_ns (of the
    channel) and data_type; optionally extent_ns, the end of the stretch a sample
    stands for (the end of its chunk for a chunk's last sample).  At a tick the
    sample before it counts; after ``extent_ns`` and before the first sample it is
    the sample that follows; the last sample holds until the duration, from which
    on there is no value.  ``linear`` draws lines between samples of floating
    channels whose name is not that of a step channel, ``previous`` never does.
    """
    _check(rate, interpolate, start_ns, end_ns)
    start_ns = max(0, start_ns)
    g = _stretches(samples, rate, interpolate, start_ns, end_ns).withColumn("tick", F.explode(F.sequence("lo", "hi")))
    g = g.withColumn("at", F.lit(start_ns) + tick_time(F.col("tick"), rate))
    return g.select("file", "channel", "tick", F.col("at").alias("time_ns"), _value_at().alias("value"))


def _spelled(channels: list[str]) -> dict[str, str]:
    return {c.lower(): c for c in channels}


def resample_wide(samples: DataFrame, channels: list[str], rate: int = 100, interpolate: str = "linear", start_ns: int = 0, end_ns: int | None = None) -> DataFrame:
    """(file, time_ns, one column per channel): ``wide`` of ``resample`` without moving the ticks.

    The samples, not the ticks they make, are shuffled: by file and stretch of
    ``BUCKET`` ticks, into which long pauses are cut.  Ticks are generated and
    gathered into rows inside a partition.
    """
    _check(rate, interpolate, start_ns, end_ns)
    start_ns = max(0, start_ns)
    folded = _spelled(channels)
    s = _stretches(samples.where(F.lower("channel").isin(list(folded))), rate, interpolate, start_ns, end_ns)
    s = s.withColumn("bucket", F.explode(F.sequence(F.expr(f"lo div {BUCKET}"), F.expr(f"hi div {BUCKET}"))))
    s = s.withColumns({"lo": F.greatest("lo", F.col("bucket") * BUCKET), "hi": F.least("hi", F.col("bucket") * BUCKET + BUCKET - 1), "k": F.lower("channel")}).repartition("file", "bucket")
    g = s.withColumn("tick", F.explode(F.sequence("lo", "hi"))).withColumn("at", F.lit(start_ns) + tick_time(F.col("tick"), rate))
    g = g.select("file", "bucket", F.col("at").alias("time_ns"), "k", _value_at().alias("value"))
    # One value a channel and tick, so that the largest is the value.
    w = g.groupBy("file", "bucket", "time_ns").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(c) for k, c in folded.items()])
    return w.drop("bucket")


def wide(long: DataFrame, channels: list[str]) -> DataFrame:
    """(file, time_ns, one column per channel): NULL where a file lacks the channel or it has ended.

    Names match without regard to case; the column takes the spelling given.
    """
    folded = _spelled(channels)
    names = F.create_map(*[x for k, v in folded.items() for x in (F.lit(k), F.lit(v))])
    picked = long.withColumn("channel", F.try_element_at(names, F.lower("channel"))).where("channel is not null")
    return picked.groupBy("file", "time_ns").pivot("channel", list(folded.values())).agg(F.first("value"))


def modal_chunks(samples: DataFrame) -> DataFrame:
    """(file, channel, chunk_index, sample_period_ns, sample_base, sample_count, time_base_ns) of jittery timestamps.

    The period is the most frequent distance between neighbouring samples (the
    smallest of equals); a chunk ends where the distance exceeds two periods.
    """
    key = ["file", "channel"]
    d = along(samples.select(*key, "time_ns"), key, ["time_ns"], time_block(), before=["time_ns"], number="i").select(*key, "time_ns", (F.col("i") - 1).alias("i"), (F.col("time_ns") - F.col("before.time_ns")).alias("delta"))
    counts = d.where("delta > 0").groupBy(*key, "delta").agg(F.count(F.lit(1)).alias("n"))
    period = counts.groupBy(*key).agg(F.max(F.struct("n", (-F.col("delta")).alias("d"))).alias("m")).select(*key, (-F.col("m.d")).alias("period"))
    d = d.join(period, key, "left").withColumn("cut", (F.col("delta") > 2 * F.col("period")).cast("int"))
    d = along(d, key, ["i"], index_block("i"), sums={"chunk_index": F.col("cut")})
    return d.groupBy(*key, "chunk_index").agg(F.min("period").alias("sample_period_ns"), F.min("i").cast("bigint").alias("sample_base"), F.count(F.lit(1)).alias("sample_count"), F.min("time_ns").alias("time_base_ns"))


def chunk_extents(samples: DataFrame, chunks: DataFrame) -> DataFrame:
    """``samples`` plus extent_ns: the nominal end of the chunk for its last sample, NULL for the others."""
    ends = chunks.select("file", "channel", (F.col("sample_base") + F.col("sample_count") - 1).alias("sample_index"), (F.col("time_base_ns") + F.col("sample_count") * F.col("sample_period_ns")).alias("extent_ns"))
    return samples.join(ends, ["file", "channel", "sample_index"], "left")


def time_range(samples: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Samples with start_ns <= time_ns < end_ns; negative bounds count as 0."""
    start, end = max(0, start_ns or 0), None if end_ns is None else max(0, end_ns)
    if end is not None and end < start:
        raise ValueError("end_ns lies before start_ns")
    out = samples.where(F.col("time_ns") >= start)
    return out if end is None else out.where(F.col("time_ns") < end)


def pick_channels(samples: DataFrame, names: str, column: str = "channel") -> DataFrame:
    """Samples of a comma-separated list of channels, without regard to case and blanks."""
    wanted = sorted({n.strip().lower() for n in names.split(",") if n.strip()})
    return samples.where(F.lower(column).isin(wanted))


def sum_channels(samples: DataFrame, sources: list[str], target: str) -> DataFrame:
    """A derived channel: the sum of channels on the same clock, sample by sample.

    Only (file, sample_index) that every source has are summed; sources whose times
    or units differ at an index raise when the query runs.
    """
    s = samples.where(F.lower("channel").isin([x.lower() for x in sources])).groupBy("file", "sample_index")
    g = s.agg(F.count(F.lit(1)).alias("n"), F.min("time_ns").alias("time_ns"), F.max("time_ns").alias("__t"), F.min("unit").alias("unit"), F.max("unit").alias("__u"), F.sum("value").alias("value"))
    fail = F.raise_error(F.lit("channels of a sum need one clock and one unit"))
    return g.where(F.col("n") == len(sources)).select("file", F.lit(target).alias("channel"), "sample_index", "time_ns", F.when((F.col("time_ns") == F.col("__t")) & F.col("unit").eqNullSafe(F.col("__u")), F.col("unit")).otherwise(fail.cast("string")).alias("unit"), "value")


def frame_at(times: DataFrame, frames: DataFrame) -> DataFrame:
    """``times`` (file, time_ns) plus frame_index: the last video frame shown at or before each time, 0 before the first."""
    t = times.select("file", "time_ns", F.lit(1).alias("k"), F.lit(None).cast("bigint").alias("f")).unionByName(frames.select("file", "time_ns", F.lit(0).alias("k"), F.col("frame_index").cast("bigint").alias("f")))
    t = along(t, ["file"], ["time_ns", "k"], time_block(), latest={"last": F.col("f")}).where("k = 1")
    return t.select("file", "time_ns", F.coalesce("last", F.lit(0).cast("bigint")).alias("frame_index"))
