"""Uneven readings of a chunk onto the chunk's regular ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.runtime import columns_named, materialise, spread

#: Stored samples that are looked at together, and ticks written by one row of a long gap.
BLOCK = 1 << 14
PIECE = 1 << 14
#: Longest gap, in ticks, whose ticks are filled by a line between its two readings.
FILL_LIMIT = 10

_SLOT = "struct<file:string,channel_id:bigint,chunk_index:bigint,base:bigint,period:bigint,block:bigint,upto:bigint>"


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def _slots(samples: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (h, i, position, mark, time_ns, value, frequency_hz, slot) of chunk heads and samples.

    A chunk has one head in every block of stored samples it reaches into, so
    that a window over a block finds the chunk of each sample without a join.
    """
    key = [F.xxhash64("file", "channel_id", "block").alias("h"), F.hash("file", "channel_id", "block").alias("i")]
    none = F.lit(None)
    block = lambda c: F.expr(f"{c} div {BLOCK}")
    s = (
        columns_named(samples, "file", "channel_id", "sample_index", "time_ns", "value", "frequency_hz")
        .where("file is not null and channel_id is not null and sample_index is not null and time_ns is not null")
        .withColumn("block", block("sample_index"))
        .select(*key, F.col("sample_index").alias("position"), F.lit(1).alias("mark"), "time_ns", "value", "frequency_hz", none.cast(_SLOT).alias("slot"))
    )
    c = (
        columns_named(chunks, "file", "channel_id", "chunk_index", "sample_period_ns", "sample_count", "sample_base", "time_base_ns")
        .where("file is not null and channel_id is not null and chunk_index is not null and sample_base is not null and time_base_ns is not null and sample_count > 0")
        .distinct()
        .withColumn("upto", F.col("sample_base") + F.col("sample_count"))
        .withColumn("block", F.explode(F.sequence(block("sample_base"), block("(upto - 1)"))))
    )
    slot = F.struct("file", "channel_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("time_base_ns").alias("base"), F.nullif(F.col("sample_period_ns"), F.lit(0)).alias("period"), "block", "upto").cast(_SLOT)
    heads = c.select(*key, F.greatest(F.col("sample_base"), F.col("block") * BLOCK).alias("position"), F.lit(0).alias("mark"), none.cast("bigint").alias("time_ns"), none.cast("double").alias("value"), none.cast("double").alias("frequency_hz"), slot.alias("slot"))
    return heads.unionByName(s)


def _readings(samples: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every stored sample with its chunk and nearest tick; ``last`` marks the last one of a chunk in a block."""
    block = Window.partitionBy("h", "i")
    stored = block.orderBy("position", "mark")
    r = spread(_slots(samples, chunks), samples, "h", "i").withColumns({"slot": F.last("slot", ignorenulls=True).over(stored.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("mark").over(stored), "next_position": F.lead("position").over(stored)})
    r = r.where((F.col("mark") == 1) & F.col("slot").isNotNull() & (F.col("position") < F.col("slot.upto")))
    period = F.coalesce(F.col("slot.period").cast("double"), F.when(F.col("frequency_hz") > 0, F.lit(1e9) / F.col("frequency_hz")))
    exact = F.col("slot.period")
    offset = F.col("time_ns") - F.col("slot.base")
    # Integer arithmetic for a whole period, so that a reading midway between two ticks goes to the later one.
    halves = 2 * offset + exact
    tick = F.when(exact.isNotNull(), F.expr("(2 * (time_ns - slot.base) + slot.period) div (2 * slot.period)") - F.when(halves < 0, 1).otherwise(0))
    tick = tick.otherwise(F.floor(offset / (F.lit(1e9) / F.col("frequency_hz")) + 0.5))
    return r.select("h", "i", "slot", "position", "time_ns", "value", tick.cast("bigint").alias("tick"), period.alias("period"), (F.col("next").isNull() | (F.col("next") == 0) | (F.col("next_position") >= F.col("slot.upto"))).alias("last")).where("tick is not null")


def _paired(samples: DataFrame, chunks: DataFrame) -> DataFrame:
    """The reading that counts of each tick of a block and chunk, with the one after it, and the last stored sample of each.

    Of the finite readings of a tick the nearest counts.  ``local_end`` is the tick
    of the last stored sample.  All windows follow one order.
    """
    r = _readings(samples, chunks).withColumn("finite", _finite(F.col("value"))).where("finite or last")
    r = r.withColumn("off", F.abs(F.col("time_ns") - F.col("slot.base") - F.col("tick") * F.col("period")))
    near = Window.partitionBy("h", "i", "slot.chunk_index")
    inner = near.orderBy("tick", F.col("finite").desc(), "off", "position")
    before = F.lag(F.struct("tick", "finite")).over(inner)
    counts = F.col("finite") & ~F.coalesce(F.col("before.finite") & (F.col("before.tick") == F.col("tick")), F.lit(False))
    kept = r.withColumn("before", before).withColumn("counts", counts).where("counts or last")
    cover = F.when(F.col("finite"), F.col("tick"))
    row = F.struct("tick", "finite", "value")
    kept = kept.withColumns({"n1": F.lead(row).over(inner), "n2": F.lead(row, 2).over(inner), "first_cover": F.min(cover).over(near), "last_cover": F.max(cover).over(near), "local_end": F.max(F.when(F.col("last"), F.col("tick"))).over(near)})
    # At most one row of a block and chunk, its last, is not finite.
    follow = F.when(F.col("n1.finite") == F.lit(False), F.col("n2")).otherwise(F.col("n1"))
    slot = [F.col(f"slot.{f}").alias(f) for f in ("file", "channel_id", "chunk_index", "base", "block")]
    return kept.select(*slot, F.col("slot.period").alias("exact"), "period", "position", "tick", "time_ns", "value", "finite", "last", "counts", "off", "first_cover", "last_cover", "local_end", F.when(F.col("finite"), follow).alias("next"))


def regular_grid(samples: DataFrame, chunks: DataFrame, fill_limit: int = FILL_LIMIT) -> DataFrame:
    """(file, channel_id, chunk_index, tick, time_ns, value, state): one row per tick of each chunk.

    Tick k of a chunk lies at ``time_base_ns + k * period``, from 0 to the tick
    nearest to the chunk's last stored sample; the period is sample_period_ns or,
    where that is NULL or 0, 1e9 / frequency_hz.  A finite reading covers its
    nearest tick (the later one if it lies midway; the nearest reading gives the
    value).  ``state`` is ``reading``, or ``filled`` for a tick in a gap of at most
    ``fill_limit`` ticks between two readings (value on the line between them), or
    ``missing`` (value NULL) in longer gaps and before the first or after the last
    reading.

    Consecutive readings are paired with lead; only the ticks between them are
    generated.  Windows cover blocks of 16,384 stored samples; what crosses blocks
    comes from one row per block and chunk, and only the outermost ticks of a block
    can be covered from two.  Times are taken not to fall from one block to the
    next.  Rows with a NULL key or time are left out, repeated rows count once, a
    chunk without stored samples or without a period has no ticks, empty tables
    give an empty result, extra columns are ignored.
    """
    kept = materialise(_paired(samples, chunks), "paired")
    open_ticks, tail = _open_ticks(kept, fill_limit)
    chunk = ["file", "channel_id", "chunk_index"]
    best = kept.where("counts and tick >= 0").withColumn("t", _at(F.col("tick")))
    # A tick inside the block lies before the chunk's last stored sample and is covered from nowhere else.
    clear = (F.col("tick") > F.col("first_cover")) & (F.col("tick") < F.col("last_cover")) & (F.col("tick") <= F.col("local_end"))
    inside = best.where(clear).select(*chunk, "tick", F.col("t").alias("time_ns"), "value", F.lit("reading").alias("state"))
    ends = tail.select(*chunk, (F.col("after") - 1).alias("end_tick"))
    outer = best.where(~F.coalesce(clear, F.lit(False))).groupBy(*chunk, "tick").agg(F.min(F.struct("off", "position", "value", "t")).alias("best")).join(ends, chunk).where("tick <= end_tick")
    return inside.unionByName(outer.select(*chunk, "tick", F.col("best.t").alias("time_ns"), F.col("best.value").alias("value"), F.lit("reading").alias("state"))).unionByName(open_ticks)


def _at(tick: Column) -> Column:
    """The time of a tick: whole numbers where the period is one."""
    return F.col("base") + F.coalesce(tick * F.col("exact"), F.round(tick * F.col("period"), 0).cast("bigint"))


def _open_ticks(kept: DataFrame, fill_limit: int) -> tuple[DataFrame, DataFrame]:
    """The ticks that no reading covers, filled or missing, and one row per chunk with the tick after its ``after`` - 1st, the last."""
    edge = (F.col("finite") & ((F.col("tick") == F.col("first_cover")) | (F.col("tick") == F.col("last_cover")))) | F.col("last")
    gap = F.col("next.finite") & (F.col("next.tick") - F.col("tick") > 1)
    spare = kept.where(edge | F.coalesce(gap, F.lit(False))).select(
        "file", "channel_id", "chunk_index", "base", "block", "exact", "period", "position", "tick", "finite", "last", "value", "first_cover", "last_cover", F.when(gap, F.col("next.tick")).alias("next_tick"), F.when(gap, F.col("next.value")).alias("next_value")
    )
    spare = materialise(spare, "gaps")
    chunk = ["file", "channel_id", "chunk_index"]
    within = spare.where("next_tick is not null").select(*chunk, "base", "exact", "period", F.col("tick").alias("before"), F.col("value").alias("left"), F.col("next_tick").alias("after"), F.col("next_value").alias("right"))

    is_first, is_last = F.col("finite") & (F.col("tick") == F.col("first_cover")), F.col("finite") & (F.col("tick") == F.col("last_cover"))
    blocks = spare.groupBy(*chunk, "block").agg(
        F.min("base").alias("base"), F.min("exact").alias("exact"), F.min("period").alias("period"),
        F.min(F.when(is_first, F.struct("tick", "value"))).alias("first"), F.max(F.when(is_last, F.struct("tick", "value"))).alias("latest"),
        F.max(F.when(F.col("last"), F.struct("position", "tick"))).alias("end"),
    )
    along = Window.partitionBy(*chunk).orderBy("block")
    blocks = blocks.withColumn("previous", F.last("latest", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    before = blocks.where("first is not null").select(
        *chunk, "base", "exact", "period", F.coalesce(F.col("previous.tick"), F.lit(-1).cast("bigint")).alias("before"), F.col("previous.value").alias("left"), F.col("first.tick").alias("after"), F.when(F.col("previous").isNotNull(), F.col("first.value")).alias("right")
    )
    tail = (
        blocks.groupBy(*chunk)
        .agg(F.min("base").alias("base"), F.min("exact").alias("exact"), F.min("period").alias("period"), F.max_by("end", "block").alias("end"), F.max("latest").alias("latest"))
        .select(*chunk, "base", "exact", "period", F.coalesce(F.col("latest.tick"), F.lit(-1).cast("bigint")).alias("before"), F.lit(None).cast("double").alias("left"), (F.col("end.tick") + 1).alias("after"), F.lit(None).cast("double").alias("right"))
    )
    gaps = within.unionByName(before).unionByName(tail).withColumn("before", F.greatest("before", F.lit(-1).cast("bigint"))).where("after - before > 1")
    pieces = gaps.withColumn("from", F.explode(F.sequence(F.col("before") + 1, F.col("after") - 1, F.lit(PIECE).cast("bigint"))))
    ticks = pieces.withColumn("tick", F.explode(F.sequence("from", F.least(F.col("from") + PIECE - 1, F.col("after") - 1))))
    fill = (F.col("after") - F.col("before") - 1 <= fill_limit) & F.col("left").isNotNull() & F.col("right").isNotNull()
    line = F.col("left") + (F.col("right") - F.col("left")) * ((F.col("tick") - F.col("before")) / (F.col("after") - F.col("before")))
    return ticks.select(*chunk, "tick", _at(F.col("tick")).alias("time_ns"), F.when(fill, line).alias("value"), F.when(fill, "filled").otherwise("missing").alias("state")), tail


def uncovered_ticks(samples: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file, channel_id, chunk_index, tick): the ticks of ``regular_grid`` that no finite reading covers, without the readings."""
    return _open_ticks(_paired(samples, chunks), FILL_LIMIT)[0].select("file", "channel_id", "chunk_index", "tick").distinct()
