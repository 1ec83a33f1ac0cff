"""Implausible readings: out of physical range, short spikes and stuck stretches.

One shuffle of the samples.  Readings are laid out in blocks of consecutive
stored samples with a halo, so that no channel, however large, meets in one
task; each block yields a quantile sketch for each hour it reaches into and its
suspicious rows, the sketches of an hour and of a channel are merged across
blocks, and only suspicious rows meet the merged fences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.operators._series import WIDEST, excursions, group_quantiles, runs, second_difference, shifted
from tracegrid.operators.unit_resolution import resolve_units
from tracegrid.runtime import columns_named, materialise, spread

BLOCK = 1 << 14
HALO = 16
HOUR_NS = 3_600_000_000_000
#: Shortest run of one value that counts as stuck.
STUCK = 8
#: Fences in half interquartile ranges of the local deviation, times SIGMA.  A deviation from the mean of two
#: neighbours scatters by sqrt(1.5) standard deviations and half the interquartile range of a normal variable is
#: 0.674 of them, so SIGMA of these make one.  The outer fence is nine, or 5 interquartile ranges beyond a
#: quartile; that of channels whose values lie on a lattice, where half ranges are whole grains, is lower.
SIGMA = 1.21
FENCE, LATTICE_FENCE, LATTICE_WIDE_FENCE = 9.0, 4.9, 3.0
#: Share of changes between neighbouring samples from which on a channel "changes at nearly every sample".
LIVELY = 0.85
#: Samples outside the runs that are enough to tell; a channel of few samples needs but 30 % of them.
OUTSIDE = 8
#: Points of a block's quantile sketch, and classes of size for each factor of e in which points are merged.
POINTS, CLASSES = 25, 50
_BATCH_ROWS = 150_000

OTHER, DISCRETE, RESTING = 0, 1, 2
STATS, LIMIT, SPIKE, RUN = 0, 1, 2, 3

_HEAD = "struct<file:string,channel_id:bigint,block:bigint,scale:double,shift:double,low:double,high:double,kind:int>"
_OUT = (
    "file string, channel_id bigint, block bigint, what int, lo bigint, hi bigint, measure double, spread double, lattice boolean, width int,"
    " rest boolean, kind int, hour bigint, n bigint, moves bigint, changes bigint, held bigint, most double, s_all double, weight bigint, points array<double>"
)

_RESTING_NAMES = ("speed", "throttle", "brake", "pedal", "brk", "tps", "spd", "vcar", "vwhl", "rpm")
_RESTING_STARTS = ("ws0", "ws1", "ws2", "vss", "engn")


def _kind(name: Column, quantity: Column, is_step: Column, dimension: Column) -> Column:
    """Discrete quantity, speed or pedal, or other: by quantity, dimension and name."""
    text = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")
    pattern = f"{'|'.join(_RESTING_NAMES)}|^(?:{'|'.join(_RESTING_STARTS)})"
    resting = text(quantity).rlike(pattern) | text(name).rlike(pattern) | F.coalesce(dimension == "speed", F.lit(False))
    discrete = F.coalesce(is_step, F.lit(False)) | F.coalesce(dimension == "count", F.lit(False))
    return F.when(discrete, DISCRETE).when(resting, RESTING).otherwise(OTHER)


def channel_heads(channels: DataFrame, unit_defs: DataFrame, channel_rules: DataFrame, channel_limits: DataFrame) -> DataFrame:
    """(file, channel_id, scale, shift, low, high, kind): one row per channel definition."""
    c = columns_named(channels, "file", "channel_id", "name", "unit").where("file is not null and channel_id is not null").dropDuplicates(["file", "channel_id"])
    r = F.col("resolved")
    c = resolve_units(c, unit_defs, channel_rules, channel_limits).select("file", "channel_id", "name", "resolved")
    return c.select(
        "file", "channel_id", r.to_base_scale.alias("scale"), r.to_base_offset.alias("shift"), r.low.alias("low"), r.high.alias("high"),
        _kind(F.col("name"), r.quantity, r.is_step, r.dimension).alias("kind"),
    )


def _layout(samples: DataFrame, chunks: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows (h, i, position, mark, time_ns, value, head): a head, chunk starts and samples for each block.

    ``mark``: 0 head of a block, 1 start of a chunk, 2 sample.  Sample rows carry
    two hashes of their block instead of its name.
    """
    key = lambda b: [F.xxhash64("file", "channel_id", b).alias("h"), F.hash("file", "channel_id", b).alias("i")]
    x = F.col("value")
    s = columns_named(samples, "file", "channel_id", "sample_index", "time_ns", "value").where(
        x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))) & F.col("file").isNotNull() & F.col("channel_id").isNotNull() & F.col("sample_index").isNotNull() & F.col("time_ns").isNotNull()
    )
    at = F.col("sample_index")
    own, inside = F.expr(f"sample_index div {BLOCK}"), F.pmod(at, F.lit(BLOCK))
    haloed = lambda df: df.withColumn(
        "block",
        F.explode(F.when((inside < HALO) & (own > 0), F.array(own, own - 1)).when(inside >= BLOCK - HALO, F.array(own, own + 1)).otherwise(F.array(own))),
    )
    none = F.lit(None)
    rows = haloed(s).select(*key("block"), at.alias("position"), F.lit(2).alias("mark"), "time_ns", "value", none.cast(_HEAD).alias("head"))
    starts = columns_named(chunks, "file", "channel_id", "sample_base").dropna().distinct().withColumnRenamed("sample_base", "sample_index")
    marks = haloed(starts).select(*key("block"), at.alias("position"), F.lit(1).alias("mark"), none.cast("long").alias("time_ns"), none.cast("double").alias("value"), none.cast(_HEAD).alias("head"))
    blocks = s.groupBy("file", "channel_id", own.alias("block")).agg(F.count(F.lit(1)).alias("rows"))
    # A block that holds nothing but the halo of its neighbour needs no head: its rows are dropped.
    head = F.struct("file", "channel_id", "block", "scale", "shift", "low", "high", "kind").cast(_HEAD)
    tops = blocks.join(heads, ["file", "channel_id"], "left").select(*key("block"), F.lit(-(2**62)).alias("position"), F.lit(0).alias("mark"), none.cast("long").alias("time_ns"), none.cast("double").alias("value"), head.alias("head"))
    return tops.unionByName(marks).unionByName(rows)


def _analyse(table: pa.Table, fields: list[str]) -> dict | None:
    """Statistics and suspicious stretches of whole blocks, rows sorted by (h, i, position, mark)."""
    col = lambda c: table.column(c).combine_chunks()
    h, i2 = col("h").to_numpy(), col("i").to_numpy()
    mark, position = col("mark").to_numpy(), col("position").to_numpy()
    if not len(h):
        return None
    fresh = np.r_[True, (h[1:] != h[:-1]) | (i2[1:] != i2[:-1])]
    group = np.cumsum(fresh) - 1
    top = np.flatnonzero(mark == 0)
    heads = [x for x in col("head").take(pa.array(top)).to_pylist()]
    by_group: list = [None] * (group[-1] + 1)
    for at, x in zip(group[top], heads, strict=True):
        by_group[at] = x
    known = np.array([x is not None for x in by_group])
    chunk_no = np.cumsum(mark == 1)
    keep = np.flatnonzero((mark == 2) & known[group])
    # The same stored sample may have been delivered twice.
    twice = np.r_[False, (group[keep][1:] == group[keep][:-1]) & (position[keep][1:] == position[keep][:-1])]
    keep = keep[~twice]
    if not len(keep):
        return None
    number = lambda f, missing: np.array([missing if x is None or x[f] is None else x[f] for x in by_group])
    g, at, chunk = group[keep], position[keep], chunk_no[keep]
    t = col("time_ns").fill_null(0).to_numpy()[keep].astype(np.float64)
    x = col("value").fill_null(0.0).to_numpy()[keep]
    block = number("block", 0).astype(np.int64)
    kind = number("kind", OTHER).astype(np.int64)
    scale, shift, low, high = (number(f, np.nan).astype(np.float64) for f in ("scale", "shift", "low", "high"))
    own = (at >= block[g] * BLOCK) & (at < (block[g] + 1) * BLOCK)
    out: dict[str, list] = {f: [] for f in fields}

    def emit(what: int, gs: np.ndarray, **columns) -> None:
        m = len(gs)
        names = [by_group[k] for k in gs]
        given = {"file": [n["file"] for n in names], "channel_id": [n["channel_id"] for n in names], "block": [n["block"] for n in names], "what": [what] * m}
        for f in fields:
            v = given.get(f, columns.get(f))
            out[f].extend([None] * m if v is None else v.tolist() if isinstance(v, np.ndarray) else v)

    with np.errstate(all="ignore"):
        base = x * scale[g] + shift[g]
        slack = 1e-9 * np.maximum(1.0, np.abs(np.where(base > high[g], high[g], low[g])))
        beyond = (base < low[g] - slack) | (base > high[g] + slack)
    hit = np.flatnonzero(beyond & own)
    if len(hit):
        first = np.r_[True, (g[hit][1:] != g[hit][:-1]) | (at[hit][1:] != at[hit][:-1] + 1)]
        start = np.flatnonzero(first)
        stop = np.r_[start[1:], len(hit)] - 1
        emit(LIMIT, g[hit[start]], lo=at[hit[start]], hi=at[hit[stop]])

    # Runs of one value within a chunk; a missing value inside does not end a run.
    same = np.r_[False, (g[1:] == g[:-1]) & (chunk[1:] == chunk[:-1])]
    s, e = runs(x, same)
    long = e - s + 1 >= STUCK
    s, e = s[long], e[long]
    held = np.zeros(len(x) + 1, np.int64)
    np.add.at(held, s, 1)
    np.add.at(held, e + 1, -1)
    held = np.cumsum(held[:-1]) > 0

    # Spikes, among the samples inside the limits.
    c = np.flatnonzero(~beyond)
    cg, cx, ct, cat = g[c], x[c], t[c], at[c]
    groups = group[-1] + 1
    spiky = np.zeros(len(x), bool)
    if len(c):
        leaning = second_difference(cx, cg)
        d = np.abs(leaning)
        hour = (ct // HOUR_NS).astype(np.int64)
        context = np.unique(np.stack([cg, hour]), axis=1, return_inverse=True)[1].ravel() if len(np.unique(hour)) > 1 else np.unique(cg, return_inverse=True)[1]
        n_context = context.max() + 1
        context_group = np.zeros(n_context, np.int64)
        context_group[context] = cg

        def per_context(v: np.ndarray, q: float) -> np.ndarray:
            gs, _, qs = group_quantiles(v, context, np.array([q]))
            r = np.zeros(n_context)
            r[gs] = qs[:, 0]
            return r

        mine = own[c]
        moving = np.where(d > 0, d, np.nan)
        s_all, s_moving = per_context(d, 0.5), per_context(moving, 0.5)
        step = np.abs(cx - shifted(cx, cg, 1))
        grain = per_context(np.where(step > 0, step, np.nan), 0.02)
        sigma = SIGMA * s_moving
        lattice = (s_moving >= 0.49 * grain) & (s_moving <= 1.1 * grain)
        dt = ct - shifted(ct, cg, 1)
        gs, _, qs = group_quantiles(dt, cg, np.array([0.5]))
        period = np.full(groups, np.nan)
        period[gs] = qs[:, 0]
        gap = ~(dt <= 2.5 * period[cg])
        segment = np.cumsum(gap)
        bend = np.abs(cx - 2 * shifted(cx, cg, 1) + shifted(cx, cg, 2))
        sig, lat = sigma[context], lattice[context]
        worth = (sig > 0) & mine & ((bend > np.where(lat, 2, 4) * sig) | np.isnan(bend) | gap | np.r_[False, gap[:-1]])
        cand = np.flatnonzero(worth)
        for series in (cg, segment):
            dev, width = excursions(cx, ct, series, cand)
            z = dev / sig[cand]
            fence = np.where(lat[cand], np.where((width >= 2) & (s_all[context[cand]] == 0), LATTICE_WIDE_FENCE, LATTICE_FENCE), FENCE)
            k = np.flatnonzero(z > fence / 2)
            if len(k):
                a, w = cand[k], width[k]
                emit(SPIKE, cg[a], lo=cat[a], hi=cat[a + w - 1], measure=dev[k], spread=s_moving[context[a]], lattice=lat[a], width=w.astype(np.int32), s_all=s_all[context[a]], hour=hour[a])
                sure = z[k] > fence[k]
                for j in range(WIDEST):
                    spiky[c[a[sure & (w > j)] + j]] = True

        # The sketch of each hour context of the block, over its own samples.
        clean = mine & ~spiky[c]
        n = np.bincount(context[mine], minlength=n_context)
        prev_same = np.r_[False, cg[1:] == cg[:-1]]
        outside = prev_same & mine & ~(held[c] & np.r_[False, held[c][:-1]])
        moves = np.bincount(context[outside], minlength=n_context)
        changes = np.bincount(context[outside & (step > 0)], minlength=n_context)
        in_run = np.bincount(context[mine & held[c]], minlength=n_context)
        most = np.full(n_context, -np.inf)
        np.maximum.at(most, context[clean], cx[clean])
        hour_of = np.zeros(n_context, np.int64)
        hour_of[context] = hour
        # Points at equal steps of rank of the deviations that are not 0, upwards and downwards; each stands for as many.
        ranks = (np.arange(POINTS) + 0.5) / POINTS
        gs, count, qs = group_quantiles(np.where(mine & (d > 0), leaning, np.nan), context, ranks)
        weight = np.zeros(n_context, np.int64)
        weight[gs] = count
        sketch = dict(zip(gs.tolist(), qs.tolist(), strict=True))
        ks = np.flatnonzero(n > 0)
        gk = context_group[ks]
        emit(
            STATS, gk, n=n[ks], moves=moves[ks], changes=changes[ks], held=in_run[ks], most=np.where(np.isfinite(most[ks]), most[ks], np.nan),
            weight=weight[ks], points=[sketch.get(k) for k in ks.tolist()], kind=kind[gk].astype(np.int32), hour=hour_of[ks],
        )

    # Long runs, cut where the index jumps (a missing value) and to the block's own rows.
    runs_to_emit = [(p, q) for p, q in zip(s.tolist(), e.tolist(), strict=True) if kind[g[p]] != DISCRETE]
    if runs_to_emit:
        lo, hi, gs, values, rest = [], [], [], [], []
        for p, q in runs_to_emit:
            k = g[p]
            cut = np.flatnonzero(np.diff(at[p : q + 1]) != 1) + p
            for a, b in zip([p, *(cut + 1)], [*cut, q], strict=True):
                first, last = max(at[a], block[k] * BLOCK), min(at[b], (block[k] + 1) * BLOCK - 1)
                if first <= last:
                    v = x[p] * scale[k] + shift[k] if np.isfinite(scale[k]) else x[p]
                    lo.append(int(first)), hi.append(int(last)), gs.append(k), values.append(float(x[p]))
                    rest.append(bool(kind[k] == RESTING and (abs(v) < 1e-9 or x[p] == 0)))
        emit(RUN, np.array(gs, np.int64), lo=lo, hi=hi, measure=values, rest=rest)
    return out


def _block_analysis(layout: DataFrame, source: DataFrame) -> DataFrame:
    """Runs ``_analyse`` over the laid-out rows of ``source``, a bounded number of rows at a time."""
    schema = layout.sparkSession.createDataFrame([], _OUT).schema
    fields = schema.names
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    arrow = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            result = _analyse(table, fields)
            if result and result["file"]:
                yield from pa.table({f.name: pa.array(result[f.name], f.type) for f in arrow}, schema=arrow).to_batches()

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= _BATCH_ROWS:
                table = pa.Table.from_batches(held)
                h, i = table.column("h").to_numpy(), table.column("i").to_numpy()
                other = np.flatnonzero((h != h[-1]) | (i != i[-1]))
                cut = other[-1] + 1 if len(other) else 0
                if cut:
                    yield from done(table.slice(0, cut))
                    table = table.slice(cut)
                held, rows = table.to_batches(), table.num_rows
        if held:
            yield from done(pa.Table.from_batches(held))

    ordered = spread(layout, source, "h", "i").sortWithinPartitions("h", "i", "position", "mark")
    return ordered.mapInArrow(run, schema)


def merged_spreads(sketches: DataFrame) -> DataFrame:
    """(file, channel_id, hour, hour_spread, channel_spread): half the interquartile range of the deviations of an hour and of the whole channel.

    ``sketches``: file, channel_id, hour, weight and points, any number for each
    hour.  All points meet in classes of size, at most 2 % wide; their weights are
    summed where they are before anything is moved, so that a channel is as many
    rows as its hours have classes, however many blocks it has.
    """
    channel = ["file", "channel_id"]
    each = sketches.where("points is not null").select(*channel, "hour", "weight", F.explode("points").alias("point"))
    size = (F.signum("point") * (F.floor(F.log(F.abs("point")) * CLASSES) + 1000 * CLASSES)).cast("int")
    classes = each.groupBy(*channel, "hour", size.alias("size")).agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("point")).alias("total"))
    classes = classes.repartition(*channel)
    ranked = classes.select(*channel, "hour", "size", (F.col("total") / F.col("weight")).alias("mean"), *[c for name, keys in (("h", [*channel, "hour"]), ("c", channel)) for c in _running(name, keys)])
    quartile = lambda name, k: F.min(F.when(4 * F.col(f"upto_{name}") >= k * F.col(f"whole_{name}"), F.struct("size", "mean")))
    hours = ranked.groupBy(*channel, "hour").agg(*[quartile(name, k).alias(f"{name}{k}") for name in "hc" for k in (1, 3)])
    least = lambda c: F.min(c).over(Window.partitionBy(*channel))["mean"]
    return hours.select(*channel, "hour", ((F.col("h3.mean") - F.col("h1.mean")) / 2).alias("hour_spread"), ((least("c3") - least("c1")) / 2).alias("channel_spread"))


def _running(name: str, keys: list[str]) -> list[Column]:
    """Running and whole weight of the classes of ``keys``, in the order of size."""
    of = Window.partitionBy(*keys)
    return [F.sum("weight").over(of.orderBy("size", "hour").rowsBetween(Window.unboundedPreceding, 0)).alias(f"upto_{name}"), F.sum("weight").over(of).alias(f"whole_{name}")]


def find_faults(samples: DataFrame, chunks: DataFrame, channels: DataFrame, unit_defs: DataFrame, channel_rules: DataFrame, channel_limits: DataFrame) -> DataFrame:
    """(file, channel_id, sample_index, fault): the implausible stored samples with finite value.

    ``fault`` is ``limit`` (outside the physical range of the quantity), ``spike``
    (one to three samples beyond the expanded interquartile fence of the local
    deviation, with the course resumed after them) or ``stuck`` (a run of at least
    eight samples of one value in a channel that otherwise changes at nearly every
    sample; speeds and pedals at rest on zero or on their end stop, channels of
    coarse resolution and discrete quantities excepted).  A sample may have several.

    The fence of a sample is the largest of that of its channel, half that of its
    channel in this hour of the recording (both from sketches merged over all
    blocks, whatever their number) and half that of its surroundings, the part of
    the hour within its block of 16,384 stored samples.

    NULL, NaN and infinite values are no faults and do not interrupt a run; rows
    with a NULL key or time are left out; repeated rows count once; empty tables
    give an empty result; extra columns are ignored.  A channel without chunk rows
    counts as one chunk, one without definition has no limits.
    """
    heads = channel_heads(channels, unit_defs, channel_rules, channel_limits)
    found = materialise(_block_analysis(_layout(samples, chunks, heads), samples), "faults")
    channel = ["file", "channel_id"]
    stats = found.where(F.col("what") == STATS)
    spikes = found.where(F.col("what") == SPIKE).select(*channel, "hour", "lo", "hi", "measure", "spread", "lattice", "width", "s_all").join(merged_spreads(stats.select(*channel, "hour", "weight", "points")), [*channel, "hour"], "left")
    fence = F.when(F.col("lattice"), F.when((F.col("width") >= 2) & (F.col("s_all") == 0), LATTICE_WIDE_FENCE).otherwise(LATTICE_FENCE)).otherwise(FENCE)
    scatter = F.greatest(F.coalesce("channel_spread", F.lit(0.0)), F.coalesce("hour_spread", F.lit(0.0)) / 2, F.col("spread") / 2)
    spikes = spikes.where(F.col("measure") > fence * SIGMA * scatter)
    total = stats.groupBy(*channel).agg(*[F.sum(c).alias(c) for c in ("n", "moves", "changes", "held")], F.max(F.nanvl("most", F.lit(None))).alias("most"), F.max("kind").alias("channel_kind"))
    lively = total.where((F.col("changes") >= LIVELY * F.col("moves")) & (F.col("n") - F.col("held") >= F.least(F.lit(OUTSIDE), 0.3 * F.col("n"))))
    runs = found.where(F.col("what") == RUN).select(*channel, "lo", "hi", "measure", "rest").join(lively, channel)
    stuck = runs.where(~(F.col("rest") | ((F.col("channel_kind") == RESTING) & (F.col("measure") >= F.col("most")))))
    judged = spikes.select(*channel, "lo", "hi", F.lit("spike").alias("fault")).unionByName(stuck.select(*channel, "lo", "hi", F.lit("stuck").alias("fault")))
    limits = found.where(F.col("what") == LIMIT).select(*channel, "lo", "hi", F.lit("limit").alias("fault"))
    return limits.unionByName(judged).select(*channel, F.explode(F.sequence("lo", "hi")).alias("sample_index"), "fault").distinct()
