"""Percentiles of very large columns from merging centroid digests.

A digest is a short list of centroids (mean, weight) whose sizes follow a
quantile-dependent size function: fine at the tails, coarse in the middle.
Digests of partitions, files or days merge by re-clustering, so that partial
results combine into the result of the whole.  A second pass over the values
counts ranks exactly and certifies the error of every reported percentile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.operators.blocks import index_block
from tracegrid.runtime import columns_named, materialise, spread

#: A digest has at most about this many centroids, whatever the number of values.
COMPRESSION = 200
PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Values or centroids that one clustering step looks at.
SLICE = 1 << 19
#: Digests of one key that meet in the first level of a merge, by salt.
SALTS = 32
#: Sorted values that one row of a block holds.
PART = 512

DIGEST = "n bigint, least double, most double, means array<double>, weights array<double>"
_HASHES = ["__h", "__i"]


def size_function(q: np.ndarray, delta: float) -> np.ndarray:
    """k(q): a centroid may span one unit of it, so its weight grows with q (1 - q)."""
    return delta / np.pi * (np.arcsin(np.clip(2 * q - 1, -1, 1)) + np.pi / 2)


def cluster(means: np.ndarray, weights: np.ndarray, group: np.ndarray, delta: float = COMPRESSION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, mean, weight) of the new centroids of many groups at once.

    Rows come sorted by group and mean; a row joins the cluster of that unit of
    the size function in which the middle of its ranks falls.
    """
    if not len(means):
        return group, means, weights
    first = np.r_[True, group[1:] != group[:-1]]
    start = np.flatnonzero(first)
    code = np.cumsum(first) - 1
    total = np.add.reduceat(weights, start)
    upto = np.cumsum(weights)
    before = upto - weights - (upto[start] - weights[start])[code]
    unit = np.floor(size_function((before + weights / 2) / total[code], delta)).astype(np.int64)
    # The first and the last row of a group stay alone.
    last = np.r_[first[1:], True]
    fresh = first | last | np.r_[True, (unit[1:] != unit[:-1]) | first[:-1]]
    at = np.flatnonzero(fresh)
    w = np.add.reduceat(weights, at)
    # Rounding must not move the mean of equal values off them.
    m = np.clip(np.add.reduceat(weights * means, at) / w, means[at], means[np.r_[at[1:], len(means)] - 1])
    return group[at], m, w


def quantile(means: np.ndarray, weights: np.ndarray, q: float, least: float, most: float) -> float:
    """The value at quantile q, linear between the middles of neighbouring centroids."""
    if not len(means):
        return float("nan")
    middle = np.cumsum(weights) - weights / 2
    return float(np.interp(q * weights.sum(), np.r_[0.0, middle, weights.sum()], np.r_[least, means, most]))


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name).combine_chunks()
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _step(table: pa.Table, keys: list[str], delta: float, merging: bool) -> Iterator[pa.RecordBatch]:
    """One clustering step over all rows of ``table``: one digest per key."""
    if not table.num_rows:
        return
    h, i = _column(table, "__h").to_numpy(), _column(table, "__i").to_numpy()
    row = np.arange(len(h))
    if merging:
        n, least, most = (_column(table, c).to_numpy(zero_copy_only=False) for c in ("n", "least", "most"))
        lists = _column(table, "means")
        m, w = lists.flatten().to_numpy(zero_copy_only=False), _column(table, "weights").flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(row, np.diff(lists.offsets.to_numpy()))
    else:
        m = _column(table, "value").to_numpy(zero_copy_only=False)
        n, least, most, w, owner = np.ones(len(m), np.int64), m, m, np.ones(len(m)), row
    by_key = np.lexsort((i, h))
    fresh = np.r_[True, (h[by_key][1:] != h[by_key][:-1]) | (i[by_key][1:] != i[by_key][:-1])]
    g = np.empty(len(h), np.int64)
    g[by_key] = np.cumsum(fresh) - 1
    first = by_key[fresh]
    by = np.lexsort((m, g[owner]))
    group, means, weights = cluster(m[by], w[by], g[owner][by], delta)
    total = np.bincount(g, weights=n, minlength=len(first)).astype(np.int64)
    low, high = np.full(len(first), np.inf), np.full(len(first), -np.inf)
    np.minimum.at(low, g, least)
    np.maximum.at(high, g, most)
    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(group, minlength=len(first)))].astype(np.int32))
    columns = {k: _column(table, k).take(pa.array(first)) for k in [*keys, *_HASHES]}
    columns |= {"n": pa.array(total), "least": pa.array(low), "most": pa.array(high), "means": pa.ListArray.from_arrays(offsets, pa.array(means)), "weights": pa.ListArray.from_arrays(offsets, pa.array(weights))}
    yield from pa.table(columns).to_batches(max_chunksize=5_000)


def _steps(batches: Iterator[pa.RecordBatch], keys: list[str], delta: float, merging: bool, whole_keys: bool) -> Iterator[pa.RecordBatch]:
    """Clustering steps over slices of bounded size; ``whole_keys``: rows are sorted, cut between keys only."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += len(b.column("means").flatten()) if merging else b.num_rows
        if size < SLICE:
            continue
        table = pa.Table.from_batches(held)
        cut = table.num_rows
        if whole_keys:
            h, i = _column(table, "__h").to_numpy(), _column(table, "__i").to_numpy()
            other = np.flatnonzero((h != h[-1]) | (i != i[-1]))
            cut = other[-1] + 1 if len(other) else 0
            if not cut:  # one key fills the slice: its digests become one, which goes on collecting
                table = pa.Table.from_batches(list(_step(table, keys, delta, merging))).select(table.column_names)
        yield from _step(table.slice(0, cut), keys, delta, merging)
        held = table.slice(cut).to_batches()
        size = sum(len(b.column("means").flatten()) if merging else b.num_rows for b in held)
    if held:
        yield from _step(pa.Table.from_batches(held), keys, delta, merging)


def _schema(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "__h bigint, __i int", DIGEST])


def _hashed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumns({"__h": F.xxhash64(*[F.col(f"`{k}`") for k in keys]), "__i": F.hash(*[F.col(f"`{k}`") for k in keys])})


def _counted(values: DataFrame, keys: list[str]) -> DataFrame:
    x = F.col("value")
    return columns_named(values, *keys, "value").where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def build_digests(values: DataFrame, keys: list[str], delta: float = COMPRESSION) -> DataFrame:
    """(keys..., n, least, most, means, weights): a digest per key and slice of each partition, without a shuffle.

    ``values`` has the keys and a double column ``value``; NULL, NaN and infinite
    values do not count.  ``merge_digests`` joins the digests of a key.
    """
    v = _hashed(_counted(values, keys), keys)
    return v.mapInArrow(lambda it: _steps(it, keys, delta, False, False), _schema(v, keys)).drop(*_HASHES)


def merge_digests(digests: DataFrame, keys: list[str], delta: float = COMPRESSION) -> DataFrame:
    """One digest per key from any number of digests, of partitions, files or days.

    Two levels: within salted parts of a key, then over those, so that the digests
    of a key that every partition holds never meet whole in one task.
    """
    d = _hashed(columns_named(digests, *keys, "n", "least", "most", "means", "weights"), keys)
    schema = _schema(d, keys)
    salted = d.repartition(*_HASHES, F.pmod(F.xxhash64("n", "least", "most", F.try_element_at("means", F.lit(2))), F.lit(SALTS)))
    first = salted.mapInArrow(lambda it: _steps(it, keys, delta, True, False), schema)
    last = first.repartition(*_HASHES).sortWithinPartitions(*_HASHES)
    return last.mapInArrow(lambda it: _steps(it, keys, delta, True, True), schema).drop(*_HASHES)


def read_percentiles(digests: DataFrame, keys: list[str], percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """(keys..., n, estimates, bounds): the percentiles of each digest, in the order asked for.

    ``bounds`` are stated before any counting: the largest share of ranks by which
    an estimate can be off, the weight of the two centroids it lies between.
    """
    kinds = dict(digests.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n bigint, estimates array<double>, bounds array<double>"])

    ranks = np.array(percentiles)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("means")
            m, w = lists.flatten().to_numpy(zero_copy_only=False), b.column("weights").flatten().to_numpy(zero_copy_only=False)
            at = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            least, most = b.column("least").to_numpy(zero_copy_only=False), b.column("most").to_numpy(zero_copy_only=False)
            es, bs = np.empty((b.num_rows, len(ranks))), np.empty((b.num_rows, len(ranks)))
            for r in range(b.num_rows):
                mine = w[at[r] : at[r + 1]]
                upto = np.cumsum(mine)
                total, middle = upto[-1], upto - mine / 2
                wanted = ranks * total
                k = np.searchsorted(middle, wanted)
                es[r] = np.interp(wanted, np.concatenate(([0.0], middle, [total])), np.concatenate(([least[r]], m[at[r] : at[r + 1]], [most[r]])))
                bs[r] = (mine[np.maximum(k - 1, 0)] + mine[np.minimum(k, len(mine) - 1)]) / total
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(ranks))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), b.column("n"), *(pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (es, bs))], names=[*keys, "n", "estimates", "bounds"])

    return columns_named(digests, *keys, "n", "least", "most", "means", "weights").mapInArrow(read, schema)


def _first_deliveries(table: pa.Table, last: tuple | None) -> tuple[pa.Table, tuple]:
    """Rows of ``table``, in the order of block and sample_index, without those that repeat the reading before; and the last reading."""
    h, i = _column(table, "__h").to_numpy(), _column(table, "__i").to_numpy()
    at = _column(table, "sample_index")
    known, at = at.is_valid().to_numpy(zero_copy_only=False), at.fill_null(0).to_numpy()
    again = np.r_[False, (h[1:] == h[:-1]) & (i[1:] == i[:-1]) & (at[1:] == at[:-1])] & known
    again[0] = bool(known[0]) and (h[0], i[0], at[0]) == last
    return table.filter(pa.array(~again)), (h[-1], i[-1], at[-1])


def sorted_blocks(values: DataFrame, keys: list[str], delta: float = COMPRESSION, delivered: bool = False) -> DataFrame:
    """(keys..., block, n, least, most, means, weights, part): ``values`` in sorted blocks with a digest each, without a shuffle.

    A block holds the values of one key in a slice of a partition.  Its first row
    has the digest; the others (``means`` NULL) its values in order, ``PART`` to a
    row, so that a key of any size is many rows.  Meant to be written once: the
    digests and, later, the counting pass read what they need of it.

    ``delivered``: the rows come from ``in_order`` and a reading that stands more
    than once counts once.
    """
    v = values if delivered else _hashed(_counted(values, keys), keys)
    kinds = dict(v.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "block bigint", DIGEST, "part array<double>"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, last = 0, None
        first_id = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []
        rows = 0

        def blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal made, last
            if delivered:
                table, last = _first_deliveries(table, last)
            if not table.num_rows:
                return
            h, i, x = (_column(table, c).to_numpy(zero_copy_only=False) for c in ("__h", "__i", "value"))
            by = np.lexsort((x, i, h))
            h, i, x = h[by], i[by], x[by]
            start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (i[1:] != i[:-1])])
            stop = np.r_[start[1:], len(x)]
            group = np.repeat(np.arange(len(start)), stop - start)
            where, means, weights = cluster(x, np.ones(len(x)), group, delta)
            inside = np.arange(len(x)) - start[group]
            cut = np.flatnonzero(inside % PART == 0)
            owner, m, k = group[cut], len(cut), len(start)
            block = first_id + made + np.arange(k)
            made += k
            who = np.r_[by[start], by[start][owner]]
            offsets = lambda sizes: pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            digest = offsets(np.bincount(where, minlength=k))
            none = pa.nulls(m, pa.list_(pa.float64()))
            wide = lambda a, kind: pa.concat_arrays([pa.array(a), pa.nulls(m, kind)])
            columns = {c: _column(table, c).take(pa.array(who)) for c in keys}
            columns |= {
                "block": pa.array(np.r_[block, block[owner]]), "n": wide(stop - start, pa.int64()), "least": wide(x[start], pa.float64()), "most": wide(x[stop - 1], pa.float64()),
                "means": pa.concat_arrays([pa.ListArray.from_arrays(digest, pa.array(means)), none]), "weights": pa.concat_arrays([pa.ListArray.from_arrays(digest, pa.array(weights)), none]),
                "part": pa.concat_arrays([pa.nulls(k, pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(np.r_[cut, len(x)].astype(np.int32)), pa.array(x))]),
            }
            yield from pa.table(columns).to_batches(max_chunksize=5_000)

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= SLICE:
                yield from blocks(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from blocks(pa.Table.from_batches(held))

    return v.mapInArrow(make, schema)


def count_below(blocks: DataFrame, cuts: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys..., b0.., u0..): for each key the values below and up to each of its ``width`` cuts (keys..., cuts).

    The cuts go to the blocks, not the values to the cuts: the list of blocks, one
    row each, meets the cuts of its key, and the values then meet the cuts of
    their block.  No key, however large, is brought together.
    """
    same = lambda a, b: [F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys]
    listed = blocks.where("means is not null").select(*keys, "block")
    marks = listed.alias("l").join(cuts.alias("c"), same("l", "c")).select(*[F.col(f"l.`{k}`").alias(k) for k in keys], "l.block", "c.cuts")
    parts = blocks.where("part is not null").select("block", "part").join(marks, "block").select(*keys, "part", "cuts")
    names = [*(f"b{j}" for j in range(width)), *(f"u{j}" for j in range(width))]
    kinds = dict(parts.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{c} bigint" for c in names)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("part")
            x, at = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            c = b.column("cuts").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            found = np.empty((len(c), 2 * width), np.int64)
            for r in range(len(c)):
                v = x[at[r] : at[r + 1]]
                found[r, :width], found[r, width:] = v.searchsorted(c[r]), v.searchsorted(c[r], "right")
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *(pa.array(np.ascontiguousarray(found[:, j])) for j in range(2 * width))], names=[*keys, *names])

    return parts.mapInArrow(count, schema).groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*[F.sum(c).alias(c) for c in names])


def certify(read: DataFrame, tally: DataFrame, keys: list[str], percentiles: tuple[float, ...] = PERCENTILES, first: int = 0) -> DataFrame:
    """(keys..., n, percentile, estimate, bound, rank_error): the estimates of ``read`` with their exact rank error.

    ``tally`` counts for each key the values below (``b``) and up to (``u``) each
    estimate, whose columns begin at ``first``.  ``rank_error`` is the distance, as
    a share of n, from the wanted rank to the nearest rank that the estimate has
    among the values (0 where ties cover it).
    """
    both = read.alias("r").join(tally.alias("t"), [F.col(f"r.`{k}`").eqNullSafe(F.col(f"t.`{k}`")) for k in keys])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.get("r.estimates", F.lit(j)).alias("e"), F.get("r.bounds", F.lit(j)).alias("b"), F.col(f"b{first + j}").alias("below"), F.col(f"u{first + j}").alias("upto")) for j, p in enumerate(percentiles)]))
    out = both.select(*[F.col(f"r.`{k}`").alias(k) for k in keys], F.col("r.n").alias("n"), each.alias("x"))
    wanted = F.col("x.p") * F.col("n")
    off = F.greatest(F.col("x.below") - wanted, wanted - F.col("x.upto"), F.lit(0.0)) / F.col("n")
    return out.select(*keys, "n", F.col("x.p").alias("percentile"), F.col("x.e").alias("estimate"), F.col("x.b").alias("bound"), off.alias("rank_error"))


def certified_percentiles(values: DataFrame, keys: list[str], percentiles: tuple[float, ...] = PERCENTILES, delta: float = COMPRESSION) -> DataFrame:
    """Percentiles per group with a bound stated beforehand and the exact rank error counted afterwards.

    NULL, NaN and infinite values do not count and a group of nothing else has no
    rows; a NULL key is a group of its own; every row of ``values`` is a value of
    its own; an empty table gives an empty result; extra columns are ignored.
    """
    blocks = materialise(sorted_blocks(values, keys, delta), "sorted-blocks")
    read = materialise(read_percentiles(merge_digests(blocks.where("means is not null"), keys, delta), keys, percentiles), "percentiles")
    return certify(read, count_below(blocks, read.select(*keys, F.col("estimates").alias("cuts")), keys, len(percentiles)), keys, percentiles)


def in_order(samples: DataFrame, *keep: str) -> DataFrame:
    """(keep..., sample_index, value, __h, __i): readings with a finite value in the order of their blocks of stored samples, ``keep`` equal in a block.

    Deliveries of one reading lie next to each other.  Rows without sample_index
    are dealt out by their value.
    """
    s = _counted(samples, [*dict.fromkeys([*keep, "file", "channel_id", "sample_index"])])
    place = F.coalesce(index_block(), -1 - F.pmod(F.xxhash64("value"), F.lit(4096)))
    block = [*dict.fromkeys([*keep, "file", "channel_id"]), place]
    s = s.withColumns({"__h": F.xxhash64(*block), "__i": F.hash(*block)}).select(*keep, "sample_index", "value", "__h", "__i")
    return spread(s, samples, "__h", "__i").sortWithinPartitions("__h", "__i", "sample_index")


def telemetry_percentiles(samples: DataFrame, days: DataFrame, percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """(grouping, channel, file, day, n, percentile, estimate, bound, rank_error) for the three groupings of sample values.

    Digests are built once, per block of file and channel; those of a channel and
    those of a day of recording (``days``: file, day) come from merging them.  One
    counting pass certifies all three: the cuts of a file and channel are its own,
    those of its channel and those of its day, and the counts of a channel or day
    are sums.  Recordings whose day is unknown form the day NULL.  A reading
    delivered twice counts once.
    """
    fine, k = ["file", "channel"], len(percentiles)
    blocks = materialise(sorted_blocks(in_order(samples, *fine), fine, delivered=True), "sorted-blocks")
    digests = materialise(merge_digests(blocks.where("means is not null"), fine), "digests")
    day = columns_named(days, "file", "day").where("file is not null").groupBy("file").agg(F.min("day").alias("day"))
    groupings = {"file_channel": (fine, digests), "channel": (["channel"], merge_digests(digests, ["channel"])), "day": (["day"], merge_digests(digests.join(day, "file", "left"), ["day"]))}
    shown = lambda keys: [(F.col(c) if c in keys else F.lit(None)).cast("string").alias(c) for c in ("channel", "file", "day")]
    reads = None
    for name, (keys, d) in groupings.items():
        r = read_percentiles(d, keys, percentiles).select(F.lit(name).alias("grouping"), *shown(keys), "n", "estimates", "bounds")
        reads = r if reads is None else reads.unionByName(r)
    reads = materialise(reads, "percentiles")
    read = {name: reads.where(F.col("grouping") == name).select(*keys, "n", "estimates", "bounds") for name, (keys, _) in groupings.items()}
    placed = read["file_channel"].select(*fine, F.col("estimates").alias("e1")).join(day, "file", "left").alias("f")
    cuts = placed.join(read["channel"].alias("c"), F.col("f.channel").eqNullSafe(F.col("c.channel"))).join(read["day"].alias("d"), F.col("f.day").eqNullSafe(F.col("d.day")))
    cuts = cuts.select("f.file", "f.channel", F.concat("f.e1", "c.estimates", "d.estimates").alias("cuts"))
    tally = materialise(count_below(blocks, cuts, fine, 3 * k), "tallies")
    parts = []
    for at, (name, (keys, _)) in enumerate(groupings.items()):
        t = tally.join(day, "file", "left") if "day" in keys else tally
        t = t.groupBy(*keys).agg(*[F.sum(f"{c}{j}").alias(f"{c}{j}") for c in "bu" for j in range(at * k, at * k + k)])
        out = certify(read[name], t, keys, percentiles, at * k)
        parts.append(out.select(F.lit(name).alias("grouping"), *shown(keys), "n", "percentile", "estimate", "bound", "rank_error"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
