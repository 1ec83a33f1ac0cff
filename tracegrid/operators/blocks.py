"""Windows over series of any length: blocks in parallel, one carried row per block.

A window partitioned by file and channel alone puts a whole channel into one
task.  The forms here partition by the block of a series as well; what crosses
from block to block goes through a table with one row per block, whose windows
are shorter by the size of a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.runtime import materialise

#: Stored samples that share a block.
BLOCK = 1 << 14
#: Stretch of time that shares a block: at most three million samples at the highest rate.
SPAN_NS = 600_000_000_000


def index_block(column: str = "sample_index") -> Column:
    return F.expr(f"{column} div {BLOCK}")


def time_block(column: str = "time_ns") -> Column:
    return F.expr(f"{column} div {SPAN_NS}")


def stored_once(samples: DataFrame) -> DataFrame:
    """``samples`` (file, channel_id, sample_index, ...) with each stored reading once, though delivered several times.

    Deliveries of one reading are equal in key and content, so any of them stands
    for it.  Rows without sample_index are kept as they are.
    """
    place = F.coalesce(index_block(), -1 - F.pmod(F.xxhash64(*[c for c, t in samples.dtypes if t == "double"], F.lit(0)), F.lit(4096)))
    key = ["file", "channel_id", place]
    order = Window.partitionBy("__h", "__i").orderBy("sample_index")
    s = samples.withColumns({"__h": F.xxhash64(*key), "__i": F.hash(*key)}).withColumn("__before", F.lag("sample_index").over(order))
    return s.where(~F.col("__before").eqNullSafe(F.col("sample_index")) | F.col("sample_index").isNull()).drop("__h", "__i", "__before")


def along(
    df: DataFrame, keys: list[str], order: list[str], block: Column, before: list[str] | None = None, after: list[str] | None = None, number: str | None = None,
    latest: dict[str, Column] | None = None, upcoming: dict[str, Column] | None = None, sums: dict[str, Column] | None = None,
) -> DataFrame:
    """``df`` plus what each row takes from its series (``keys``, in ``order``) around it.

    ``before`` and ``after``: a struct of these columns of the row before or after
    (NULL at the ends); ``number``: the place of the row, from 1; ``latest`` and
    ``upcoming``: the last value that is not NULL up to the row, the first from it
    on; ``sums``: running sums up to the row.

    ``block`` must not fall along ``order``.  Windows cover a block; a table with
    one row per block carries the rest, and meets the rows in a join on the keys
    by which the windows have placed them.  Rows with a NULL key are left out.
    """
    latest, upcoming, sums = latest or {}, upcoming or {}, sums or {}
    values = {f"__v{i}": c for i, c in enumerate([*latest.values(), *upcoming.values(), *sums.values()])}
    of = dict(zip([*latest, *upcoming, *sums], values, strict=True))
    d = df.where(" and ".join(f"`{k}` is not null" for k in keys)).withColumns({"__b": block, **values})
    place, whole = F.struct(*order), [*keys, "__b"]
    inside = Window.partitionBy(*whole).orderBy(*order)
    upto, onwards = inside.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*whole).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("__b")
    earlier, later = across.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys).orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    row, block_row, carried, made = {}, {}, {}, {}
    if before:
        row["__p"], block_row["__last"], carried["__cp"] = F.lag(F.struct(*before)).over(inside), F.max_by(F.struct(*before), place), F.lag("__last").over(across)
        made["before"] = F.coalesce("__p", "__cp")
    if after:
        row["__n"], block_row["__first"], carried["__cn"] = F.lead(F.struct(*after)).over(inside), F.min_by(F.struct(*after), place), F.lead("__first").over(across)
        made["after"] = F.coalesce("__n", "__cn")
    if number:
        row["__i"], block_row["__k"], carried["__ck"] = F.row_number().over(inside), F.count(F.lit(1)), F.sum("__k").over(earlier)
        made[number] = F.coalesce("__ck", F.lit(0)) + F.col("__i")
    for name in latest:
        v = of[name]
        row[f"{v}w"], block_row[f"{v}e"], carried[f"{v}c"] = F.last(v, ignorenulls=True).over(upto), F.max_by(v, F.when(F.col(v).isNotNull(), place)), F.last(f"{v}e", ignorenulls=True).over(earlier)
        made[name] = F.coalesce(f"{v}w", f"{v}c")
    for name in upcoming:
        v = of[name]
        row[f"{v}w"], block_row[f"{v}e"], carried[f"{v}c"] = F.last(v, ignorenulls=True).over(onwards), F.min_by(v, F.when(F.col(v).isNotNull(), place)), F.last(f"{v}e", ignorenulls=True).over(later)
        made[name] = F.coalesce(f"{v}w", f"{v}c")
    for name in sums:
        v = of[name]
        row[f"{v}w"], block_row[f"{v}e"], carried[f"{v}c"] = F.sum(v).over(upto), F.sum(v), F.sum(f"{v}e").over(earlier)
        made[name] = F.coalesce(f"{v}w", F.lit(0)) + F.coalesce(f"{v}c", F.lit(0))
    table = d.groupBy(*whole).agg(*[c.alias(n) for n, c in block_row.items()]).withColumns(carried).select(*whole, *carried)
    return d.withColumns(row).join(table, whole).select(*[F.col(f"`{c}`") for c in df.columns if c not in made], *[c.alias(n) for n, c in made.items()])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` plus ``name``, the place of each row from 0 in one order over all rows.

    Rows are dealt to partitions by range; places are counted within them and
    follow the counts of the partitions before.
    """
    part = materialise(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    sizes = part.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy("__part").orderBy(*order)
    return part.withColumn("__at", F.row_number().over(inside) - 1).join(F.broadcast(sizes), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")
