"""Which unit a channel was recorded in, and its values in the base unit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.functions.unit_text import Unit, UnitBook, differs_from_base, squeeze
from tracegrid.runtime import bounded_rows, broadcast_if_small, columns_named

#: Largest size accepted for each of the three reference tables.
REFERENCE_ROWS = 20_000

RESOLVED = (
    "quantity string, base_name string, unit string, dimension string, base_unit string, evidence string,"
    " to_base_scale double, to_base_offset double, convertible boolean, differs boolean, low double, high double, is_step boolean"
)


def unit_book(unit_defs: DataFrame, channel_rules: DataFrame, channel_limits: DataFrame) -> tuple[UnitBook, dict]:
    """The three reference tables as a look-up object; their sizes are checked.

    Rows without a key (NULL unit, source or quantity) are ignored; of several
    rules for one source the one with the lowest rule_id counts.
    """
    units, aliases = {}, {}
    cols = ("unit", "dimension", "base_unit", "to_base_factor", "to_base_offset", "is_convertible", "aliases")
    for r in sorted(filter(lambda r: r[0], bounded_rows(columns_named(unit_defs, *cols), REFERENCE_ROWS, "unit_defs")), key=lambda r: r[0]):
        units.setdefault(r[0], Unit(r[0], r[1], r[2], r[3] if r[3] is not None else 1.0, r[4] or 0.0, bool(r[5])))
        aliases.setdefault(r[0], [a for a in (r[6] or []) if a])
    rules: dict = {}
    cols = ("source", "target", "unit", "scale", "value_offset", "rule_id")
    for r in sorted(filter(lambda r: r[0], bounded_rows(columns_named(channel_rules, *cols), REFERENCE_ROWS, "channel_rules")), key=lambda r: (r[5] is None, r[5])):
        rules.setdefault(r[0].strip().lower(), (r[1] or None, r[2] or None, 1.0 if r[3] is None else r[3], r[4] or 0.0))
    quantities: dict = {}
    limits: dict = {}
    cols = ("quantity", "dimension", "low", "high", "is_step")
    for r in sorted(filter(lambda r: r[0], bounded_rows(columns_named(channel_limits, *cols), REFERENCE_ROWS, "channel_limits")), key=lambda r: r[0]):
        quantities.setdefault(squeeze(r[0]), (r[0], r[1]))
        limits.setdefault(squeeze(r[0]), (r[2], r[3], bool(r[4]), r[1]))
    return UnitBook(list(units.values()), aliases, rules, quantities), limits


def resolve_units(channels: DataFrame, unit_defs: DataFrame, channel_rules: DataFrame, channel_limits: DataFrame) -> DataFrame:
    """``channels`` plus a struct ``resolved`` with the unit really recorded.

    ``base = value * to_base_scale + to_base_offset``.  Evidence in this order:
    the unit of the rule for the full name, the unit text, the unit text at the
    end of the name.  One pass over the rows, no shuffle: the work is a
    dictionary look-up per row, and every text is parsed once per worker.

    NULL or empty names and units count as blank; a blank unit with no unit text
    in the name leaves ``resolved.unit`` NULL.  Rows are kept as they come, so
    repeated rows stay repeated and other columns are untouched.
    """
    book, limits = unit_book(unit_defs, channel_rules, channel_limits)

    @F.pandas_udf(RESOLVED)
    def resolved(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        memo: dict = {}

        def one(name: str | None, unit: str | None) -> tuple:
            quantity, e = book.resolve(name, unit)
            limit = limits.get(squeeze(quantity)) if quantity else None
            low, high, step, dim = limit or (None, None, None, None)
            if e is None:
                return (quantity, book.base_name(name), None, None, None, None, None, None, None, False, low, high, step)
            u = e.unit
            if dim is not None and dim != u.dimension:
                low = high = None
            return (quantity, book.base_name(name), u.unit, u.dimension, u.base_unit, e.source, e.scale * u.factor, e.shift * u.factor + u.offset, u.convertible, differs_from_base(e), low, high, step)

        names = [c.split()[0] for c in RESOLVED.split(",")]
        for name, unit in batches:
            rows = []
            for key in zip(name, unit, strict=True):
                key = tuple(k if isinstance(k, str) else None for k in key)
                if key not in memo:
                    memo[key] = one(*key)
                rows.append(memo[key])
            yield pd.DataFrame(rows, columns=names)

    return channels.withColumn("resolved", resolved(F.col("name"), F.col("unit")))


def recorded_units(channels: DataFrame, unit_defs: DataFrame, channel_rules: DataFrame, channel_limits: DataFrame) -> DataFrame:
    """(file, channel_id, unit) of the channel definitions that need conversion.

    A row whose file or channel_id is NULL names no definition and is left out;
    repeated rows count once; an empty table gives an empty result.
    """
    keys = columns_named(channels, "file", "channel_id", "name", "unit").dropna(subset=["file", "channel_id"])
    r = resolve_units(keys, unit_defs, channel_rules, channel_limits)
    return r.where("resolved.convertible and resolved.differs").select("file", "channel_id", F.col("resolved.unit").alias("unit")).distinct()


def in_base_units(samples: DataFrame, channels: DataFrame, unit_defs: DataFrame, channel_rules: DataFrame, channel_limits: DataFrame) -> DataFrame:
    """``samples`` plus ``base_value``, ``base_unit`` and ``dimension``; NULL where the unit is unknown or not convertible.

    One conversion per channel definition joins to its samples; the side of the
    conversions is broadcast only if counted small, else both sides are shuffled
    by file and channel and AQE splits the hot ones.  NULL and NaN values stay as
    they are; repeated rows of ``channels`` count once.
    """
    c = columns_named(channels, "file", "channel_id", "name", "unit").dropna(subset=["file", "channel_id"]).dropDuplicates(["file", "channel_id"])
    r = F.col("resolved")
    c = resolve_units(c, unit_defs, channel_rules, channel_limits).where("resolved.convertible")
    c = c.select("file", "channel_id", r.to_base_scale.alias("__scale"), r.to_base_offset.alias("__offset"), r.base_unit.alias("base_unit"), r.dimension.alias("dimension"))
    out = samples.drop("base_value", "base_unit", "dimension").join(broadcast_if_small(c), ["file", "channel_id"], "left")
    return out.withColumn("base_value", F.col("value") * F.col("__scale") + F.col("__offset")).drop("__scale", "__offset")


def base_unit_profile(samples: DataFrame, channels: DataFrame, unit_defs: DataFrame, channel_rules: DataFrame, channel_limits: DataFrame) -> DataFrame:
    """(file, channel_id, base_unit, n, low, high, mean): each channel's finite values in the base unit.

    The affine conversion commutes with minimum, maximum and mean, so the samples
    are aggregated before they meet the conversions and no row is joined.
    """
    x = F.col("value")
    s = columns_named(samples, "file", "channel_id", "sample_index", "value").where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # Repeated rows count once; the first level also spreads a hot channel.
    once = s.groupBy("file", "channel_id", "sample_index").agg(F.min("value").alias("value"))
    raw = once.groupBy("file", "channel_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"))
    c = columns_named(channels, "file", "channel_id", "name", "unit").dropDuplicates(["file", "channel_id"])
    c = resolve_units(c, unit_defs, channel_rules, channel_limits).where("resolved.convertible").select("file", "channel_id", "resolved")
    to = lambda v: F.col(v) * F.col("resolved.to_base_scale") + F.col("resolved.to_base_offset")
    return raw.join(c, ["file", "channel_id"]).select(
        "file", "channel_id", F.col("resolved.base_unit").alias("base_unit"), "n", F.least(to("lo"), to("hi")).alias("low"), F.greatest(to("lo"), to("hi")).alias("high"), to("mean").alias("mean")
    )
