"""Channel layouts that drift along the files of a logger."""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.operators.unit_resolution import resolve_units
from tracegrid.runtime import broadcast_if_small, columns_named, materialise

#: file_seq values that share a task when the files of one logger are put in order.
SEQ_BLOCK = 4096

#: Keys of a comparison, what is compared, and the condition under which the rest of two layouts meets by channel_id.
PAIR, FIELDS = ["logger_id", "file", "previous"], ["channel_id", "name", "unit_source", "data_type"]
BY_ID = "new_channel_id is not null and old_channel_id is not null and not apart"


def _previous_file(files: DataFrame) -> DataFrame:
    """(logger_id, file, file_seq, previous): each file with the one before it.

    Ordered in blocks of file_seq, so that a logger with any number of files
    never meets in one task; the first file of a block takes the last one of the
    block before.
    """
    f = columns_named(files, "file", "logger_id", "file_seq").dropna().groupBy("logger_id", "file").agg(F.min("file_seq").alias("file_seq"))
    f = f.withColumn("block", F.expr(f"file_seq div {SEQ_BLOCK}"))
    inside = Window.partitionBy("logger_id", "block").orderBy("file_seq", "file")
    f = f.withColumn("inner", F.lag("file").over(inside))
    ends = f.groupBy("logger_id", "block").agg(F.max(F.struct("file_seq", "file")).alias("end"))
    ends = ends.withColumn("before", F.lag("end.file").over(Window.partitionBy("logger_id").orderBy("block"))).select("logger_id", "block", "before")
    return f.join(ends, ["logger_id", "block"]).select("logger_id", "file", "file_seq", F.coalesce("inner", "before").alias("previous"))


def layouts(channels: DataFrame, unit_defs: DataFrame, channel_rules: DataFrame, channel_limits: DataFrame) -> DataFrame:
    """One row per channel definition with its base name, dimension and the file's layout fingerprint."""
    c = columns_named(channels, "file", "channel_id", "name", "unit", "unit_source", "data_type").dropna(subset=["file", "channel_id"]).dropDuplicates(["file", "channel_id"])
    r = F.col("resolved")
    c = resolve_units(c, unit_defs, channel_rules, channel_limits)
    # The same base name may stand twice in a file; the n-th of the one file then meets the n-th of the other.
    twin = Window.partitionBy("file", "base_name").orderBy("channel_id")
    return c.select("file", "channel_id", "name", "unit_source", "data_type", r.base_name.alias("base_name"), r.dimension.alias("dimension")).withColumn("twin", F.row_number().over(twin))


def fingerprints(layout: DataFrame) -> DataFrame:
    """(file, fingerprint): an order-free hash of all channel definitions of a file, the version of its schema."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "channel_id", "name", "unit_source", "data_type", "dimension").cast("decimal(38,0)"))
    return layout.groupBy("file").agg(F.concat_ws(":", F.count(F.lit(1)), h(1), h(2)).alias("fingerprint"))


def _compared(layout: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The layouts of consecutive files side by side: what meets by name, and what of the rest has one channel_id.

    ``new_`` and ``old_`` columns of both sides; NULL on the side where there is
    no counterpart.  Rows of the second with both sides and without ``apart`` meet by id.
    """
    prints = fingerprints(layout)
    pairs = order.where("previous is not null")
    pairs = (
        pairs.join(prints, "file", "left")
        .join(prints.select(F.col("file").alias("previous"), F.col("fingerprint").alias("old_fingerprint")), "previous", "left")
        .where(~F.col("fingerprint").eqNullSafe(F.col("old_fingerprint")))
        .select("logger_id", "file", "previous")
    )
    pairs = materialise(pairs, "layout-pairs")
    fields = [*FIELDS, "base_name", "dimension", "twin"]
    side = lambda p: layout.select(F.col("file").alias(f"{p}_file"), *[F.col(x).alias(f"{p}_{x}") for x in fields])
    new = pairs.join(side("new"), F.col("file") == F.col("new_file")).drop("new_file")
    old = pairs.join(side("old"), F.col("previous") == F.col("old_file")).drop("old_file")
    key = PAIR
    a, b = new.withColumnsRenamed({"new_base_name": "base_name", "new_twin": "twin"}), old.withColumnsRenamed({"old_base_name": "base_name", "old_twin": "twin"})
    by_name = materialise(a.join(b, [*key, "base_name", "twin"], "full"), "layout-names")
    both = by_name.where("new_channel_id is not null and old_channel_id is not null")
    rest_new = by_name.where("old_channel_id is null").select(*key, *[f"new_{x}" for x in fields[:4]], "new_dimension", F.col("base_name").alias("new_base_name"), F.col("twin").alias("new_twin"), F.col("new_channel_id").alias("id"))
    rest_old = by_name.where("new_channel_id is null").select(*key, *[f"old_{x}" for x in fields[:4]], "old_dimension", F.col("base_name").alias("old_base_name"), F.col("twin").alias("old_twin"), F.col("old_channel_id").alias("id"))
    by_id = rest_new.join(rest_old, [*key, "id"], "full")
    return both, by_id.withColumn("apart", F.coalesce(F.col("new_dimension") != F.col("old_dimension"), F.lit(False)))


def layout_changes(channels: DataFrame, source_files: DataFrame, unit_defs: DataFrame, channel_rules: DataFrame, channel_limits: DataFrame) -> DataFrame:
    """(logger_id, file, previous, channel_id, change, old, new): every change between consecutive files of a logger.

    Files whose fingerprints agree are not compared.  Channels are the same if
    their base names (without unit text, case, blanks and punctuation) agree; of
    the rest, those with equal channel_id, unless both dimensions are known and
    differ.  ``change`` is added, removed, renamed, retyped or unit_source; ``old``
    and ``new`` are the texts concerned.  ``channel_id`` is that of the later file,
    for ``removed`` that of the earlier one.

    A file without channel definitions has the empty layout; files with a NULL
    logger_id or file_seq have no place in an order and are left out, as are
    definitions with a NULL key; NULL texts compare as equal to NULL only;
    repeated rows count once; empty tables give an empty result.
    """
    layout = materialise(layouts(channels, unit_defs, channel_rules, channel_limits), "layouts")
    both, by_id = _compared(layout, _previous_file(source_files))
    key, cells = PAIR, [*PAIR, *[f"{p}_{x}" for p in ("new", "old") for x in FIELDS]]
    matched = by_id.where(BY_ID).select(*cells).unionByName(both.select(*cells))
    unmatched = by_id.where(f"not ({BY_ID})")
    change = lambda df, cond, cid, what, o, n: df.where(cond).select(*key, F.col(cid).alias("channel_id"), F.lit(what).alias("change"), F.col(o).alias("old") if o else F.lit(None).cast("string").alias("old"), F.col(n).alias("new") if n else F.lit(None).cast("string").alias("new"))
    differs = lambda x: ~F.col(f"new_{x}").eqNullSafe(F.col(f"old_{x}"))
    parts = [
        change(unmatched, F.col("new_channel_id").isNotNull(), "new_channel_id", "added", None, "new_name"),
        change(unmatched, F.col("old_channel_id").isNotNull(), "old_channel_id", "removed", "old_name", None),
        change(matched, differs("name"), "new_channel_id", "renamed", "old_name", "new_name"),
        change(matched, differs("data_type"), "new_channel_id", "retyped", "old_data_type", "new_data_type"),
        change(matched, differs("unit_source"), "new_channel_id", "unit_source", "old_unit_source", "new_unit_source"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _columns(layout: DataFrame, order: DataFrame) -> DataFrame:
    """(logger_id, file, channel_id, column_name): the column each definition belongs to over the files of its logger.

    A definition continues the one it is the same as in the file before (see
    ``layout_changes``), under whatever name, and one that is new continues the
    channel that last left under its name.  So a channel runs along one name from
    rename to rename; the runs that a rename by id joins are chained by pointer
    doubling, as often as the logarithm of the longest chain asks.

    The column is called after the first name of its chain.  Where several chains
    of a logger begin with one name, the second has ``_2`` after it and so on.
    """
    _, by_id = _compared(layout, order)
    renames = materialise(by_id.where(BY_ID).select("logger_id", "file", "new_channel_id", "previous", "old_channel_id"), "renames")
    into = renames.select("logger_id", "file", F.col("new_channel_id").alias("channel_id"), F.lit(True).alias("into"))
    away = renames.select("logger_id", F.col("previous").alias("file"), F.col("old_channel_id").alias("channel_id"), F.lit(True).alias("away")).distinct()
    d = layout.select("file", "channel_id", "base_name", "twin").join(order.select("logger_id", "file", "file_seq"), "file")
    d = d.join(into, ["logger_id", "file", "channel_id"], "left").join(away, ["logger_id", "file", "channel_id"], "left")
    # A run begins with the definition renamed to its name (0) or after the one renamed to another (1).
    mark = lambda flag, kind: F.when(F.col(flag), F.struct(F.col("file_seq").alias("seq"), F.col("file").alias("file"), F.lit(kind).alias("kind")))
    d = d.withColumns({"block": F.expr(f"file_seq div {SEQ_BLOCK}"), "into": mark("into", 0), "away": mark("away", 1)})
    name = ["logger_id", "base_name", "twin"]
    inside = Window.partitionBy(*name, "block").orderBy("file_seq", "file")
    ends = d.groupBy(*name, "block").agg(F.max(F.greatest("into", "away")).alias("end"))
    before = Window.partitionBy(*name).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.max("end").over(before)).drop("end")
    d = d.withColumn("inner", F.greatest(F.max("into").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.max("away").over(inside.rowsBetween(Window.unboundedPreceding, -1))))
    start = F.struct(F.lit(-(1 << 63)).cast("bigint").alias("seq"), F.lit("").alias("file"), F.lit(1).alias("kind"))
    d = d.join(ends, [*name, "block"]).withColumn("run", F.struct("base_name", "twin", F.coalesce("inner", "before", start).alias("since")))
    runs = materialise(d.select("logger_id", "file", "file_seq", "channel_id", "run"), "runs")
    run_of = lambda cid, file, what: runs.select("logger_id", F.col("file").alias(file), F.col("channel_id").alias(cid), F.col("run").alias(what))
    steps = renames.join(run_of("new_channel_id", "file", "run"), ["logger_id", "file", "new_channel_id"]).join(run_of("old_channel_id", "previous", "first"), ["logger_id", "previous", "old_channel_id"])
    steps = materialise(steps.select("logger_id", "run", "first"), "rename-steps")
    while True:
        ahead = steps.select("logger_id", F.col("run").alias("first"), F.col("first").alias("further"))
        steps = steps.select("logger_id", "run", "first").join(ahead, ["logger_id", "first"], "left")
        steps = materialise(steps.select("logger_id", "run", F.coalesce("further", "first").alias("first"), F.col("further").isNotNull().alias("moved")), "rename-steps")
        if not steps.where("moved").limit(1).count():
            break
    chained = runs.join(steps.select("logger_id", "run", "first"), ["logger_id", "run"], "left").withColumn("first", F.coalesce("first", "run"))
    names = chained.groupBy("logger_id", "first").agg(F.min(F.struct("file_seq", "file", F.col("run.twin").alias("twin"))).alias("at"))
    nth = F.row_number().over(Window.partitionBy("logger_id", "first.base_name").orderBy("at"))
    names = names.withColumn("nth", nth).withColumn("column_name", F.when(F.col("nth") == 1, F.col("first.base_name")).otherwise(F.concat_ws("_", "first.base_name", "nth")))
    return chained.join(names.select("logger_id", "first", "column_name"), ["logger_id", "first"]).select("logger_id", "file", "channel_id", "column_name")


#: Storage types by kind and bits; the common type of several is the narrowest that holds every value of each.
TYPES = {"uint8": ("u", 8), "int8": ("i", 8), "uint16": ("u", 16), "int16": ("i", 16), "uint32": ("u", 32), "int32": ("i", 32), "float32": ("f", 24), "float64": ("f", 53)}
_SIGNED, _EXACT = ((8, "int8"), (16, "int16"), (32, "int32")), ((24, "float32"), (53, "float64"))


def common_type(types: list[str]) -> str:
    """The narrowest storage type that holds every value of all ``types``; float64 if one is unknown."""
    if len(set(types)) == 1:
        return types[0]
    if not set(types) <= set(TYPES):
        return "float64"
    kinds = [TYPES[t] for t in types]
    # Bits of an integer type without sign, of one with it, and of a float (its whole numbers).
    if all(k == "u" for k, _ in kinds):
        return f"uint{max(b for _, b in kinds)}"
    if all(k != "f" for k, _ in kinds):
        needed = max(b if k == "i" else b + 1 for k, b in kinds)
        return next((name for bits, name in _SIGNED if bits >= needed), "float64")
    needed = max(b - 1 if k == "i" else b for k, b in kinds)
    return next(name for bits, name in _EXACT if bits >= needed)


def _common(types: Column) -> Column:
    """``common_type`` of a sorted array of type names, by a constant table over all sets of known types."""
    names = sorted(TYPES)
    table = {",".join(c): common_type(list(c)) for n in range(1, len(names) + 1) for c in combinations(names, n)}
    book = F.from_json(F.lit(json.dumps(table)), "map<string,string>")
    return F.when(F.size(types) == 1, types[0]).otherwise(F.coalesce(F.try_element_at(book, F.array_join(types, ",")), F.lit("float64")))


def versions(layout: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((logger_id, file, version), (logger_id, version, since)): the distinct layouts of each logger, numbered by first use."""
    prints = fingerprints(layout).join(order, "file")
    first = prints.groupBy("logger_id", "fingerprint").agg(F.min("file_seq").alias("since"))
    numbered = first.withColumn("version", F.row_number().over(Window.partitionBy("logger_id").orderBy("since", "fingerprint")))
    return prints.join(numbered, ["logger_id", "fingerprint"]).select("logger_id", "file", "version"), numbered.select("logger_id", "version", "since")


def migration_steps(channels: DataFrame, source_files: DataFrame, unit_defs: DataFrame, channel_rules: DataFrame, channel_limits: DataFrame) -> DataFrame:
    """(logger_id, from_version, to_version, column_name, step, old, new, files): what leads from one layout of a logger to the next.

    One row per change that the files with this pair of versions, one after the
    other, have in common: ``rename``, ``cast`` (data_type), ``default``
    (unit_source), ``add`` or ``drop``; ``column_name`` is the column of
    ``consistent_channels``, ``files`` counts where the step was taken.
    """
    layout = materialise(layouts(channels, unit_defs, channel_rules, channel_limits), "layouts")
    order = materialise(_previous_file(source_files), "file-order")
    numbers, _ = versions(layout, order)
    numbers = materialise(numbers, "versions")
    of = lambda file, name: numbers.select("logger_id", F.col("file").alias(file), F.col("version").alias(name))
    changes = layout_changes(channels, source_files, unit_defs, channel_rules, channel_limits)
    # A channel that is gone has its column in the file before.
    place = F.when(F.col("change") == "removed", F.col("previous")).otherwise(F.col("file"))
    named = changes.withColumn("place", place).join(_columns(layout, order).select("logger_id", F.col("file").alias("place"), "channel_id", "column_name"), ["logger_id", "place", "channel_id"])
    named = named.join(of("file", "to_version"), ["logger_id", "file"], "left").join(of("previous", "from_version"), ["logger_id", "previous"], "left")
    steps = {"renamed": "rename", "retyped": "cast", "unit_source": "default", "added": "add", "removed": "drop"}
    step = F.try_element_at(F.create_map(*[F.lit(x) for kv in steps.items() for x in kv]), F.col("change"))
    return named.groupBy("logger_id", "from_version", "to_version", "column_name", step.alias("step"), "old", "new").agg(F.count_distinct("file").alias("files"))


def consistent_channels(channels: DataFrame, source_files: DataFrame, unit_defs: DataFrame, channel_rules: DataFrame, channel_limits: DataFrame) -> DataFrame:
    """One consistent table over all files, each definition routed through rename, default and cast rules.

    (logger_id, file, channel_id, column_name, name, data_type, common_type,
    unit_source, version): ``column_name`` is the base name the channel had
    first, carried through every later rename, ``common_type`` the narrowest type
    that holds every value of the types the column has over the logger's files,
    ``unit_source`` defaults to ``unknown``, ``version`` numbers the logger's
    distinct layouts by first use.

    A NULL data_type does not count towards the common type; a column of no other
    is float64.  Files with a NULL logger_id or file_seq and definitions with a
    NULL key are left out; repeated rows count once; empty tables give an empty
    result.
    """
    layout = materialise(layouts(channels, unit_defs, channel_rules, channel_limits), "layouts")
    order = materialise(_previous_file(source_files), "file-order")
    numbers, _ = versions(layout, order)
    rows = layout.join(numbers, "file").join(_columns(layout, order), ["logger_id", "file", "channel_id"])
    # A column has as many types as the storage formats know.
    kinds = rows.groupBy("logger_id", "column_name").agg(F.array_sort(F.collect_set("data_type")).alias("types"))
    kinds = kinds.select("logger_id", "column_name", F.when(F.size("types") == 0, "float64").otherwise(_common(F.col("types"))).alias("common_type"))
    return rows.join(kinds, ["logger_id", "column_name"]).select("logger_id", "file", "channel_id", "column_name", "name", "data_type", "common_type", F.coalesce(F.nullif("unit_source", F.lit("")), F.lit("unknown")).alias("unit_source"), "version")


def consistent_samples(samples: DataFrame, consistent: DataFrame) -> DataFrame:
    """(logger_id, file, column_name, sample_index, time_ns, value): samples under the columns of ``consistent_channels``, cast to their types.

    A value that the common type cannot hold (whole numbers only, or single
    precision) is rounded to it, one beyond its range is NULL; samples of
    definitions that the table lacks are left out.  The definitions are broadcast
    only if counted small, else both sides are shuffled by file and channel.
    """
    c = consistent.select("logger_id", "file", "channel_id", "column_name", "common_type").distinct()
    s = columns_named(samples, "file", "channel_id", "sample_index", "time_ns", "value")
    x, kind = F.col("value"), F.col("common_type")
    bits = F.regexp_extract(kind, r"(\d+)$", 1).try_cast("int")
    whole = F.round(x, 0)
    low = F.when(kind.startswith("u"), F.lit(0.0)).otherwise(-F.pow(F.lit(2.0), bits - 1))
    high = F.when(kind.startswith("u"), F.pow(F.lit(2.0), bits)).otherwise(F.pow(F.lit(2.0), bits - 1)) - 1
    cast = F.when(kind == "float32", x.cast("float").cast("double")).when(kind.rlike("^u?int"), F.when(whole.between(low, high), whole)).otherwise(x)
    return s.join(broadcast_if_small(c), ["file", "channel_id"]).select("logger_id", "file", "column_name", "sample_index", "time_ns", cast.alias("value"))
