"""Exact quantiles of groups of any size, by selection instead of sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.model import finite
from tracegrid.runtime import materialise

#: Buckets a group is cut into in one round (a power of two), and values of one bucket that are put in order.
BUCKETS, SORTED = 64, 1 << 20


def _select(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """(keys, at, value): the value at each place ``at`` (keys, at; from 1) of its group in order."""
    by = [F.col(f"`{k}`") for k in keys]
    bounds = rows.groupBy(*by).agg(F.percentile_approx("value", [(i + 1) / BUCKETS for i in range(BUCKETS - 1)], 1000).alias("__bounds"))
    steps = BUCKETS.bit_length() - 1
    bucket = F.expr(f"aggregate(sequence(1, {steps}), 0, (at, i) -> if(element_at(__bounds, at + shiftright({BUCKETS}, i)) < value, at + shiftright({BUCKETS}, i), at))")
    cut = materialise(rows.join(bounds, keys).withColumn("__bucket", bucket).drop("__bounds"), "quantile-buckets")
    upto = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"), F.min("value").alias("__low"), F.max("value").alias("__high"))
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0)))
    hit = wanted.join(sizes, keys).where("at > __before and at <= __before + __n")
    hit = materialise(hit.withColumn("__in", F.col("at") - F.col("__before")), "quantile-places")
    done = hit.where("__low = __high").select(*by, "at", F.col("__low").alias("value"))
    open_ = hit.where("__low < __high")
    inner = [*keys, "__bucket"]
    left = cut.join(open_.select(*inner).distinct(), inner, "left_semi")
    places = open_.select(*inner, "at", "__in")
    if (open_.agg(F.max("__n")).first()[0] or 0) <= SORTED:
        ranked = left.withColumn("__in", F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in inner]).orderBy("value")).cast("bigint"))
        return done.unionByName(ranked.join(places, [*inner, "__in"]).select(*by, "at", "value"))
    renamed = {"__bucket": f"__bucket{len(keys)}"}
    deeper = _select(left.withColumnsRenamed(renamed), [*keys, *renamed.values()], places.withColumnsRenamed(renamed).drop("at").withColumnRenamed("__in", "at"))
    back = deeper.withColumnRenamed("at", "__in").join(places.withColumnsRenamed(renamed), [*keys, *renamed.values(), "__in"])
    return done.unionByName(back.select(*by, "at", "value"))


def exact_quantiles(values: DataFrame, keys: list[str], ranks: tuple[float, ...], discrete: bool = False) -> DataFrame:
    """(keys, n, quantiles): the exact quantiles of the finite values of each group, in the order of ``ranks``.

    Linear between the two neighbouring values, or with ``discrete`` the value
    itself.  Each round cuts the groups into buckets by a sketch, counts them and
    keeps those in which a wanted place falls, until these are small enough to put
    in order; a bucket of one value needs no order.  No group is brought together.

    Values that are NULL, NaN or infinite and rows with a NULL key do not count;
    groups without values have no row.
    """
    v = values.where(finite(F.col("value"))).select(*[F.col(f"`{k}`") for k in keys], "value").dropna()
    by = [F.col(f"`{k}`") for k in keys]
    n = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    if discrete:
        place = [F.greatest(F.lit(1), F.col("n") - F.floor(F.col("n") - F.lit(q) * F.col("n"))).cast("bigint") for q in ranks]
        pairs = [(p, p, F.lit(0.0)) for p in place]
    else:
        exact = [(F.col("n") - 1) * F.lit(q) for q in ranks]
        pairs = [((F.floor(x) + 1).cast("bigint"), (F.ceil(x) + 1).cast("bigint"), x - F.floor(x)) for x in exact]
    places = n.select(*by, "n", F.array(*[F.struct(F.lit(i).alias("i"), a.alias("a"), b.alias("b"), w.alias("w")) for i, (a, b, w) in enumerate(pairs)]).alias("p"))
    places = places.select(*by, "n", F.explode("p").alias("p")).select(*by, "n", "p.*")
    wanted = places.select(*by, F.explode(F.array("a", "b")).alias("at")).distinct()
    found = materialise(_select(v, keys, wanted), "quantile-values")
    side = lambda at, name: found.select(*by, F.col("at").alias(at), F.col("value").alias(name))
    both = places.join(side("a", "lo"), [*keys, "a"]).join(side("b", "hi"), [*keys, "b"])
    value = F.when(F.col("w") == 0, F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w"))
    g = both.groupBy(*by, "n").agg(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))).alias("q"))
    return g.select(*by, "n", F.transform("q", lambda x: x["v"]).alias("quantiles"))
