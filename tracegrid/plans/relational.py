"""Registered queries of the relational forms that telemetry work uses: filters, joins, aggregates, windows, recipes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.model import finite
from tracegrid.operators.blocks import along, index_block, stored_once
from tracegrid.operators.quantiles import exact_quantiles
from tracegrid.plans.recordings import SQL as REC
from tracegrid.plans.recordings import samples
from tracegrid.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = ("WITH " + REC + "," if sql.lstrip().startswith(">") else "") + sql.lstrip().lstrip(">")
        return f

    return register


#: Each stored reading once: repeated deliveries differ in arrived_at only.
_ONCE = "smp AS (SELECT DISTINCT file, format, channel_id, channel, unit, unit_source, frequency_hz, sample_index, time_ns, value FROM telemetry_samples)"
_FINITE = "value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)"


def readings(spark: SparkSession, d: str) -> DataFrame:
    return stored_once(table(spark, d, "telemetry_samples").drop("arrived_at"))


def channels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "channels").distinct()


@query("SELECT file, channel_id, sample_index, time_ns, CASE WHEN NOT isnan(value) THEN value END AS value, coalesce(isnan(value), false) AS is_nan FROM telemetry_samples WHERE time_ns >= 1000000000 AND arrived_at < TIMESTAMP '2030-01-01'")
def samples_scan(spark, d):
    s = table(spark, d, "telemetry_samples").where((F.col("time_ns") >= 10**9) & (F.col("arrived_at") < F.lit("2030-01-01").cast("timestamp_ntz")))
    return s.select("file", "channel_id", "sample_index", "time_ns", F.nanvl("value", F.lit(None)).alias("value"), F.coalesce(F.isnan("value"), F.lit(False)).alias("is_nan"))


@query("SELECT file, format, count(*) AS definitions, count(*) FILTER (sample_count > 0) AS sampled, max(duration_ns) AS duration_ns FROM (SELECT DISTINCT * FROM channels) GROUP BY 1, 2")
def channel_metadata(spark, d):
    return channels(spark, d).groupBy("file", "format").agg(F.count(F.lit(1)).alias("definitions"), F.count_if(F.col("sample_count") > 0).alias("sampled"), F.max("duration_ns").alias("duration_ns"))


@query("SELECT DISTINCT name FROM channels WHERE regexp_full_match(name, '.*(Speed|SPEED|speed).*')")
def regex_filter(spark, d):
    return channels(spark, d).where(F.col("name").rlike("^(?:.*(Speed|SPEED|speed).*)$")).select("name").distinct()


@query("SELECT DISTINCT file, channel_id, name FROM channels WHERE (lower(name) LIKE '%temp%' OR unit IN ('C', 'K')) AND name NOT IN ('Oil Temp') AND frequency_hz IS NOT NULL")
def predicates(spark, d):
    c = channels(spark, d)
    return c.where((F.lower("name").like("%temp%") | F.col("unit").isin("C", "K")) & ~F.col("name").isin("Oil Temp") & F.col("frequency_hz").isNotNull()).select("file", "channel_id", "name").distinct()


@query("SELECT DISTINCT file, channel_id, CASE WHEN dimension IS NULL THEN 'unknown' WHEN dimension IN ('count', 'marker') THEN 'mark' ELSE 'measure' END AS kind FROM channels")
def case_when(spark, d):
    kind = F.when(F.col("dimension").isNull(), "unknown").when(F.col("dimension").isin("count", "marker"), "mark").otherwise("measure")
    return channels(spark, d).select("file", "channel_id", kind.alias("kind")).distinct()


@query(f"WITH {_ONCE} SELECT channel, count(*) AS n FROM smp WHERE {_FINITE} GROUP BY 1")
def finite_filter(spark, d):
    return readings(spark, d).where(finite(F.col("value"))).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT file, channel_id, name FROM (SELECT DISTINCT * FROM channels) WHERE coalesce(sample_count, 0) = 0")
def coverage(spark, d):
    return channels(spark, d).where(F.coalesce("sample_count", F.lit(0)) == 0).select("file", "channel_id", "name")


@query(f"WITH {_ONCE} SELECT c.file, c.channel_id, c.data_type, count(*) AS n, min(s.time_ns) AS first_ns, max(s.time_ns) AS last_ns FROM (SELECT DISTINCT file, channel_id, name, data_type FROM channels) c JOIN smp s ON s.file = c.file AND s.channel_id = c.channel_id AND s.channel = c.name GROUP BY 1, 2, 3")
def join_meta_samples(spark, d):
    # The samples are combined per channel before they meet the metadata.
    s = readings(spark, d).groupBy("file", "channel_id", "channel").agg(F.count(F.lit(1)).alias("n"), F.min("time_ns").alias("first_ns"), F.max("time_ns").alias("last_ns"))
    c = channels(spark, d).select("file", "channel_id", F.col("name").alias("channel"), "data_type").distinct()
    return c.join(s, ["file", "channel_id", "channel"]).select("file", "channel_id", "data_type", "n", "first_ns", "last_ns")


@query("SELECT c.file, c.channel_id, u.unit, u.base_unit, u.to_base_factor FROM (SELECT DISTINCT file, channel_id, canonical_unit FROM channels) c JOIN unit_defs u ON u.unit = c.canonical_unit")
def join_units(spark, d):
    c = channels(spark, d).select("file", "channel_id", "canonical_unit").distinct()
    u = table(spark, d, "unit_defs").select("unit", "base_unit", "to_base_factor")
    return c.join(F.broadcast(u), c.canonical_unit == u.unit).select("file", "channel_id", "unit", "base_unit", "to_base_factor")


@query("SELECT a.dimension, a.unit AS source, b.unit AS target, round(a.to_base_factor / b.to_base_factor, 9) AS ratio FROM unit_defs a JOIN unit_defs b ON a.dimension = b.dimension")
def join_same_dimension(spark, d):
    u = table(spark, d, "unit_defs")
    return u.alias("a").join(u.alias("b"), F.col("a.dimension") == F.col("b.dimension")).select(F.col("a.dimension").alias("dimension"), F.col("a.unit").alias("source"), F.col("b.unit").alias("target"), F.round(F.col("a.to_base_factor") / F.col("b.to_base_factor"), 9).alias("ratio"))


@query("SELECT a.unit AS source, b.unit AS target FROM unit_defs a JOIN unit_defs b ON a.dimension <> b.dimension")
def join_other_dimension(spark, d):
    u = table(spark, d, "unit_defs")
    return u.alias("a").join(F.broadcast(u.alias("b")), F.col("a.dimension") != F.col("b.dimension")).select(F.col("a.unit").alias("source"), F.col("b.unit").alias("target"))


@query("SELECT DISTINCT unit FROM channels c WHERE unit IS NOT NULL AND NOT EXISTS (SELECT 1 FROM unit_defs u WHERE u.unit = c.unit)")
def anti_unknown_units(spark, d):
    return channels(spark, d).where("unit is not null").select("unit").distinct().join(F.broadcast(table(spark, d, "unit_defs").select("unit")), "unit", "left_anti")


@query("SELECT DISTINCT file, channel_id, (SELECT min(base_unit) FROM unit_defs u WHERE u.unit = c.unit) AS base_unit FROM channels c")
def scalar_subquery(spark, d):
    # A correlated scalar subquery, which the optimiser turns into a left join with one row per unit.
    return spark.sql("SELECT DISTINCT file, channel_id, (SELECT min(base_unit) FROM {u} u WHERE u.unit = c.unit) AS base_unit FROM {c} c", u=table(spark, d, "unit_defs"), c=channels(spark, d))


@query("> q AS (SELECT 1) SELECT file, channel, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(sum(value), 4) AS total FROM smp GROUP BY 1, 2")
def channel_stats(spark, d):
    return samples(spark, d).groupBy("file", "channel").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 4).alias("total"))


@query("> q AS (SELECT 1) SELECT file, count(*) FILTER (channel = 'view') AS views, max(value) FILTER (channel = 'purchase' AND value > 10) AS top_purchase FROM smp GROUP BY 1")
def filtered_agg(spark, d):
    hit = (F.col("channel") == "purchase") & (F.col("value") > 10)
    return samples(spark, d).groupBy("file").agg(F.count_if(F.col("channel") == "view").alias("views"), F.max(F.when(hit, F.col("value"))).alias("top_purchase"))


@query("SELECT format, count(DISTINCT file) AS files, count(DISTINCT name) AS names, count(DISTINCT frequency_hz) AS rates FROM channels GROUP BY 1")
def distinct_counts(spark, d):
    return channels(spark, d).groupBy("format").agg(F.count_distinct("file").alias("files"), F.count_distinct("name").alias("names"), F.count_distinct("frequency_hz").alias("rates"))


@query("SELECT file, string_agg(name, '; ' ORDER BY channel_id) AS names FROM (SELECT DISTINCT file, channel_id, name FROM channels) GROUP BY 1")
def ordered_list(spark, d):
    # Channel lists are bounded by the file formats.
    c = channels(spark, d).select("file", "channel_id", "name").distinct()
    pairs = F.array_sort(F.collect_list(F.struct("channel_id", "name")))
    return c.groupBy("file").agg(F.array_join(F.transform(pairs, lambda x: x["name"]), "; ").alias("names"))


@query("SELECT format, string_agg(DISTINCT data_type, ',' ORDER BY data_type) AS types FROM channels GROUP BY 1")
def distinct_list(spark, d):
    return channels(spark, d).groupBy("format").agg(F.array_join(F.sort_array(F.collect_set("data_type")), ",").alias("types"))


@query("> q AS (SELECT 1) SELECT file, arg_max(time_ns, (value, -time_ns)) AS at_ns, max(value) AS top FROM smp WHERE channel = 'view' GROUP BY 1")
def top_speed(spark, d):
    g = samples(spark, d).where("channel = 'view'").groupBy("file").agg(F.max(F.struct("value", (-F.col("time_ns")).alias("t"))).alias("m"))
    return g.select("file", (-F.col("m.t")).alias("at_ns"), F.col("m.value").alias("top"))


@query("> q AS (SELECT 1) SELECT channel, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM smp GROUP BY 1")
def percentiles(spark, d):
    q = exact_quantiles(samples(spark, d), ["channel"], (0.05, 0.5, 0.95))
    return q.select("channel", *[F.round(F.get("quantiles", F.lit(i)), 6).alias(n) for i, n in enumerate(("p05", "p50", "p95"))])


@query("SELECT dimension, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 9) AS share FROM (SELECT DISTINCT * FROM channels) GROUP BY 1")
def share_of_total(spark, d):
    g = channels(spark, d).groupBy("dimension").agg(F.count(F.lit(1)).alias("n"))
    total = channels(spark, d).agg(F.count(F.lit(1))).scalar()
    return g.select("dimension", "n", F.round(100.0 * F.col("n") / total, 9).alias("share"))


@query(f"WITH {_ONCE} SELECT file, channel_id FROM smp WHERE {_FINITE} GROUP BY 1, 2 HAVING min(value) = max(value)")
def constant_channels(spark, d):
    g = readings(spark, d).where(finite(F.col("value"))).groupBy("file", "channel_id").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return g.where("a = b").select("file", "channel_id")


@query("SELECT frequency_hz, count(*) AS definitions, count(DISTINCT file) AS files FROM (SELECT DISTINCT * FROM channels) WHERE frequency_hz IS NOT NULL GROUP BY 1")
def rate_audit(spark, d):
    return channels(spark, d).where("frequency_hz is not null").groupBy("frequency_hz").agg(F.count(F.lit(1)).alias("definitions"), F.count_distinct("file").alias("files"))


@query("> q AS (SELECT 1) SELECT file, 'view' AS stat, max(value) AS value FROM smp WHERE channel = 'view' GROUP BY 1 UNION ALL SELECT file, 'count', count(*) FROM smp GROUP BY 1")
def union_all_stats(spark, d):
    s = samples(spark, d)
    a = s.where("channel = 'view'").groupBy("file").agg(F.max("value").alias("value")).select("file", F.lit("view").alias("stat"), "value")
    b = s.groupBy("file").agg(F.count(F.lit(1)).cast("double").alias("value")).select("file", F.lit("count").alias("stat"), "value")
    return a.unionByName(b)


@query("SELECT file, channel_id, n FROM (SELECT file, channel_id, count(*) AS n FROM telemetry_samples GROUP BY 1, 2) ORDER BY n DESC, file, channel_id LIMIT 20")
def topk_channels(spark, d):
    g = table(spark, d, "telemetry_samples").groupBy("file", "channel_id").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("n").desc(), "file", "channel_id").limit(20)


@query("> q AS (SELECT 1) SELECT file, CAST(floor(value / 20) AS BIGINT) AS gear, count(*) / 100.0 AS seconds FROM smp WHERE channel = 'view' GROUP BY 1, 2")
def gear_usage(spark, d):
    return samples(spark, d).where("channel = 'view'").groupBy("file", F.floor(F.col("value") / 20).cast("bigint").alias("gear")).agg((F.count(F.lit(1)) / 100.0).alias("seconds"))


@query("> w AS (SELECT file, time_ns // 1000000000 AS s, max(value) FILTER (channel = 'view') AS a, max(value) FILTER (channel = 'click') AS b FROM smp GROUP BY 1, 2) SELECT file, count(*) / 100.0 AS seconds FROM w WHERE a > 10 AND b > 10 GROUP BY 1")
def pedal_overlap(spark, d):
    w = samples(spark, d).groupBy("file", F.expr("time_ns div 1000000000").alias("s")).pivot("channel", ["view", "click"]).agg(F.max("value"))
    return w.where("view > 10 and click > 10").groupBy("file").agg((F.count(F.lit(1)) / 100.0).alias("seconds"))


@query("SELECT file, count(*) FILTER (sample_count > 0) AS recorded, count(*) FILTER (coalesce(sample_count, 0) = 0) AS empty, max(duration_ns) AS duration_ns, CAST(sum(sample_count) AS BIGINT) AS native_samples, max(frequency_hz) AS fastest, count(DISTINCT frequency_hz) AS rates FROM (SELECT DISTINCT * FROM channels) GROUP BY 1")
def run_cards(spark, d):
    n = F.coalesce("sample_count", F.lit(0))
    return channels(spark, d).groupBy("file").agg(
        F.count_if(n > 0).alias("recorded"), F.count_if(n == 0).alias("empty"), F.max("duration_ns").alias("duration_ns"), F.sum("sample_count").alias("native_samples"), F.max("frequency_hz").alias("fastest"), F.count_distinct("frequency_hz").alias("rates")
    )


@query("SELECT unit, canonical_unit, dimension, count(*) AS n FROM (SELECT DISTINCT * FROM channels) GROUP BY ALL")
def unit_inventory(spark, d):
    return spark.sql("SELECT unit, canonical_unit, dimension, count(*) AS n FROM {c} GROUP BY ALL", c=channels(spark, d))


@query("SELECT count(*) AS definitions, count(canonical_unit) AS known, round(100.0 * count(canonical_unit) / count(*), 9) AS share FROM (SELECT DISTINCT * FROM channels)")
def verify_coverage(spark, d):
    return channels(spark, d).agg(F.count(F.lit(1)).alias("definitions"), F.count("canonical_unit").alias("known"), F.round(100.0 * F.count("canonical_unit") / F.count(F.lit(1)), 9).alias("share"))


@query(f"WITH {_ONCE} SELECT c.dimension, count(*) AS n, min(s.value * u.to_base_factor + u.to_base_offset) AS low FROM smp s JOIN (SELECT DISTINCT file, channel_id, canonical_unit, dimension FROM channels) c ON s.file = c.file AND s.channel_id = c.channel_id JOIN unit_defs u ON u.unit = c.canonical_unit WHERE {_FINITE} AND abs(value) < 1e5 GROUP BY 1")
def verify_envelopes(spark, d):
    v = F.col("value")
    s = readings(spark, d).where(finite(v) & (F.abs(v) < 1e5)).groupBy("file", "channel_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"))
    c = channels(spark, d).select("file", "channel_id", "canonical_unit", "dimension").distinct()
    u = table(spark, d, "unit_defs").select(F.col("unit").alias("canonical_unit"), "to_base_factor", "to_base_offset")
    # Every factor is positive, so the least value stays the least.
    return s.join(c, ["file", "channel_id"]).join(F.broadcast(u), "canonical_unit").groupBy("dimension").agg(F.sum("n").alias("n"), F.min(F.col("lo") * F.col("to_base_factor") + F.col("to_base_offset")).alias("low"))


@query("SELECT a.unit AS source, b.unit AS target FROM unit_defs a JOIN unit_defs b ON a.dimension = b.dimension WHERE abs(((((7.0 * a.to_base_factor + a.to_base_offset - b.to_base_offset) / b.to_base_factor) * b.to_base_factor + b.to_base_offset) - a.to_base_offset) / a.to_base_factor - 7.0) < 1e-6")
def verify_round_trip(spark, d):
    u = table(spark, d, "unit_defs")
    a, b = u.alias("a"), u.alias("b")
    there = (F.lit(7.0) * F.col("a.to_base_factor") + F.col("a.to_base_offset") - F.col("b.to_base_offset")) / F.col("b.to_base_factor")
    back = (there * F.col("b.to_base_factor") + F.col("b.to_base_offset") - F.col("a.to_base_offset")) / F.col("a.to_base_factor")
    return a.join(b, F.col("a.dimension") == F.col("b.dimension")).where(F.abs(back - 7.0) < 1e-6).select(F.col("a.unit").alias("source"), F.col("b.unit").alias("target"))


@query("> q AS (SELECT 1) SELECT channel, count(*) AS n, count(DISTINCT file) AS files, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS spread FROM smp GROUP BY 1")
def stats_tool_raw(spark, d):
    return samples(spark, d).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("spread"))


@query("> o AS (SELECT *, row_number() OVER (PARTITION BY file, channel ORDER BY time_ns) AS position, lag(value) OVER (PARTITION BY file, channel ORDER BY time_ns) AS before, count(*) OVER (PARTITION BY file, channel) AS total FROM smp) SELECT file, channel, sample_index, position, before, total FROM o")
def window_forms(spark, d):
    key = ["file", "channel"]
    s = samples(spark, d)
    o = along(s, key, ["sample_index"], index_block(), before=["value"], number="position")
    return o.join(s.groupBy(*key).agg(F.count(F.lit(1)).alias("total")), key).select(*key, "sample_index", F.col("position").cast("bigint").alias("position"), F.col("before.value").alias("before"), "total")


@query("SELECT n_name AS nation, r_name AS region, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def star_join(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("SELECT o_orderpriority AS priority, year(o_orderdate) AS year, count(*) AS orders, count(DISTINCT o_custkey) AS customers, max(o_totalprice) AS dearest FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1, 2")
def semi_join(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")  # noqa: E741
    big = l.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(big, "o_orderkey", "left_semi").groupBy(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.max("o_totalprice").alias("dearest"))
