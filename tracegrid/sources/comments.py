"""Column comments and unit payloads that survive in a catalog or a Parquet footer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_comments(channels: DataFrame, table: str) -> DataFrame:
    """(column_name, unit, ddl, kv_metadata, channel_map_rule): one row per distinct channel name, the first file's wins.

    ``channels``: file, channel_id, name, unit and, if known, frequency_hz and
    sample_period_ns.
    """
    extra = [c for c in ("frequency_hz", "sample_period_ns") if c in channels.columns]
    c = channels.groupBy(F.lower("name").alias("k")).agg(F.min(F.struct("file", "channel_id", "name", "unit", *extra)).alias("c")).select("c.*")
    unit = F.coalesce("unit", F.lit(""))
    payload = F.concat(F.lit("unit="), unit)
    if len(extra) == 2:
        clock = F.concat(F.lit("; native_frequency_hz="), F.regexp_replace(F.col("frequency_hz").cast("string"), r"\.0$", ""), F.lit("; native_sample_period_ns="), F.col("sample_period_ns").cast("string"))
        payload = F.concat(payload, F.coalesce(clock, F.lit("")))
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    ddl = F.concat(F.lit("COMMENT ON COLUMN "), quoted(F.lit(table)), F.lit("."), quoted(F.col("name")), F.lit(" IS '"), F.replace(payload, F.lit("'"), F.lit("''")), F.lit("'"))
    rule = F.concat("name", F.lit(" -> "), "name", F.when(unit != "", F.concat(F.lit(" ["), unit, F.lit("]"))).otherwise(""))
    return c.select(F.col("name").alias("column_name"), unit.alias("unit"), ddl.alias("ddl"), payload.alias("kv_metadata"), rule.alias("channel_map_rule"))


def comment_columns(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """``df`` with comments in the column metadata, which ``saveAsTable`` and Parquet keep."""
    for name, text in comments.items():
        df = df.withMetadata(name, {**df.schema[name].metadata, "comment": text})
    return df
