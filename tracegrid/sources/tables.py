"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory``, one Parquet file or folder each."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
