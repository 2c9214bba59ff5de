"""Loaders of the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; filters and column choices reach the scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
