"""Checks of tables: each gives its violations as rows, so an empty result is a pass."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outside_domain(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Values outside ``allowed``, null included, with their number of rows."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(allowed)).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def inconsistent(df: DataFrame, key: str, column: str) -> DataFrame:
    """Keys with more than one non-null value."""
    grouped = df.groupBy(key).agg(F.min(column).alias("lowest"), F.max(column).alias("highest"))
    return grouped.where("lowest <> highest")


def too_few(df: DataFrame, column: str, need: int) -> DataFrame:
    """Values with fewer than ``need`` rows."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") < need)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys of ``expected`` that ``found`` lacks."""
    return expected.select(key).distinct().join(found.select(key), key, "left_anti")


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side."""
    left = missing(a, b, key).withColumn("side", F.lit("left"))
    return left.unionByName(missing(b, a, key).withColumn("side", F.lit("right")))


def misplaced(a: DataFrame, b: DataFrame, places: list[str], left: str, right: str) -> DataFrame:
    """Places at which two ordered lists, given as rows with their place, don't hold the same value, or only one has any."""
    return a.join(b, places, "full").where(~F.col(left).eqNullSafe(F.col(right)))


def signature_differences(stored: str, current: dict) -> list[str]:
    """Names whose values differ between a stored JSON signature and the current one."""
    old = json.loads(stored)
    return sorted(k for k in old.keys() | current.keys() if old.get(k, object()) != current.get(k, object()))


def require_positive(**values: int) -> None:
    """Raise on an argument that isn't above 0."""
    for name, value in values.items():
        if not value > 0:
            raise ValueError(f"{name} must be positive, not {value}")


def require_share(**values: float) -> None:
    """Raise on an argument outside (0, 1)."""
    for name, value in values.items():
        if not 0 < value < 1:
            raise ValueError(f"{name} must lie between 0 and 1, not {value}")
