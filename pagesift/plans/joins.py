"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is, for a join by exchange."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
