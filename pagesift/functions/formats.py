"""Sizes and durations as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bytes_text(n: Column) -> Column:
    """Bytes in the largest binary unit that leaves one or more, with two decimals."""
    out = F.format_string("%d B", n.cast("long"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        out = F.when(n >= 1024**power, F.format_string(f"%.2f {unit}", n / float(1024**power))).otherwise(out)
    return out


def duration_text(seconds: Column) -> Column:
    """Whole seconds as h:mm:ss."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
