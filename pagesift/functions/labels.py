"""Labels in free-form model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_label(text: Column) -> Column:
    """1 (phishing) or 0 (benign) if every whole-word mention agrees, in any case; null otherwise."""
    named = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(benign|phishing)\b"), F.lit(1)), F.upper))
    return F.when(F.size(named) == 1, (named[0] == "PHISHING").cast("int"))


def label_with_retry(first: Column, retry: Column) -> Column:
    """The first answer's label; the retry's where the first has none."""
    return F.coalesce(parse_label(first), parse_label(retry))
