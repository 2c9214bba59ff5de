"""Identifiers of pages and chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\u00a0"


def page_id(filename: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the file name exactly as written."""
    return F.substring(F.sha1(filename.cast("binary")), 1, 16)


def clean_id(column: Column) -> Column:
    """A page id as compared: lower case, without outer blanks."""
    return F.lower(F.btrim(column, F.lit(BLANKS)))


def _digits(filename: Column) -> Column:
    name = F.regexp_replace(filename, r"^.*[/\\]", "")
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.regexp_replace(stem, r"[^0-9]", "")


def page_number(filename: Column) -> Column:
    """Digits of the file name's stem as a number; null where the stem has none, or a number beyond 64 bits (see ``long_page_number``)."""
    digits = _digits(filename)
    return F.when(F.length(digits) > 0, digits.try_cast("bigint"))


def long_page_number(filename: Column) -> Column:
    """A page number beyond 64 bits as its digits, without leading zeros; null for any other name."""
    digits = F.regexp_replace(_digits(filename), "^0+", "")
    return F.when((F.length(digits) >= 19) & digits.try_cast("bigint").isNull(), digits)


def chunk_id(filename: Column, index: Column) -> Column:
    """File id, underscore, chunk index."""
    return F.concat_ws("_", page_id(filename), index.cast("string"))


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by ':'; the same in any SQL engine."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
