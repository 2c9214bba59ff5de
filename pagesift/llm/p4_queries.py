"""Problem 4: samples of listed pages in the shares of sample_targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.ids import BLANKS, long_page_number, page_number
from pagesift.llm.target_sample import target_sample
from pagesift.plans.joins import broadcast_if_small
from pagesift.sources.tables import table


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Page numbers (one beyond 64 bits by a negative hash) with the one label and the one lang that their rows agree on."""
    lang = F.lower(F.btrim("lang", F.lit(BLANKS)))
    rows = table(spark, folder, "test_1000_balanced_seed42").where("filename IS NOT NULL")
    long = -F.shiftrightunsigned(F.xxhash64(long_page_number(F.col("filename"))), 1) - 1
    page = F.coalesce(page_number(F.col("filename")), F.when(long_page_number(F.col("filename")).isNotNull(), long))
    rows = rows.select(page.alias("page"), "label", lang.alias("lang")).where("page IS NOT NULL")
    agreed = rows.groupBy("page").agg(
        F.min("label").alias("label"), F.max("label").alias("label_max"), F.min("lang").alias("lang"), F.max("lang").alias("lang_max")
    )
    return agreed.where("label = label_max AND lang = lang_max").select("page", "label", "lang")


def targets(spark: SparkSession, folder: str) -> DataFrame:
    """Targets of every sample with its size and seed."""
    manifest = table(spark, folder, "sample_manifest_1000_seed42").select("sample_id", F.col("per_class").alias("size"), "seed")
    wanted = table(spark, folder, "sample_targets").select(
        "sample_id", "label", F.lower(F.btrim("lang", F.lit(BLANKS))).alias("lang"), "share", F.col("min_pages").alias("min_rows")
    )
    return wanted.join(broadcast_if_small(manifest), "sample_id")  # a row per sample


def _sample(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return target_sample(
        pages(spark, folder), "page", targets(spark, folder), sample="sample_id", stratum="label", categories=["lang"], seed="seed"
    )


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (sample_id, label, lang): targets with fewer pages than wanted."""
    return _sample(spark, folder)[1].where("gap > 0").select("sample_id", "label", "lang")


def drawn(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn pages: sample_id, label, lang, page."""
    return _sample(spark, folder)[0]


def report(spark: SparkSession, folder: str) -> DataFrame:
    """Every target with wanted, available, provisional, drawn, gap, residual and the share reached."""
    rows = _sample(spark, folder)[1]
    return rows.withColumns({c: F.round(c, 6) for c in ("share", "share_drawn")})


def gaps(spark: SparkSession, folder: str) -> DataFrame:
    """What of the report doesn't depend on the draw: wanted, available and gap of every target, and the rows drawn per class."""
    rows = report(spark, folder)
    whole = rows.groupBy("sample_id", "label").agg(F.sum("drawn").alias("drawn_of_label"))
    return rows.select("sample_id", "label", "lang", "wanted", "available", "gap").join(whole, ["sample_id", "label"])


QUERIES = {"p4_found": found, "p4_drawn": drawn, "p4_report": report, "p4_gaps": gaps}
_HAVE = r"""
WITH listed AS (
  SELECT CAST(nullif(regexp_replace(regexp_replace(regexp_replace(filename, '^.*[/\\]', ''), '\.[^.]*$', ''), '[^0-9]', '', 'g'), '') AS BIGINT) AS page,
         label, lower(trim(lang)) AS lang
  FROM test_1000_balanced_seed42 WHERE filename IS NOT NULL),
pages AS (
  SELECT page, min(label) AS label, min(lang) AS lang FROM listed WHERE page IS NOT NULL GROUP BY page
  HAVING count(DISTINCT label) = 1 AND count(DISTINCT lang) = 1),
have AS (SELECT label, lang, count(*) AS n FROM pages GROUP BY label, lang)
"""
SQL = {
    "p4_found": _HAVE
    + """
SELECT t.sample_id, t.label, lower(trim(t.lang)) AS lang
FROM sample_targets t JOIN sample_manifest_1000_seed42 m USING (sample_id)
LEFT JOIN have h ON h.label = t.label AND h.lang = lower(trim(t.lang))
WHERE coalesce(h.n, 0) < greatest(floor(t.share * m.per_class + 0.5 + 1e-9), t.min_pages)""",
    "p4_gaps": _HAVE
    + """
, t AS (SELECT t.sample_id, t.label, lower(trim(t.lang)) AS lang, m.per_class, CAST(greatest(floor(t.share * m.per_class + 0.5 + 1e-9), t.min_pages) AS BIGINT) AS wanted, t.min_pages, coalesce(h.n, 0) AS available
  FROM sample_targets t JOIN sample_manifest_1000_seed42 m USING (sample_id) LEFT JOIN have h ON h.label = t.label AND h.lang = lower(trim(t.lang))),
l AS (SELECT sample_id, label, CAST(least(sum(available), greatest(max(per_class), sum(least(min_pages, available)))) AS BIGINT) AS drawn_of_label FROM t GROUP BY sample_id, label)
SELECT sample_id, label, lang, wanted, available, greatest(wanted - available, 0) AS gap, drawn_of_label FROM t JOIN l USING (sample_id, label)""",
}
