"""Problem 1: the top_k hits of every predicted page, for each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.ids import clean_id
from pagesift.llm.top_n import top_n_per_group
from pagesift.sources.tables import table


def ranked_hits(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """The ``n`` best hits of every page: page_id, hit_id, similarity (cut to 0..1), rank."""
    hits = table(spark, folder, "evidence_hits").select(
        clean_id(F.col("page_id")).alias("page_id"),
        "hit_id",
        "query_chunk_index",
        "label",
        "train_source",
        "arrived_at",
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("similarity"))).alias("cut"),
        (F.col("similarity").isNotNull() & ~F.isnan("similarity")).alias("valid"),
    )
    best = [F.desc("cut"), F.asc("query_chunk_index"), F.asc("train_source"), F.asc("label"), F.asc("hit_id")]
    return top_n_per_group(
        hits,
        ["page_id"],
        best,
        n,
        latest_by=["query_chunk_index", "label", "train_source"],
        latest_order=[F.desc("arrived_at"), F.desc("hit_id")],
        keep=F.col("valid"),
    ).select("page_id", "hit_id", F.col("cut").alias("similarity"), "rank")


def wanted(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, top_k) of every prediction of a published run, once each."""
    runs = table(spark, folder, "topk_metrics").select("top_k").distinct()
    pages = table(spark, folder, "prediction").select(clean_id(F.col("page_id")).alias("page_id"), "top_k")
    return pages.join(runs, "top_k", "left_semi").distinct()


def _largest_k(spark: SparkSession, folder: str) -> int:
    return table(spark, folder, "topk_metrics").agg(F.max("top_k")).first()[0] or 0


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (top_k, page_id, hit_id): a list for K is a prefix of the list for the largest K, so hits are ranked once."""
    ranked = ranked_hits(spark, folder, _largest_k(spark, folder))
    kept = ranked.join(wanted(spark, folder), "page_id").where("rank <= top_k")
    return kept.select("top_k", "page_id", "hit_id")


def margins(spark: SparkSession, folder: str) -> DataFrame:
    """Per run: pages with hits, hits kept, mean best similarity and mean last kept one."""
    ranked = ranked_hits(spark, folder, _largest_k(spark, folder))
    kept = ranked.join(wanted(spark, folder), "page_id").where("rank <= top_k")
    per_page = kept.groupBy("top_k", "page_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("similarity").alias("best"), F.min("similarity").alias("last")
    )
    return per_page.groupBy("top_k").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("n").alias("hits"),
        F.round(F.avg("best"), 6).alias("mean_best"),
        F.round(F.avg("last"), 6).alias("mean_last"),
    )


_RANKED = """
WITH delivered AS (
  SELECT lower(trim(page_id)) AS page_id, hit_id, query_chunk_index, label, train_source, similarity,
         row_number() OVER (PARTITION BY lower(trim(page_id)), query_chunk_index, label, train_source
                            ORDER BY arrived_at DESC, hit_id DESC) AS delivery
  FROM evidence_hits),
ranked AS (
  SELECT page_id, hit_id, least(1.0, greatest(0.0, similarity)) AS cut,
         row_number() OVER (PARTITION BY page_id ORDER BY least(1.0, greatest(0.0, similarity)) DESC,
                            query_chunk_index, train_source, label, hit_id) AS rank
  FROM delivered WHERE delivery = 1 AND similarity IS NOT NULL AND NOT isnan(similarity)),
wanted AS (
  SELECT DISTINCT lower(trim(page_id)) AS page_id, top_k FROM prediction
  WHERE top_k IN (SELECT top_k FROM topk_metrics)),
kept AS (
  SELECT w.top_k, w.page_id, r.hit_id, r.cut FROM wanted w JOIN ranked r ON r.page_id = w.page_id AND r.rank <= w.top_k)
"""

QUERIES = {"p1_found": found, "p1_margins": margins}
SQL = {
    "p1_found": _RANKED + "SELECT top_k, page_id, hit_id FROM kept",
    "p1_margins": _RANKED
    + """
SELECT top_k, count(*) AS pages, CAST(sum(n) AS BIGINT) AS hits,
       round(avg(best), 6) AS mean_best, round(avg(last), 6) AS mean_last
FROM (SELECT top_k, page_id, count(*) AS n, max(cut) AS best, min(cut) AS last FROM kept GROUP BY top_k, page_id)
GROUP BY top_k""",
}
