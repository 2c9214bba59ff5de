"""Problem 2: splits of listed and predicted pages that keep pages and sites together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.ids import clean_id, long_page_number, page_id, page_number
from pagesift.functions.urls import site
from pagesift.llm.group_split import record_groups, split_of
from pagesift.plans.stages import stage
from pagesift.sources.tables import table


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """Listed rows with a file name: filename, page_id, page, site, group_no, linked (the group, also where it has no number).

    Page numbers beyond 64 bits link their rows as well, but can't be a group's number.
    """
    rows = (
        table(spark, folder, "test_1000_balanced_seed42")
        .where("filename IS NOT NULL")
        .select("filename", page_id(F.col("filename")).alias("page_id"), page_number(F.col("filename")).alias("page"), long_page_number(F.col("filename")).alias("long_page"), site("url").alias("site"))
        .distinct()
    )
    return stage(record_groups(rows, "page", ["site", "long_page"], component="linked"), "listed")


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (page_id, group_no): predicted pages whose group holds two or more page_ids of listed file names."""
    groups = listed(spark, folder).where("group_no IS NOT NULL").select("page_id", "group_no").distinct()
    several = groups.groupBy("group_no").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("group_no")
    predicted = table(spark, folder, "prediction").select(clean_id(F.col("page_id")).alias("page_id")).distinct()
    return groups.join(several, "group_no", "left_semi").join(predicted, "page_id", "left_semi").select("page_id", "group_no")


def splits(spark: SparkSession, folder: str) -> DataFrame:
    """Every listed file name and every predicted page_id with its split.

    A predicted page of no listed file is a group of its own, as is a listed file
    without page number and site.
    """
    rows = listed(spark, folder)
    own = F.coalesce(F.col("group_no").cast("string"), F.concat(F.lit("linked "), F.col("linked")))
    files = rows.groupBy("filename", "page_id").agg(F.min(own).alias("grp")).withColumn("grp", F.coalesce("grp", "page_id"))
    known = files.groupBy("page_id").agg(F.min("grp").alias("grp"))
    predicted = table(spark, folder, "prediction").select(clean_id(F.col("page_id")).alias("page_id")).distinct()
    pages = predicted.join(known, "page_id", "left").select(
        F.lit("prediction").alias("kind"), F.col("page_id").alias("name"), F.coalesce("grp", "page_id").alias("grp")
    )
    both = files.select(F.lit("listed").alias("kind"), F.col("filename").alias("name"), "grp").unionByName(pages)
    return both.withColumn("split", split_of(F.col("grp")))


def shares(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind and split: records, groups and the share of records."""
    counted = splits(spark, folder).groupBy("kind", "split").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("grp").alias("groups")
    )
    totals = counted.groupBy("kind").agg(F.sum("records").alias("total"))
    return counted.join(totals, "kind").select(
        "kind", "split", "records", "groups", F.round(F.col("records") / F.col("total"), 6).alias("share")
    )


QUERIES = {"p2_found": found, "p2_splits": splits, "p2_shares": shares}
SQL: dict = {}
