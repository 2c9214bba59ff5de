"""From retrieved neighbours to page votes: dedupe, rank, noisy-OR, vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.operators.ranking import first_in_groups


def similarity(distance: Column) -> Column:
    """1 - distance, cut to 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - distance))


def best_per_source(hits: DataFrame, query: list[str]) -> DataFrame:
    """The best similarity of each train source within one query chunk and class."""
    return hits.groupBy(*query, "label", "source").agg(F.max("similarity").alias("similarity"))


def top_sources(hits: DataFrame, query: list[str], n: int = 10) -> DataFrame:
    """The ``n`` most similar sources of each query chunk and class; ties by source.

    One exchange by (query, class) serves both the best hit per source and the rank.
    """
    met = hits.repartition(*[F.col(q) for q in query], F.col("label"))
    return first_in_groups(best_per_source(met, query), [*query, "label"], [F.desc("similarity"), F.asc("source")], n)


def noisy_or(evidence: DataFrame, page: str) -> DataFrame:
    """Score of each (page, class, source): 1 minus the product of 1 - similarity over the page's chunks."""
    return evidence.groupBy(page, "label", "source").agg((1 - F.product(1 - F.col("similarity"))).alias("score"))


def page_votes(scores: DataFrame, page: str) -> DataFrame:
    """One row per page: class scores, probability of class 1, prediction, unique sources, tie.

    Class 1 is predicted only if its score is strictly larger; without any score the
    probability is 0.5. Scores are rounded to 9 places before they are compared, so
    that the order of summation doesn't decide.
    """
    of = lambda y, value: F.when(F.col("label") == y, value)
    sums = scores.groupBy(page).agg(
        F.round(F.coalesce(F.sum(of(0, F.col("score"))), F.lit(0.0)), 9).alias("benign_score"),
        F.round(F.coalesce(F.sum(of(1, F.col("score"))), F.lit(0.0)), 9).alias("phishing_score"),
        F.count(of(0, F.lit(1))).alias("unique_benign_sources"),
        F.count(of(1, F.lit(1))).alias("unique_phishing_sources"),
    )
    b, p = F.col("benign_score"), F.col("phishing_score")
    return sums.select(
        page,
        (p > b).cast("int").alias("predicted_label"),
        "benign_score",
        "phishing_score",
        F.round(F.when(p + b > 0, p / (p + b)).otherwise(0.5), 6).alias("phishing_probability"),
        "unique_benign_sources",
        "unique_phishing_sources",
        (F.abs(p - b) <= 1e-8 + 1e-5 * F.abs(b)).alias("tie"),
    )
