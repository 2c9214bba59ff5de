"""Comparison of experiment arms page by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p of b against c discordant pairs: min(1, 2 sum_{i<=min} C(n, i) / 2^n); 1 without any.

    The terms are summed from the largest down, relative to it, so that neither the
    binomials overflow nor small tails vanish.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("int")
    # ln C(n, k) - n ln 2 by a running sum of logarithms
    log_top = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), -n * F.lit(0.6931471805599453), lambda a, i: a + F.log(n - i + 1) - F.log(i.cast("double"))
    )
    # C(n, i - 1) / C(n, i) = i / (n - i + 1), for i = k, k - 1, ..., 1
    down = F.when(k > 0, F.sequence(k, F.lit(1))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(
        down,
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * i / (n - i + 1)).alias("term"), (a["sum"] + a["term"] * i / (n - i + 1)).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.exp(log_top) * tail))


def paired_tables(predictions: DataFrame, arm: str, page: str) -> DataFrame:
    """One row per pair of arms (arm_a < arm_b) over the pages both have: the 2 x 2 table of being right, and disagreements.

    A null prediction is wrong; two null predictions agree. A page has one row per
    arm, so the join by page makes pairs of arms, not of pages.
    """
    right = F.col("predicted_label").eqNullSafe(F.col("true_label"))
    rows = predictions.select(arm, page, right.alias("right"), F.col("predicted_label").alias("p"))
    a, b = rows.alias("a"), rows.alias("b")
    both = a.join(b, page).where(F.col(f"a.{arm}") < F.col(f"b.{arm}"))
    ra, rb = F.col("a.right"), F.col("b.right")
    return both.groupBy(F.col(f"a.{arm}").alias("arm_a"), F.col(f"b.{arm}").alias("arm_b")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(ra & rb).alias("both_correct"),
        F.count_if(ra & ~rb).alias("a_only"),
        F.count_if(~ra & rb).alias("b_only"),
        F.count_if(~ra & ~rb).alias("both_wrong"),
        F.count_if(~F.col("a.p").eqNullSafe(F.col("b.p"))).alias("disagreements"),
    )


def deltas(metrics: DataFrame, arm: str, names: list[str]) -> DataFrame:
    """b - a of each metric for every pair of arms; ``metrics`` has a row per arm."""
    a, b = metrics.alias("a"), metrics.alias("b")
    pairs = a.join(b, F.col(f"a.{arm}") < F.col(f"b.{arm}"))
    return pairs.select(
        F.col(f"a.{arm}").alias("arm_a"), F.col(f"b.{arm}").alias("arm_b"), *[F.round(F.col(f"b.{n}") - F.col(f"a.{n}"), 6).alias(n) for n in names]
    )


def by_page(predictions: DataFrame, arm: str, page: str, arms: list) -> DataFrame:
    """One row per page with the prediction and correctness of each arm."""
    per = predictions.groupBy(page).agg(
        F.max("true_label").alias("true_label"),
        *[F.max(F.when(F.col(arm) == x, F.col("predicted_label"))).alias(f"predicted_{x}") for x in arms],
        *[F.max(F.when(F.col(arm) == x, F.col("predicted_label").eqNullSafe(F.col("true_label")).cast("int"))).alias(f"correct_{x}") for x in arms],
    )
    return per
