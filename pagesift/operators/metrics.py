"""Metrics of predictions; a null prediction counts as wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.operators.ranking import running_sums
from pagesift.plans.stages import stage


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def confusion(truth: str = "true_label", predicted: str = "predicted_label") -> dict[str, Column]:
    """Aggregates of a confusion matrix over valid predictions."""
    t, p = F.col(truth), F.col(predicted)
    return {
        "tn": F.count_if((t == 0) & (p == 0)),
        "fp": F.count_if((t == 0) & (p == 1)),
        "fn": F.count_if((t == 1) & (p == 0)),
        "tp": F.count_if((t == 1) & (p == 1)),
    }


def derived(df: DataFrame, by: list[str], extra: list[str] | None = None) -> DataFrame:
    """Metrics from counts: columns num_pages, valid_predictions, n0, n1, tn, fp, fn, tp."""
    c = F.col
    r0, r1 = _ratio(c("tn"), c("n0")), _ratio(c("tp"), c("n1"))
    precision, recall = _ratio(c("tp"), c("tp") + c("fp")), _ratio(c("tp"), c("tp") + c("fn"))
    values = {
        "coverage": _ratio(c("valid_predictions"), c("num_pages")),
        "accuracy": _ratio(c("tn") + c("tp"), c("num_pages")),
        "balanced_accuracy": (r0 + r1) / 2,
        "recall_benign_all": r0,
        "recall_phishing_all": r1,
        "precision_valid": precision,
        "recall_valid": recall,
        "specificity_valid": _ratio(c("tn"), c("tn") + c("fp")),
        "f1_valid": f1(precision, recall),
    }
    return df.select(
        *by, "num_pages", "valid_predictions", (c("num_pages") - c("valid_predictions")).alias("invalid_predictions"),
        *[F.round(v, 6).alias(k) for k, v in values.items()], "tn", "fp", "fn", "tp", *(extra or []),
    )


def classification(df: DataFrame, by: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """Null-aware metrics of true_label and predicted_label per group; one pass, zero denominators give 0."""
    grouped = df.groupBy(*by) if by else df
    counts = grouped.agg(
        F.count(F.lit(1)).alias("num_pages"),
        F.count("predicted_label").alias("valid_predictions"),
        F.count_if(F.col("true_label") == 0).alias("n0"),
        F.count_if(F.col("true_label") == 1).alias("n1"),
        *[v.alias(k) for k, v in confusion().items()],
        *[v.alias(k) for k, v in (extra or {}).items()],
    )
    return derived(counts, by, list(extra or {}))


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: the chance that a positive scores above a negative, ties half; null without both classes.

    Rows are counted per distinct score first, and the distinct ones are put in order
    over many partitions.
    """
    per = df.groupBy(score).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))
    per = per.withColumnRenamed(score, "score")
    walked = running_sums(per, "score", "n", "upto").withColumn("b", F.col("upto") - F.col("n"))
    total = walked.agg(F.sum(F.col("p") * (F.col("b") + F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(F.round(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))), 6).alias("roc_auc"))


def report(df: DataFrame, truth: str, predicted: str, classes: list[int]) -> DataFrame:
    """Precision, recall, F1 and support per class, macro and weighted averages."""
    t, p = F.col(truth), F.col(predicted)
    counts = df.agg(
        *[F.count_if(t == y).alias(f"s{y}") for y in classes],
        *[F.count_if(p == y).alias(f"p{y}") for y in classes],
        *[F.count_if((t == y) & (p == y)).alias(f"h{y}") for y in classes],
    )
    rows = F.array(*[F.struct(F.lit(y).alias("class"), F.col(f"s{y}").alias("support"), F.col(f"p{y}").alias("n"), F.col(f"h{y}").alias("hit")) for y in classes])
    each = counts.select(F.inline(rows)).withColumns({"precision": _ratio(F.col("hit"), F.col("n")), "recall": _ratio(F.col("hit"), F.col("support"))})
    each = each.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    names = ("precision", "recall", "f1")
    one = each.select(F.col("class").cast("string").alias("row"), *names, "support")
    macro = each.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("row"), *names, "support")
    weighted = each.agg(*[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names], F.sum("support").alias("support"))
    both = one.unionByName(macro).unionByName(weighted.select(F.lit("weighted avg").alias("row"), *names, "support"))
    return both.withColumns({c: F.round(c, 6) for c in names})


def distribution(df: DataFrame, column: str, quantiles: list[float]) -> DataFrame:
    """count, mean, min, max and exact quantiles (linear interpolation); no row for an empty table.

    Values are counted first, and the distinct ones are put in order over many
    partitions; no task holds them all.
    """
    per = stage(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("n")), "values")
    totals = per.agg(F.sum("n").alias("count"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))
    placed = running_sums(per, "x", "n", "upto")
    positions = F.array(*[(F.col("count") - 1) * F.lit(float(q)) for q in quantiles])
    # the values at the places on both sides of each quantile: two rows a quantile
    asked = totals.select("count", "mean", "min", "max", F.posexplode(positions).alias("i", "at"))
    beside = F.explode(F.array(F.struct(F.floor("at").alias("place"), (1 - (F.col("at") - F.floor("at"))).alias("part")), F.struct(F.ceil("at").alias("place"), (F.col("at") - F.floor("at")).alias("part"))))
    asked = asked.select("*", beside.alias("b")).select("count", "mean", "min", "max", "i", "b.place", "b.part")
    met = placed.join(F.broadcast(asked), (F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
    rows = met.groupBy("count", "mean", "min", "max").agg(*[F.sum(F.when(F.col("i") == i, F.col("x") * F.col("part"))).alias(f"q{i}") for i in range(len(quantiles))])
    name = lambda q: "p" + f"{q * 100:g}".replace(".", "_")
    return rows.select("count", F.round("mean", 6).alias("mean"), "min", *[F.round(f"q{i}", 6).alias(name(q)) for i, q in enumerate(quantiles)], "max")
