"""Queries on predictions: labels, metrics, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions.ids import clean_id
from pagesift.functions.labels import label_with_retry, parse_label
from pagesift.operators import metrics, pairs
from pagesift.operators.checks import misplaced
from pagesift.operators.evidence import shard_number
from pagesift.operators.ranking import rank_in_groups
from pagesift.plans.q_votes import _METRICS
from pagesift.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}
RUNS = [1, 2, 4, 8, 16]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PARSE = """CASE WHEN len(list_distinct(list_transform(regexp_extract_all({0}, '(?i)\\b(benign|phishing)\\b', 1), lambda x: upper(x)))) = 1
THEN CAST(upper(regexp_extract({0}, '(?i)\\b(benign|phishing)\\b', 1)) = 'PHISHING' AS INTEGER) END"""
_LATEST = f"""latest AS (SELECT page_id, top_k, max(true_label) AS true_label, arg_max(predicted_label, o) AS predicted_label, arg_max(prompt_tokens, o) AS prompt_tokens,
  arg_max(num_groups_available, o) AS num_groups_available, arg_max(num_groups_used, o) AS num_groups_used FROM (
  SELECT lower(trim(page_id)) AS page_id, top_k, true_label, coalesce({_PARSE.format("model_output")}, {_PARSE.format("retry_output")}, -1) AS predicted_label,
  prompt_tokens, num_groups_available, num_groups_used, (predicted_at, arrived_at, md5(concat_ws('|', model_output, coalesce(retry_output, ''), prompt_tokens))) AS o FROM prediction) GROUP BY page_id, top_k),
judged AS (SELECT * REPLACE (nullif(predicted_label, -1) AS predicted_label) FROM latest)"""


def latest(spark, folder) -> DataFrame:
    """The last answer of every page and run, with the label parsed from it or from its retry."""
    rows = table(spark, folder, "prediction").select(
        clean_id(F.col("page_id")).alias("page_id"),
        "top_k",
        "true_label",
        label_with_retry(F.col("model_output"), F.col("retry_output")).alias("predicted_label"),
        "prompt_tokens",
        "num_groups_available",
        "num_groups_used",
        F.struct(
            "predicted_at",
            "arrived_at",
            F.md5(F.concat_ws("|", "model_output", F.coalesce("retry_output", F.lit("")), F.col("prompt_tokens").cast("string")).cast("binary")).alias("h"),
        ).alias("o"),
    )
    names = ("predicted_label", "prompt_tokens", "num_groups_available", "num_groups_used")
    last = rows.groupBy("page_id", "top_k").agg(F.max("true_label").alias("true_label"), F.max_by(F.struct(*names), "o").alias("r"))
    return last.select("page_id", "top_k", "true_label", *[f"r.{n}" for n in names])


@query(f"SELECT model_output, {_PARSE.format('model_output')} AS label, count(*) AS rows FROM prediction GROUP BY model_output")
def parse_labels(spark, folder):
    """Every answer with the label parsed from it."""
    rows = table(spark, folder, "prediction").groupBy("model_output").agg(F.count(F.lit(1)).alias("rows"))
    return rows.select("model_output", parse_label(F.col("model_output")).alias("label"), "rows")


@query(f"WITH {_LATEST} SELECT page_id, top_k, predicted_label FROM judged")
def retry_merge(spark, folder):
    """The label of every page and run, after the retry of unreadable answers."""
    return latest(spark, folder).select("page_id", "top_k", "predicted_label")


_BY_RUN = (
    _METRICS.replace("SELECT count(*) AS total", "SELECT top_k, count(*) AS total")
    .replace("FROM judged)", "FROM judged GROUP BY top_k)")
    .replace("SELECT total AS num_pages", "SELECT top_k, total AS num_pages")
)


@query(f"WITH {_LATEST}, {_BY_RUN}")
def classification_metrics(spark, folder):
    """Metrics of every run; an unreadable answer is wrong."""
    return metrics.classification(latest(spark, folder), ["top_k"])


_PROMPT = _BY_RUN.replace("SELECT top_k, count(*) AS total", "SELECT top_k, round(avg(prompt_tokens), 6) AS avg_prompt_tokens, round(avg(num_groups_used), 6) AS avg_groups_used, count(*) FILTER (num_groups_used < num_groups_available) AS truncated_pages, count(*) AS total").replace("tn, fp, fn, tp FROM r", "tn, fp, fn, tp, avg_prompt_tokens, avg_groups_used, truncated_pages FROM r")


@query(f"WITH {_LATEST}, {_PROMPT}")
def metrics_with_prompt_stats(spark, folder):
    """The same with mean prompt tokens, mean groups used and truncated pages."""
    extra = {
        "avg_prompt_tokens": F.round(F.avg("prompt_tokens"), 6),
        "avg_groups_used": F.round(F.avg("num_groups_used"), 6),
        "truncated_pages": F.count_if(F.col("num_groups_used") < F.col("num_groups_available")),
    }
    return metrics.classification(latest(spark, folder), ["top_k"], extra)


@query("""SELECT top_k, num_pages, round((tn + tp)::DOUBLE / num_pages, 6) AS accuracy_again, round(abs((tn + tp)::DOUBLE / num_pages - accuracy), 6) AS accuracy_gap,
round(abs(tp::DOUBLE / (tp + fp) - precision_phishing), 6) AS precision_gap, round(abs(tp::DOUBLE / (tp + fn) - recall_phishing), 6) AS recall_gap FROM topk_metrics""")
def published_metrics_check(spark, folder):
    """Published metrics held against their own confusion matrices."""
    c = F.col
    rows = table(spark, folder, "topk_metrics")
    accuracy = (c("tn") + c("tp")) / c("num_pages")
    return rows.select(
        "top_k",
        "num_pages",
        F.round(accuracy, 6).alias("accuracy_again"),
        F.round(F.abs(accuracy - c("accuracy")), 6).alias("accuracy_gap"),
        F.round(F.abs(c("tp") / (c("tp") + c("fp")) - c("precision_phishing")), 6).alias("precision_gap"),
        F.round(F.abs(c("tp") / (c("tp") + c("fn")) - c("recall_phishing")), 6).alias("recall_gap"),
    )


_PAIRED = f"""WITH {_LATEST}, r AS (SELECT top_k, page_id, predicted_label AS p, predicted_label IS NOT DISTINCT FROM true_label AS ok FROM judged),
paired AS (SELECT a.top_k AS arm_a, b.top_k AS arm_b, count(*) AS pages, count(*) FILTER (a.ok AND b.ok) AS both_correct, count(*) FILTER (a.ok AND NOT b.ok) AS a_only,
  count(*) FILTER (NOT a.ok AND b.ok) AS b_only, count(*) FILTER (NOT a.ok AND NOT b.ok) AS both_wrong, count(*) FILTER (a.p IS DISTINCT FROM b.p) AS disagreements
  FROM r a JOIN r b ON a.page_id = b.page_id AND a.top_k < b.top_k GROUP BY 1, 2)"""


@query(_PAIRED + " SELECT * FROM paired WHERE arm_a = 4 AND arm_b = 8")
def paired_table(spark, folder):
    """K = 4 against K = 8."""
    rows = latest(spark, folder).where(F.col("top_k").isin(4, 8))
    return pairs.paired_tables(rows, "top_k", "page_id")


@query(_PAIRED + """ SELECT arm_a, arm_b, pages, both_correct, a_only, b_only, both_wrong, disagreements,
CASE WHEN a_only + b_only = 0 THEN 1.0::DOUBLE ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1), lambda i:
exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2))))), 6) END AS mcnemar_p FROM paired""")
def all_pairs_mcnemar(spark, folder):
    """Every pair of runs with the exact McNemar p."""
    paired = pairs.paired_tables(latest(spark, folder), "top_k", "page_id")
    return paired.withColumn("mcnemar_p", F.round(pairs.exact_mcnemar(F.col("a_only"), F.col("b_only")), 6))


_DELTA = ["accuracy", "balanced_accuracy", "precision_valid", "recall_valid", "f1_valid", "specificity_valid"]


@query(f"WITH {_LATEST}, m AS (WITH {_BY_RUN.replace('c AS (', 'c AS (', 1)}) SELECT a.top_k AS arm_a, b.top_k AS arm_b, " + ", ".join(f"round(b.{n} - a.{n}, 6) AS {n}" for n in _DELTA) + " FROM m a JOIN m b ON a.top_k < b.top_k")
def metric_deltas(spark, folder):
    """Differences of six metrics between every two runs."""
    return pairs.deltas(metrics.classification(latest(spark, folder), ["top_k"]), "top_k", _DELTA)


@query(f"WITH {_LATEST} SELECT page_id, max(true_label) AS true_label, " + ", ".join(f"max(predicted_label) FILTER (top_k = {k}) AS predicted_{k}" for k in RUNS) + ", " + ", ".join(f"max(CAST(predicted_label IS NOT DISTINCT FROM true_label AS INTEGER)) FILTER (top_k = {k}) AS correct_{k}" for k in RUNS) + " FROM judged GROUP BY page_id")
def condition_pivot(spark, folder):
    """One row per page with the prediction of every run."""
    return pairs.by_page(latest(spark, folder), "top_k", "page_id", RUNS)


@query(f"WITH {_LATEST} SELECT a.page_id, a.predicted_label AS predicted_4, b.predicted_label AS predicted_8, a.true_label FROM judged a JOIN judged b USING (page_id) WHERE a.top_k = 4 AND b.top_k = 8 AND a.predicted_label IS DISTINCT FROM b.predicted_label")
def prediction_disagreements(spark, folder):
    """Pages that K = 4 and K = 8 judge differently."""
    both = pairs.by_page(latest(spark, folder).where(F.col("top_k").isin(4, 8)), "top_k", "page_id", [4, 8])
    differ = both.where("correct_4 IS NOT NULL AND correct_8 IS NOT NULL").where(~F.col("predicted_4").eqNullSafe(F.col("predicted_8")))
    return differ.select("page_id", "predicted_4", "predicted_8", "true_label")


@query("""WITH i AS (SELECT DISTINCT lower(trim(page_id)) AS page_id FROM page_evidence), o AS (SELECT DISTINCT lower(trim(page_id)) AS page_id FROM prediction WHERE top_k = 8)
SELECT coalesce(i.page_id, o.page_id) AS page_id, i.page_id IS NOT NULL AS has_input, o.page_id IS NOT NULL AS has_output FROM i FULL JOIN o ON i.page_id = o.page_id WHERE i.page_id IS NULL OR o.page_id IS NULL""")
def shard_identity(spark, folder):
    """Pages of the inputs without an output of the run K = 8, and outputs without input."""
    of = lambda df: df.select(clean_id(F.col("page_id")).alias("page_id")).distinct()
    i = of(table(spark, folder, "page_evidence")).withColumn("has_input", F.lit(True))
    o = of(table(spark, folder, "prediction").where("top_k = 8")).withColumn("has_output", F.lit(True))
    both = i.join(o, "page_id", "full").fillna(False, ["has_input", "has_output"])
    return both.where("NOT (has_input AND has_output)")


@query("""WITH i AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS n FROM (SELECT DISTINCT lower(trim(page_id)) AS page_id FROM page_evidence)),
o AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS n FROM (SELECT DISTINCT lower(trim(page_id)) AS page_id FROM prediction WHERE top_k = 8))
SELECT CAST(coalesce(i.n, o.n) // 250 AS INTEGER) AS shard, coalesce(i.n, o.n) % 250 AS place, i.page_id AS input_id, o.page_id AS output_id
FROM i FULL JOIN o ON i.n = o.n WHERE i.page_id IS DISTINCT FROM o.page_id""")
def shard_order(spark, folder):
    """Places in the shards where inputs and outputs of the run K = 8, as ordered lists, don't hold the same page."""
    def listed(rows, name):
        ids = rows.select(clean_id(F.col("page_id")).alias("page_id")).distinct()
        placed = rank_in_groups(ids, [], [F.asc("page_id")], "n")
        return placed.select(shard_number(F.col("n"), 250).alias("shard"), ((F.col("n") - 1) % 250).alias("place"), F.col("page_id").alias(name))

    i = listed(table(spark, folder, "page_evidence"), "input_id")
    o = listed(table(spark, folder, "prediction").where("top_k = 8"), "output_id")
    return misplaced(i, o, ["shard", "place"], "input_id", "output_id")
