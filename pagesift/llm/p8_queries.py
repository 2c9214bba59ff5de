"""Problem 8: abusive, hateful or sexually explicit documents."""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.abuse import Classifier, fit, held_out, sample_sentences, score_texts
from pagesift.sources.tables import table


_models: dict[int, Classifier] = {}


def model_of(sample: list[str]) -> Classifier:
    """The classifier of a sample of sentences; this driver fits it once, however many queries score with it."""
    key = xxhash.xxh3_128_intdigest("\0".join(sample))
    if key not in _models:
        _models.clear()
        _models[key] = fit(sample)
    return _models[key]


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").select("doc_id", "source", "text")
    return score_texts(texts, model_of(sample_sentences(texts.select("text")))).drop("text")


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id): documents with at least one such sentence."""
    return _scored(spark, folder).where("flagged").select("doc_id")


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's score and flag."""
    return _scored(spark, folder).select("doc_id", F.round("score", 6).alias("score"), "flagged")


def rates(spark: SparkSession, folder: str) -> DataFrame:
    """Per source (null is one): documents, flagged ones, their rate and the mean score."""
    grouped = _scored(spark, folder).groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("flagged").alias("flagged"), F.round(F.avg("score"), 6).alias("mean_score")
    )
    return grouped.withColumn("rate", F.round(F.col("flagged") / F.col("documents"), 6))


def held(spark: SparkSession, folder: str) -> DataFrame:
    """Per language: lines of patterns that the training never saw, recall of the abusive and false alarms of the harmless ones. Doesn't read the tables."""
    rows = [(lang, *counts, round(counts[1] / max(counts[0], 1), 4), round(counts[3] / max(counts[2], 1), 4)) for lang, counts in held_out().items()]
    return spark.createDataFrame(rows, "lang string, abusive long, flagged long, harmless long, false_alarms long, recall double, false_alarm_rate double")


QUERIES = {"p8_found": found, "p8_scores": scores, "p8_rates": rates, "p8_held_out": held}
SQL: dict = {}
