"""Problem 5: near-duplicates among the chunk texts of page_evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.near_duplicates import expand_pairs, near_duplicate_classes, near_duplicate_pairs
from pagesift.sources.tables import table

RULES = {"width": 3, "threshold": 0.6, "min_words": 20}


def chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(key, text) of every query chunk (3 x group_id), benign (+ 1) and phishing example (+ 2)."""
    groups = table(spark, folder, "page_evidence").select(F.explode("selected_chunks").alias("g"))
    three = F.array(
        *(
            F.struct((F.col("g.group_id") * 3 + i).alias("key"), text.alias("text"))
            for i, text in enumerate((F.col("g.query_chunk"), F.col("g.benign_example.chunk"), F.col("g.phishing_example.chunk")))
        )
    )
    return groups.select(F.inline(three))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (key_a, key_b), key_a < key_b."""
    return expand_pairs(*near_duplicate_pairs(chunk_texts(spark, folder), **RULES))


def classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per text: key, class_id, copies, links."""
    return near_duplicate_classes(*near_duplicate_pairs(chunk_texts(spark, folder), **RULES))


def document_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The same for all documents, with five-word runs and a similarity of 0.8: doc_id, class_id, copies, links.

    Documents of fewer than five words are classed with those of the same words;
    null and blank ones are each a class of their own, without copies.
    """
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    out = near_duplicate_classes(*near_duplicate_pairs(texts, width=5, threshold=0.8, min_words=0))
    return out.withColumnRenamed("key", "doc_id")


def recall(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different texts found by the words of sketches, those of them that p5_found finds by runs, recall."""
    texts = chunk_texts(spark, folder)
    true, _ = near_duplicate_pairs(texts, **RULES, exact=True)
    found, _ = near_duplicate_pairs(texts, **RULES)
    both = true.select("hash_a", "hash_b").join(found.select("hash_a", "hash_b", F.lit(1).alias("hit")), ["hash_a", "hash_b"], "left")
    counts = both.agg(F.count(F.lit(1)).alias("true_pairs"), F.count("hit").alias("hits"))
    return counts.withColumn("recall", F.round(F.col("hits") / F.greatest("true_pairs", F.lit(1)), 6))


QUERIES = {"p5_found": found, "p5_classes": classes, "p5_document_classes": document_classes, "p5_recall": recall}
SQL = {
    "p5_found": r"""
WITH g AS (SELECT unnest(selected_chunks) AS g FROM page_evidence),
t AS (SELECT DISTINCT key, text FROM (
  SELECT 3 * g.group_id AS key, g.query_chunk AS text FROM g UNION ALL SELECT 3 * g.group_id + 1, g.benign_example.chunk FROM g
  UNION ALL SELECT 3 * g.group_id + 2, g.phishing_example.chunk FROM g) WHERE text IS NOT NULL),
w AS (SELECT key, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM t),
s AS (SELECT key, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 20),
e AS (SELECT key, len(s) AS n, unnest(s) AS r FROM s),
p AS (SELECT a.key AS key_a, b.key AS key_b, a.n AS n, b.n AS m, count(*) AS shared FROM e a JOIN e b ON a.r = b.r AND a.key < b.key GROUP BY ALL)
SELECT key_a, key_b FROM p WHERE shared * 10 >= 6 * (n + m - shared)""",
}
