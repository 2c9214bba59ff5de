"""Problem 7: held-out passages inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.leaks import leaked_passages, proximity_matches
from pagesift.sources.tables import table

RUN, SPAN = 12, 24


def _leaks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    passages = table(spark, folder, "heldout_passages").select("item_id", F.col("passage").alias("text"))
    return leaked_passages(documents, passages, run=RUN)


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, item_id): documents with 12 consecutive words of the item's passage."""
    return _leaks(spark, folder)[0].select(F.col("id").alias("doc_id"), "item_id")


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Every test item with the number of documents that leak it."""
    leaks = found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    every = table(spark, folder, "heldout_passages").select("item_id", "filename")
    return every.join(leaks, "item_id", "left").fillna(0, ["documents"])


def near(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, item_id): the three rarest words of some 12-word window within 24 words of each other, but no exact run."""
    exact, index, wins = _leaks(spark, folder)
    close = proximity_matches(index, wins, SPAN)
    return close.join(exact, ["id", "item_id"], "left_anti").select(F.col("id").alias("doc_id"), "item_id")


def _words_sql(text: str) -> str:
    """The words of a text in SQL: tags within a line vanish, others part words, as in ``words.plain``; of entities those of the tables (letters and digits by number)."""
    inline = "(?i)</?(?:a|abbr|b|big|cite|code|em|font|i|ins|kbd|mark|s|small|span|strong|sub|sup|tt|u|wbr)\\b[^<>]*>"
    tag = "(?s)<!--.*?-->|</?[A-Za-z!?][^<>]*>"
    out = f"regexp_replace(regexp_replace({text}, '{inline}', '', 'g'), '{tag}', ' ', 'g')"
    for code in [*range(48, 58), *range(65, 91), *range(97, 123)]:
        out = f"replace({out}, '&#{code};', '{chr(code)}')"
    out = f"replace(replace({out}, '&nbsp;', chr(160)), '&copy;', chr(169))"
    invisible = r"[\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}\x{e0000}-\x{e0fff}]"
    return f"regexp_extract_all(lower(nfc_normalize(regexp_replace({out}, '{invisible}', '', 'g'))), '[\\p{{L}}\\p{{N}}]+')"


def _grams_sql(table: str, key: str, column: str) -> str:
    return f"""SELECT {key}, unnest(list_distinct(list_transform(range(1, len(w) - {RUN - 2}), lambda i: list_aggregate(w[i:i + {RUN - 1}], 'string_agg', ' ')))) AS gram
FROM (SELECT {key}, {_words_sql(column)} AS w FROM {table} WHERE {column} IS NOT NULL) WHERE len(w) >= {RUN}"""


_FOUND = f"""WITH p AS ({_grams_sql("heldout_passages", "item_id", "passage")}), d AS ({_grams_sql("documents", "doc_id", "text")}),
found AS (SELECT DISTINCT doc_id, item_id FROM d JOIN p USING (gram))
"""
QUERIES = {"p7_found": found, "p7_items": items, "p7_near": near}
SQL = {
    "p7_found": _FOUND + "SELECT doc_id, item_id FROM found",
    "p7_items": _FOUND + "SELECT h.item_id, h.filename, count(f.doc_id) AS documents FROM heldout_passages h LEFT JOIN found f USING (item_id) GROUP BY ALL",
}
