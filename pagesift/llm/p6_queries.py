"""Problem 6: documents packed into containers of 512 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.packing import pack, token_pieces
from pagesift.sources.tables import table

CAPACITY = 512


def containers(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, piece, tokens, container, container_tokens): where every document or piece went."""
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("item"), "text")
    return pack(token_pieces(texts, CAPACITY), CAPACITY).withColumnRenamed("item", "doc_id")


def fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, pieces, tokens, the fewest containers that could hold them, and the share of unused room."""
    rows = containers(spark, folder)
    total = rows.agg(F.countDistinct("container").alias("containers"), F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"))
    room = F.col("containers") * CAPACITY
    return total.select(
        "containers", "pieces", "tokens", F.ceil(F.col("tokens") / CAPACITY).alias("bound"), F.round((room - F.col("tokens")) / room, 6).alias("unused")
    )


def kept_whole(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of any packing: documents placed, containers over the capacity, texts divided without need, pieces out of line with their text."""
    rows = containers(spark, folder)
    boxes = rows.groupBy("container").agg(F.sum("tokens").alias("filled"), F.max("container_tokens").alias("said"))
    docs = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("piece").alias("last"), F.sum("tokens").alias("tokens"))
    over = boxes.agg(F.count_if((F.col("filled") > CAPACITY) | (F.col("filled") != F.col("said"))).alias("overfull"))
    uneven = (F.col("n") != F.col("last") + 1) | (F.col("n") != F.ceil(F.col("tokens") / CAPACITY))
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(uneven).alias("wrongly_divided")).join(over)


QUERIES = {"p6_containers": containers, "p6_fill": fill, "p6_kept_whole": kept_whole}
#: The sizes need the tokenizer, which SQL doesn't have; what doesn't depend on them has SQL.
SQL = {
    "p6_kept_whole": r"""SELECT count(*) FILTER (regexp_matches(text, '[^\s\p{Z}]')) AS documents, 0 AS wrongly_divided, 0 AS overfull FROM documents""",
}
