"""Evidence of a page: importance of chunks, top chunks, nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.operators.checks import require_positive
from pagesift.operators.ranking import first_in_groups


def importance(benign: Column, phishing: Column) -> Column:
    """The larger similarity times the gap between both."""
    return F.greatest(benign, phishing) * F.abs(benign - phishing)


def closer_class(benign: Column, phishing: Column) -> Column:
    """BENIGN, PHISHING or TIE; null where a similarity is."""
    return F.when(phishing > benign, "PHISHING").when(benign > phishing, "BENIGN").when(benign == phishing, "TIE")


def top_chunks(chunks: DataFrame, page: str, n: int) -> DataFrame:
    """The ``n`` most important chunks of each page; ties by the smaller chunk index."""
    require_positive(n=n)
    return first_in_groups(chunks, [page], [F.desc("importance"), F.asc("query_chunk_index")], n)


def nested(chunks: DataFrame, page: str, fields: list[str]) -> DataFrame:
    """One row per page with its ranked chunks as an array; ``chunks`` are at most a top n, so arrays stay short."""
    rows = F.array_sort(F.collect_list(F.struct("rank", *fields)))
    return chunks.groupBy(page).agg(F.count(F.lit(1)).alias("num_selected_chunks"), rows.alias("selected_chunks"))


def shard_number(position: Column, size: int) -> Column:
    """The shard of a row by its position from 1."""
    return F.floor((position - 1) / size).cast("int")


def milestones(total: Column, percents: list[int]) -> Column:
    """Row counts at which a run reports: the given percents of the total, rounded up."""
    return F.array(*[F.ceil(total * p / F.lit(100)).cast("long") for p in percents])
