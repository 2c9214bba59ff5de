"""Exact nearest neighbours per class, in blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.operators.checks import require_positive
from pagesift.operators.ranking import first_in_groups

FOUND = "query_id string, label int, chunk_id string, similarity double"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = x.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def class_comparison(k: int):
    """Compares the queries (id, vector) of one table with the chunks (cid, clabel, cvector) of another: the ``k`` best of each class."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.string()), "label": pa.array([], pa.int32()), "chunk_id": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        right = right.sort_by("cid")
        a, b = _matrix(left.column("vector")), _matrix(right.column("cvector"))
        names = np.array(left.column("id").to_pylist(), object)
        others = np.array(right.column("cid").to_pylist(), object)
        labels = right.column("clabel").to_numpy()
        parts = []
        for label in np.unique(labels):
            mine = np.flatnonzero(labels == label)
            n = min(k, len(mine))
            for at in range(0, len(a), 512):
                s = np.round(np.clip(a[at : at + 512] @ b[mine].T, 0, 1), 12)
                least = np.partition(s, len(mine) - n, axis=1)[:, len(mine) - n]
                r, x = np.nonzero(s >= least[:, None])
                order = np.lexsort((x, -s[r, x], r))  # rows are sorted by id
                r, x = r[order], x[order]
                first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                rank = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
                r, x = r[rank < n], x[rank < n]
                parts.append(pa.table({"query_id": pa.array(names[at + r], pa.string()), "label": pa.array(np.full(len(r), label), pa.int32()), "chunk_id": pa.array(others[mine[x]], pa.string()), "similarity": s[r, x]}))
        return pa.concat_tables(parts)

    return compare


def class_neighbours(queries: DataFrame, corpus: DataFrame, k: int, *, block: int = 20_000) -> DataFrame:
    """(query_id, label, chunk_id, similarity, rank): the ``k`` most similar chunks of each class for every query.

    ``queries``: id (string), vector; ``corpus``: id, label (int), vector; all vectors
    of one length, finite and not 0. Similarity is 1 minus the cosine distance, cut
    to 0..1 and rounded to 12 places; ties go by id. Both sides are cut into blocks
    of about ``block`` rows; a task compares two blocks by matrix products and hands
    on ``k`` rows per query and class, so no pair is ever written out.
    """
    require_positive(k=k, block=block)
    q_blocks = max(1, math.ceil(queries.count() / block))
    c_blocks = max(1, math.ceil(corpus.count() / block))
    q = queries.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("i"))
    q = q.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    # new names, for both sides may come from one table
    c = corpus.select(F.col("id").alias("cid"), F.col("label").alias("clabel"), F.col("vector").alias("cvector"), F.pmod(F.xxhash64("id"), F.lit(c_blocks)).cast("int").alias("cj"))
    c = c.withColumn("ci", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    pairs = q.groupBy("i", "j").cogroup(c.groupBy("ci", "cj")).applyInArrow(class_comparison(k), FOUND)
    return first_in_groups(pairs, ["query_id", "label"], [F.desc("similarity"), F.asc("chunk_id")], k)
