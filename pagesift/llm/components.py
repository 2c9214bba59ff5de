"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.plans.stages import drop_stage, metrics_of, stage


def join_hot(rows: DataFrame, side: DataFrame, key: str, hot_rows: int, max_hot: int, largest: int | None = None) -> DataFrame:
    """``rows`` inner-joined with ``side`` (unique in ``key``, with its number of rows in ``_n``), whatever the skew of ``key``.

    The keys of more than ``hot_rows`` rows, at most ``max_hot`` of them, are joined
    by broadcasting just these (so never more than ``max_hot`` rows); a key beyond
    holds at most 1/max_hot of the rows and takes the shuffled join. ``largest``: the
    most rows of a key, if known; then no hot keys are looked for in vain.
    """
    hot = [] if largest is not None and largest <= hot_rows else [
        r[0]
        for r in side.where(F.col("_n") > hot_rows).orderBy(F.desc("_n"), key).limit(max_hot).select(key).collect()
    ]
    if not hot:
        return rows.join(side.drop("_n"), key)
    is_hot = F.col(key).isin(hot)
    return rows.where(~is_hot).join(side.where(~is_hot).drop("_n"), key).unionByName(
        rows.where(is_hot).join(F.broadcast(side.where(is_hot).drop("_n")), key)
    )


def connected_components(
    edges: DataFrame, *, hot_rows: int = 200_000, max_hot: int = 1_000, max_rounds: int = 100
) -> DataFrame:
    """(node, component) of a graph: ``edges`` has two long columns src and dst; component is its smallest node.

    A round is a large-star step (every neighbour larger than a node is linked to
    the node's smallest neighbour) and a small-star step (likewise for the smaller
    neighbours); both keep components, and after O(log^2) rounds every component is
    a star. No node's neighbours are ever gathered: a node sends its minimum, which
    is found by a partial aggregate, along its edges. Each step is written to the
    shared folder, so a lost executor costs one step at most.

    Defined cases: edges with a null end are left out; loops keep their node;
    repeated edges don't matter; without edges the result is empty.
    """
    spark = edges.sparkSession
    clean = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src IS NOT NULL AND dst IS NOT NULL")
    nodes = stage(clean.selectExpr("explode(array(src, dst)) AS node").distinct(), "nodes")
    current = stage(_oriented(clean), "edges", _mark())
    mark = metrics_of(current)
    for _ in range(max_rounds):
        large = _star(current, True, hot_rows, max_hot)
        drop_stage(current)
        current = _star(large, False, hot_rows, max_hot)
        drop_stage(large)
        before, mark = mark, metrics_of(current)
        if mark == before:
            break
    else:
        raise RuntimeError("components haven't settled")
    linked = nodes.join(current.select(F.col("src").alias("node"), F.col("dst").alias("component")), "node", "left")
    return linked.select("node", F.coalesce("component", "node").alias("component"))


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger end to the smaller; loops dropped."""
    return edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct()


def _mark() -> dict[str, Column]:
    """Number of edges and an order-free checksum of them, taken as they are written: equal marks, equal edges."""
    return {"edges": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))}


def _star(edges: DataFrame, large: bool, hot_rows: int, max_hot: int) -> DataFrame:
    """One large-star or small-star step over oriented edges."""
    down = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    both = down.unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))) if large else down
    lowest = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
    lowest = stage(lowest.withColumn("m", F.least("u", "m")), "lowest", {"largest": F.max("_n")})
    largest = metrics_of(lowest)["largest"] or 0
    if large:
        linked = join_hot(both.where("v > u"), lowest, "u", hot_rows, max_hot, largest).select(
            F.col("v").alias("src"), F.col("m").alias("dst")
        )
    else:
        joined = join_hot(both, lowest, "u", hot_rows, max_hot, largest).select(F.col("v").alias("src"), F.col("m").alias("dst"))
        linked = joined.unionByName(lowest.select(F.col("u").alias("src"), F.col("m").alias("dst")))
    out = stage(_oriented(linked), "edges", _mark())
    drop_stage(lowest)
    return out
