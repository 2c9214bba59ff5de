"""Splits that never separate records sharing an entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.ids import unit_hash
from pagesift.llm.components import connected_components, join_hot
from pagesift.plans.names import fresh, without
from pagesift.plans.stages import stage

SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def record_groups(
    records: DataFrame, number: str, entities: list[str], *, component: str | None = None, hot_rows: int = 200_000, max_hot: int = 1_000
) -> DataFrame:
    """``records`` with column ``group_no``: the smallest ``number`` of all records linked to it.

    Records are linked if they have the same ``number`` or the same value in one of
    the ``entities`` columns, directly or through others. ``number`` is a long, a
    negative one counts as none; a record without one is linked through its entities alone.

    Every entity value becomes one edge per distinct (number, value), to the
    smallest number of the value: a value that a third of all records share costs
    as many edges as it has numbers, never pairs. A record without number gets a
    negative number of its own from its entities (all such records with equal
    entities are one node); a group of only such records has group_no null.
    ``component``: name of a further column, a long that tells all groups apart,
    those without a number too; null where there is neither number nor entity.

    Defined cases: null entity values link nothing; a record with neither number
    nor entity has group_no null; an empty table gives no rows; a column of the name
    group_no is replaced.
    """
    names = without(records.columns, "group_no", *([component] if component else []))
    (rg,) = fresh(names, "_rg")
    hashed = F.shiftrightunsigned(F.xxhash64(*[F.coalesce(F.col(e).cast("string"), F.lit("\0")) for e in entities]), 1)
    some = F.coalesce(*[F.col(e).cast("string") for e in entities]).isNotNull()
    node = F.coalesce(F.when(F.col(number) >= 0, F.col(number)), F.when(some, -hashed - 1))
    rows = stage(records.withColumn(rg, node).select(*names, rg), "records")
    known = rows.where(F.col(rg).isNotNull())
    edges = known.select(F.col(rg).alias("src"), F.col(rg).alias("dst")).distinct()
    for entity in entities:
        values = known.where(F.col(entity).isNotNull()).select(F.col(rg).alias("_rg"), F.col(entity).alias("value"))
        values = values.distinct()
        # a number that is a real one comes first, so that group_no is found below
        lowest = values.groupBy("value").agg(
            F.coalesce(F.min(F.when(F.col("_rg") >= 0, F.col("_rg"))), F.min("_rg")).alias("lowest"),
            F.count(F.lit(1)).alias("_n"),
        )
        pairs = join_hot(values, lowest, "value", hot_rows, max_hot)
        edges = edges.unionByName(pairs.select(F.col("_rg").alias("src"), F.col("lowest").alias("dst")))
    parts = stage(connected_components(edges, hot_rows=hot_rows, max_hot=max_hot), "components")
    smallest = parts.groupBy("component").agg(
        F.min(F.when(F.col("node") >= 0, F.col("node"))).alias("group_no"), F.count(F.lit(1)).alias("_n")
    )
    by_node = join_hot(parts, smallest, "component", hot_rows, max_hot).select(F.col("node").alias(rg), "group_no", *([F.col("component").alias(component)] if component else []))
    # a node stands for all records of one number; repeats of one number are few unless it is hot
    sizes = known.groupBy(rg).agg(F.count(F.lit(1)).alias("_n"))
    linked = join_hot(known, by_node.join(sizes, rg), rg, hot_rows, max_hot)
    rest = rows.where(F.col(rg).isNull()).withColumn("group_no", F.lit(None).cast("long"))
    if component:
        rest = rest.withColumn(component, F.lit(None).cast("long"))
    return linked.unionByName(rest).drop(rg)


def split_of(group: Column, seed: int = 42, shares: tuple = SHARES) -> Column:
    """The split whose range holds the hash of the group; ranges are as wide as the shares."""
    place = unit_hash(F.lit(str(seed)), group.cast("string"))
    total = sum(s for _, s in shares)
    out, upper = None, 0.0
    for name, share in shares[:-1]:
        upper += share / total
        out = F.when(place < upper, name) if out is None else out.when(place < upper, name)
    return out.otherwise(shares[-1][0]) if out is not None else F.lit(shares[-1][0])
