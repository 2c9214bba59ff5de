"""Positions of rows in groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.plans.joins import broadcast_if_small
from pagesift.plans.names import fresh
from pagesift.plans.stages import stage


def rank_in_groups(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """``df`` with each row's position in its group, from 1, without ever gathering a group.

    Rows are range-partitioned by group and order, so a large group spreads over
    many partitions, and numbered as they are written: a row's rank is its distance from
    the group's first row in its partition plus the rows of the group in earlier
    partitions. The rows move once; what is joined to them is one row per partition
    and group, broadcast if that is few. Without ``group`` all rows are one. ``order``
    must be total, else ties are split at random. A null group is a group.
    """
    at, part, first, before, n = fresh([*df.columns, rank], "_at", "_part", "_first", "_before", "_n")
    names = fresh([*df.columns, at, part], *[f"_g{i}" for i in range(len(group))])
    # the id counts on within a partition, whose number is in the bits above 33
    placed = df.repartitionByRange(*[F.col(g) for g in group], *order).sortWithinPartitions(*[F.col(g) for g in group], *order)
    placed = stage(placed.withColumn(at, F.monotonically_increasing_id()), "placed").withColumn(part, F.shiftright(at, 33))
    firsts = placed.groupBy(part, *group).agg(F.count(F.lit(1)).alias(n), F.min(at).alias(first))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0)))
    firsts = firsts.select(F.col(part).alias(n), first, before, *[F.col(g).alias(x) for g, x in zip(group, names, strict=True)])
    on = [F.col(part) == F.col(n), *[F.col(g).eqNullSafe(F.col(x)) for g, x in zip(group, names, strict=True)]]
    joined = placed.join(broadcast_if_small(stage(firsts, "firsts")), on)
    return joined.select(*df.columns, (F.col(at) - F.col(first) + 1 + F.col(before)).alias(rank))


def running_sums(df: DataFrame, order: str, value: str, total: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to this one by ``order``, which is unique; no task sees all rows.

    Rows are range-partitioned; a row's sum is the one within its partition plus those of
    the partitions before, one row each.
    """
    part, before, local = fresh([*df.columns, total], "_part", "_before", "_local")
    placed = stage(df.repartitionByRange(F.col(order)).withColumn(part, F.spark_partition_id()), "placed")
    sums = placed.groupBy(part).agg(F.sum(value).alias(local))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    sums = sums.select(part, F.coalesce(F.sum(local).over(earlier), F.lit(0)).alias(before))
    here = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn(local, F.sum(value).over(here)).join(broadcast_if_small(stage(sums, "sums")), part)
    return summed.select(*df.columns, (F.col(local) + F.col(before)).alias(total))


def first_in_groups(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank; each map task keeps ``n`` rows of a group at most (WindowGroupLimit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)
