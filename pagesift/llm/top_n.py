"""Top N rows of every group, by a split into heavy and light groups.

Exact group counts decide the way of a group. Rows of light groups meet once by
the group's hash and an ordinary window ranks them. Rows of heavy groups are
salted, range-sorted by (group, salt), cut to N within each salt, and only the
few survivors of all salts meet to be ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.plans.names import fresh, without
from pagesift.plans.stages import stage

#: Heavy groups up to which their table (two numbers a group) is broadcast, and of more, how many of the largest.
MOST_BROADCAST, HOTTEST = 500_000, 1_000


def heavy_groups(df: DataFrame, key: str, salts: str, heavy_rows: int) -> DataFrame:
    """(key, salts) of every group of more than ``heavy_rows`` rows, from exact counts; written, as a table of any size."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(salts)).where(F.col(salts) > heavy_rows)
    return stage(counts.select(key, (F.ceil(F.col(salts) / heavy_rows) + 1).cast("int").alias(salts)), "heavy")


def parted(hashed: DataFrame, heavy: DataFrame, key: str, salts: str, most_broadcast: int, hottest: int) -> tuple[DataFrame, DataFrame]:
    """(rows of light groups, met by ``key``; rows of heavy groups with ``salts``), however many heavy groups there are.

    Up to ``most_broadcast`` heavy groups are told to every task. Of more, only the
    ``hottest`` are, and the others meet their rows by a hash join: a group that isn't
    among the hottest holds at most 1/hottest of all rows, and the join only streams them.
    """
    if heavy.count() <= most_broadcast:
        few = F.broadcast(heavy)
        # without this exchange the window that picks deliveries would ask for its own
        return hashed.join(few, key, "left_anti").repartition(F.col(key)), hashed.join(few, key)
    top = stage(heavy.orderBy(F.desc(salts), key).limit(hottest), "hottest")
    rest = heavy.join(F.broadcast(top.select(key)), key, "left_anti")
    others = hashed.join(F.broadcast(top.select(key)), key, "left_anti")
    split = hashed.join(F.broadcast(top), key).unionByName(others.join(rest.hint("merge"), key))
    return others.join(rest.hint("merge"), key, "left_anti"), split


def salted(rows: DataFrame, key: str, salts: str, item: Column, slices: int) -> DataFrame:
    """``rows`` with their salt in place of the number of salts, range-sorted by (key, salt); a salt follows the item, so its deliveries share one."""
    return rows.withColumn(salts, F.pmod(item, F.col(salts))).repartitionByRange(min(slices, 100_000), key, salts)


def top_n_per_group(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    n: int,
    *,
    latest_by: list[str] | None = None,
    latest_order: list[Column] | None = None,
    keep: Column | None = None,
    rank: str = "rank",
    heavy_rows: int = 100_000,
    most_broadcast: int = MOST_BROADCAST,
    hottest: int = HOTTEST,
) -> DataFrame:
    """The first ``n`` rows of each group by ``order``, with their rank from 1 in column ``rank``.

    ``latest_by``: rows equal in the group and these columns are deliveries of one
    item, of which only the first by ``latest_order`` counts. ``keep``: rows for
    which this is not true are no items (applied after that choice).

    Defined cases: a null group key is a group like any other; nulls in ``order``
    sort as the given columns say; equal rows keep distinct ranks, so ``order``
    should end in a unique column; an empty table gives no rows; n < 1 gives no
    rows; all other columns of ``df`` pass through, but one named like ``rank`` is
    replaced. Memory of a task: a light group (``heavy_rows`` rows) or one salt of a
    heavy one, whatever the size of the group and however many groups are heavy.
    """
    h, s, last_, r = fresh(df.columns, "_topn_h", "_topn_s", "_topn_l", "_topn_r")
    names = df.columns
    hashed = df.withColumn(h, F.xxhash64(*group))
    heavy = heavy_groups(hashed, h, s, heavy_rows)
    out = [F.col(f"`{c}`") for c in without(names, rank)] + [F.col(r).alias(rank)]

    def cut(rows: DataFrame, by: list[str]) -> DataFrame:
        if latest_by:
            one = Window.partitionBy(h, *by, *group, *latest_by).orderBy(*latest_order)
            rows = rows.withColumn(last_, F.row_number().over(one)).where(F.col(last_) == 1).drop(last_)
        if keep is not None:
            rows = rows.where(keep)
        best = Window.partitionBy(h, *by, *group).orderBy(*order)
        return rows.withColumn(r, F.row_number().over(best)).where(F.col(r) <= n)

    slices = heavy.agg(F.sum(s)).first()[0]
    if not slices:
        return cut(hashed.repartition(F.col(h)), []).select(*out)
    light, split = parted(hashed, heavy, h, s, most_broadcast, hottest)
    survivors = cut(salted(split, h, s, F.xxhash64(*(latest_by or names), F.lit(7)), slices), [s]).drop(r)  # n rows of each salt
    final = Window.partitionBy(h, *group).orderBy(*order)
    merged = survivors.withColumn(r, F.row_number().over(final)).where(F.col(r) <= n)
    return cut(light, []).select(*out).unionByName(merged.select(*out))
