"""Samples whose category shares match given targets, with minimums and reported gaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift.operators.ranking import rank_in_groups
from pagesift.plans.joins import broadcast_if_small
from pagesift.plans.stages import stage


def rake(counts: np.ndarray, codes: list[np.ndarray], totals: list[np.ndarray], rounds: int = 200, tol: float = 1e-10) -> np.ndarray:
    """Expected draws of each cell: starts in proportion to ``counts`` and is scaled to each margin in turn.

    ``codes[i]`` gives each cell's category in margin i, ``totals[i]`` the wanted
    total of each of its categories. A category without members takes no part.
    """
    draws = counts.astype(float)
    for _ in range(rounds):
        before = draws.copy()
        for code, total in zip(codes, totals, strict=True):
            have = np.bincount(code, draws, len(total))
            draws = draws * np.divide(total, have, out=np.zeros_like(have), where=have > 0)[code]
        if np.abs(draws - before).max(initial=0) <= tol * max(1.0, draws.max(initial=0)):
            break
    return draws


def whole_draws(
    raked: np.ndarray, need: np.ndarray, least: np.ndarray, have: np.ndarray, size: int, provisional: np.ndarray | None = None
) -> np.ndarray:
    """Whole draws per cell that repair a provisional draw: they add up to ``size`` where the members allow it.

    Every cell gets what it needs as far as it has members. What is then missing,
    because cells can't be filled, stays where the provisional draw took more than
    needed, and beyond that goes to cells with members left; what is too much,
    because of minimums, is taken from cells above theirs, first where the
    provisional draw took less. Within each step cells take part in proportion to
    their raked draws; remainders go by size, then by position.
    """
    draws = np.minimum(need, have).astype(np.int64)
    for soft in (True, False) if provisional is not None else (False,):
        for _ in range(64):
            missing = int(size - draws.sum())
            if missing > 0:
                room = (np.minimum(provisional, have) if soft else have) - draws
            else:
                floor = np.minimum(least, draws)
                room = draws - (np.maximum(floor, np.minimum(provisional, draws)) if soft else floor)
            room = np.maximum(room, 0)
            if missing == 0 or room.sum() == 0:
                break
            weight = np.where(room > 0, np.maximum(raked, 1e-9), 0.0)
            part = np.minimum(abs(missing) * weight / weight.sum(), room)
            step = np.floor(part).astype(np.int64)
            rest = min(abs(missing) - int(step.sum()), int((room > step).sum()))
            order = np.lexsort((np.arange(len(part)), -np.where(room > step, part - step + 1, -1)))
            step[order[:rest]] += 1
            draws = draws + np.sign(missing) * step
    return draws


def _codes(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
    return pdf.groupby(columns, dropna=False, sort=True).ngroup().to_numpy()


def raked_weights(targets: DataFrame, population: DataFrame, sample: str, stratum: str, categories: list[str]) -> DataFrame:
    """One row per target category of every sample with available, wanted and weight.

    ``targets``: sample, stratum, categories, size (draws per stratum), share (within
    the stratum), min_rows. ``population``: stratum, categories, available. The margins
    are those of the stratum and of each category alone; how the categories combine
    follows the population. Grouped by sample; a group has as many rows as the sample
    has target categories, so its size doesn't depend on the population.
    """
    cell = [stratum, *categories]
    joined = targets.join(population, cell, "left").fillna(0, ["available"])
    keep = [sample, *cell, *(c for c in targets.columns if c not in (sample, *cell)), "available"]
    schema = ", ".join(f"`{c}` {t}" for c, t in joined.select(*keep).dtypes) + ", wanted long, raked double, weight double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cell, kind="stable").reset_index(drop=True)
        have = pdf["available"].to_numpy(np.int64)
        wish = pdf["share"].to_numpy(float) * pdf["size"].to_numpy(float)
        need = np.maximum(np.floor(wish + 0.5 + 1e-9).astype(np.int64), pdf["min_rows"].to_numpy(np.int64))
        codes = [_codes(pdf, [c]) for c in cell]
        raked = rake(have, codes, [np.bincount(c, wish) for c in codes])
        chance = np.divide(raked, have, out=np.zeros(len(pdf)), where=have > 0)
        weight = -np.log1p(-np.minimum(chance, 1 - 1e-6))  # a key below 1 then has this chance
        return pdf[keep].assign(wanted=need, raked=raked, weight=weight)

    return joined.select(*keep).groupBy(sample).applyInPandas(one, schema)


def repair_plan(plan: DataFrame, provisional: DataFrame, sample: str, stratum: str, categories: list[str]) -> DataFrame:
    """``plan`` with the quota of each category, from the counts of the provisional draw (sample, stratum, categories, provisional)."""
    cell = [stratum, *categories]
    both = plan.join(provisional, [sample, *cell], "left").fillna(0, ["provisional"])
    schema = ", ".join(f"`{c}` {t}" for c, t in both.dtypes) + ", quota long"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cell, kind="stable").reset_index(drop=True)
        quota = np.zeros(len(pdf), np.int64)
        columns = ["provisional", "wanted", "min_rows", "available"]
        drawn, need, least, have = (pdf[c].to_numpy(np.int64) for c in columns)
        for at in pdf.groupby(stratum, dropna=False).indices.values():
            quota[at] = whole_draws(pdf["raked"].to_numpy(float)[at], need[at], least[at], have[at], int(pdf["size"].iloc[at[0]]), drawn[at])
        return pdf.assign(quota=quota)

    return both.groupBy(sample).applyInPandas(one, schema)


def target_sample(
    rows: DataFrame, key: str, targets: DataFrame, *, sample: str, stratum: str, categories: list[str], seed: str
) -> tuple[DataFrame, DataFrame]:
    """(drawn rows, report). See ``raked_weights`` for ``targets``, which also has column ``seed``.

    Weights are raked by iterative proportional fitting over the margins of the
    stratum and of each category. A row's key is -ln(u)/weight, u a hash of seed and
    row and the weight such that a row's key is below 1 with its raked chance (weighted
    exponential keys); the ``size`` smallest of a stratum are the provisional draw, in
    which the margins hold on average. It is then repaired: categories drawn beyond their
    target give up their largest keys, those short of it or of their minimum take
    their next smallest, and what unfillable ones leave over stays as drawn. The
    report counts the drawn rows and has gap (rows wanted that the ranked members of
    the category don't reach), residual (rows wanted that aren't drawn) and the share
    reached; ``provisional`` is what the raked draw alone took.

    Defined cases: rows of no target category, and rows with a null stratum or
    category, are never drawn; a repeated row counts as often as it occurs; a target
    without rows is reported with available 0; an empty table draws nothing and
    reports every gap; in targets a null or NaN share, minimum or size is 0, and a
    category that comes twice has the larger one; other columns are ignored.
    """
    cell = [stratum, *categories]
    zero = lambda c: F.greatest(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    targets = targets.groupBy(sample, *cell).agg(
        F.max(zero("size")).cast("long").alias("size"),
        F.max(zero("share")).alias("share"),
        F.max(zero("min_rows")).cast("long").alias("min_rows"),
        F.max(F.max(seed)).over(Window.partitionBy(sample)).alias(seed),  # one for the sample
    )
    rows = stage(rows.select(key, *cell), "population")
    counts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("available"))
    plan = stage(raked_weights(targets, counts, sample, stratum, categories), "weights")
    weights = plan.where("available > 0").select(sample, *cell, "weight", "size", "wanted", seed)
    pool = rows.join(broadcast_if_small(weights), cell)  # a row per target
    digest = F.md5(F.concat_ws(":", F.col(seed).cast("string"), F.col(key).cast("string")).cast("binary"))
    unit = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    pool = pool.select(sample, *cell, key, "size", "wanted", (-F.log(unit) / F.greatest("weight", F.lit(1e-12))).alias("_key"))
    # nothing beyond these can be in the provisional draw, nor be taken by the repair
    ranked = rank_in_groups(pool, [sample, *cell], [F.asc("_key"), F.asc(key)], "_rank").where(F.col("_rank") <= F.greatest("size", "wanted"))
    ranked = stage(ranked, "ranked")
    first = rank_in_groups(ranked.where("_rank <= size"), [sample, stratum], [F.asc("_key"), F.asc(key), F.asc("_rank")], "_at").where("_at <= size")
    provisional = first.groupBy(sample, *cell).agg(F.count(F.lit(1)).alias("provisional"))
    quotas = stage(repair_plan(plan, provisional, sample, stratum, categories), "quotas")
    few = broadcast_if_small(quotas.select(sample, *cell, "quota"))
    taken = ranked.join(few, [sample, *cell])
    drawn = taken.where("_rank <= quota").select(sample, *cell, key)
    reached = taken.groupBy(sample, *cell).agg(
        F.count_if(F.col("_rank") <= F.col("quota")).alias("drawn"), F.count_if(F.col("_rank") <= F.col("wanted")).alias("reached")
    )
    report = quotas.join(reached, [sample, *cell], "left").fillna(0, ["drawn", "reached"]).select(
        sample, *cell, "wanted", "available", "provisional", "drawn", (F.col("wanted") - F.col("reached")).alias("gap"),
        F.greatest(F.col("wanted") - F.col("drawn"), F.lit(0)).alias("residual"),
        "share", F.when(F.col("size") > 0, F.col("drawn") / F.col("size")).alias("share_drawn"),
    )
    return drawn, report
