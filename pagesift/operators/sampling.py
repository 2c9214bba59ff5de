"""Seeded samples and splits by the rank of a hash, the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.operators.checks import require_positive, require_share
from pagesift.operators.ranking import first_in_groups, rank_in_groups


def seeded_key(seed: int, key: str) -> Column:
    """The sort key of a row: MD5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def stratified_split(df: DataFrame, stratum: str, key: str, test_share: float, seed: int = 42) -> DataFrame:
    """Every row with split 'test' for the given share of each stratum (rounded), else 'train'."""
    require_share(test_share=test_share)
    keyed = df.withColumn("_key", seeded_key(seed, key))
    sizes = df.groupBy(stratum).agg(F.round(F.count(F.lit(1)) * test_share).cast("long").alias("_cut"))
    ranked = rank_in_groups(keyed, [stratum], [F.asc("_key"), F.asc(key)], "_rank").join(sizes, stratum)
    return ranked.withColumn("split", F.when(F.col("_rank") <= F.col("_cut"), "test").otherwise("train")).select(*df.columns, "split")


def fixed_count_split(df: DataFrame, stratum: str, key: str, train: int, test: int, seed: int = 42) -> DataFrame:
    """The first ``train`` rows of each stratum by seeded hash, then ``test`` rows; the others are left out."""
    require_positive(train=train, test=test)
    ranked = first_in_groups(df.withColumn("_key", seeded_key(seed, key)), [stratum], [F.asc("_key"), F.asc(key)], train + test, "_rank")
    return ranked.withColumn("split", F.when(F.col("_rank") <= train, "train").otherwise("test")).select(*df.columns, "split")


def balanced_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each stratum by seeded hash."""
    ranked = first_in_groups(df.withColumn("_key", seeded_key(seed, key)), [stratum], [F.asc("_key"), F.asc(key)], n, "_rank")
    return ranked.select(*df.columns)


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Every row with its position from 0 in a seeded permutation."""
    ranked = rank_in_groups(df.withColumn("_key", seeded_key(seed, key)), [], [F.asc("_key"), F.asc(key)], "_rank")
    return ranked.select(*df.columns, (F.col("_rank") - 1).alias("position"))


def bounded_shuffle(df: DataFrame, seed: int = 42) -> DataFrame:
    """A shuffle within partitions only, as a bounded buffer gives: cheap, without an exchange."""
    return df.withColumn("_r", F.rand(seed)).sortWithinPartitions("_r").drop("_r")
