"""Batches of similar length for training, and what a training step computes from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.operators.checks import require_positive
from pagesift.operators.ranking import rank_in_groups


def length_buckets(df: DataFrame, key: str, length: str, buffer: int = 8192, batch: int = 64) -> DataFrame:
    """Rows with bucket (every ``buffer`` rows by key), batch and place in the batch, ordered by length within a bucket."""
    require_positive(buffer=buffer, batch=batch)
    ranked = rank_in_groups(df, [], [F.asc(key)], "_rn").withColumn("bucket", F.floor((F.col("_rn") - 1) / buffer))
    placed = rank_in_groups(ranked, ["bucket"], [F.asc(length), F.asc(key)], "_at")
    return placed.select(
        *df.columns, "bucket", F.floor((F.col("_at") - 1) / batch).alias("batch"), ((F.col("_at") - 1) % batch).alias("place")
    )


def skip_batches(batches: DataFrame, consumed: int, batch: int = 64, buffer: int = 8192) -> DataFrame:
    """The batches after the first ``consumed`` rows, as a resumed run sees them."""
    row = F.col("bucket") * buffer + F.col("batch") * batch + F.col("place")
    return batches.where(row >= consumed)


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1, with a denominator of at least 1e-6; ``vectors`` is an array of arrays."""
    size = F.size(vectors[0])
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1e-6))
    pairs = F.arrays_zip(vectors.alias("v"), mask.alias("m"))
    return F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.get(p["v"], i).cast("double") * p["m"]) / weight,
    )


def mse(a: Column, b: Column) -> Column:
    """Mean squared difference of two vectors."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, d: s + d)
    return total / F.size(a)


def train_distributed(train: Callable, *args, processes: int = 1, use_gpu: bool = False, local: bool = False):
    """Run ``train(*args)`` in ``processes`` processes of the cluster and return what the first one gives.

    ``train`` reads its batches (see ``length_buckets`` and ``skip_batches``) from a
    written table and its share of them by the rank of its process. The framework that
    it trains with isn't part of this library; without it this raises an error.
    """
    require_positive(processes=processes)
    try:
        import torch  # noqa: F401
        from pyspark.ml.torch.distributor import TorchDistributor
    except ImportError as e:
        raise RuntimeError("training needs torch on driver and executors") from e
    return TorchDistributor(num_processes=processes, local_mode=local, use_gpu=use_gpu).run(train, *args)
