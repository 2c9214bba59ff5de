"""Cutting lineage: intermediate tables written to the cluster's shared folder.

A stage is a parquet table under the folder named by ``spark.checkpoint.dir``.
Reading it back costs a scan of a columnar file, survives the loss of any
executor, and unlike ``DataFrame.checkpoint`` keeps column pruning.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pagesift-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str = "stage", metrics: dict[str, Column] | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of the written table.

    ``metrics``: aggregates of the rows, taken as they are written; see ``metrics_of``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    seen = Observation() if metrics else None
    rows = df.observe(seen, *[c.alias(k) for k, c in metrics.items()]) if metrics else df
    rows.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    if metrics:
        got = seen.get
        # where the optimiser saw that nothing is written, nothing was observed
        out._metrics = got if got.keys() >= metrics.keys() else out.agg(*[c.alias(k) for k, c in metrics.items()]).first().asDict()
    return out


def metrics_of(df: DataFrame) -> dict:
    """The aggregates taken when this stage was written."""
    return df._metrics


def drop_stage(df: DataFrame | None) -> None:
    """Delete a stage that nothing reads any more (superseded iterations)."""
    path = getattr(df, "_stage_path", None)
    if path and _written.pop(path, None):
        _delete(df.sparkSession, path)


@contextmanager
def stages_of_a_job() -> Iterator[None]:
    """Deletes at its end the stages that were written within it; results must have been written or collected by then."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p in _written if p not in before]:
            _delete(_written.pop(path), path)


def drop_all_stages() -> None:
    """Delete every stage this driver has written; results that still read one can't be read any more."""
    _clean()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the cluster's own clean-up remains
            pass
    _written.clear()
